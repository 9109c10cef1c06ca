"""Chat formatting with a grammar round trip, in DataFrame expressions only.

Grammar of a formatted conversation (a regular language, so the parser is one deterministic split):

    conversation := turn*
    turn         := "<|" role "|>" text "<|end|>"

``role`` and ``text`` are escaped so that neither holds a control string.  Control strings open with
"<" followed by "|".  An escape inserts "\\\\" after such a "<"; "<" followed by one or more "\\\\" and "|"
gets one more, so unescaping removes exactly one.  A conversation is first rendered as it is and parsed
again; where the recovered turns differ from the source, its conflicting content is escaped.  One escape
pass is a bijection onto strings free of control strings, so the second parse equals the source; the
``attempts`` column says which parse was accepted (0: plain, 1: escaped), and ``is_identical`` that it
was compared.

Turns are ordered by turn, role, text.  Null text is empty text, null role the empty role, a null
turn number comes first.  Repeated rows are turns of their own.  Rows with a null conv_id form one
conversation with a null id.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import distinct_name, read

OPEN, CLOSE, END = "<|", "|>", "<|end|>"
#: Parses exactly what the grammar yields: a role without "<|", then a text up to the end mark.
TURN = r"(?s)<\|(.*?)\|>(.*?)<\|end\|>"


def escape(x: Column) -> Column:
    """Break up each "<|" (and protect what already looks broken up); "|>" too, for roles."""
    return F.regexp_replace(F.regexp_replace(x, r"<(\\*)\|", r"<$1\\|"), r"\|(\\*)>", r"|$1\\>")


def unescape(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"\|(\\*)\\>", r"|$1>"), r"<(\\*)\\\|", r"<$1|")


def _render(turns: Column, escaped: bool) -> Column:
    keep = escape if escaped else (lambda x: x)
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), keep(t["role"]), F.lit(CLOSE), keep(t["text"]), F.lit(END))), "")


def _parse(formatted: Column, escaped: bool) -> Column:
    keep = unescape if escaped else (lambda x: x)
    roles, texts = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1)), F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))
    return F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")), lambda t: F.struct(keep(t["role"]).alias("role"), keep(t["text"]).alias("text")))


def _parsed(formatted: Column, escaped: bool) -> Column:
    """Turns read back; null unless rendering them again gives the same string (no rest outside turns)."""
    turns = _parse(formatted, escaped)
    return F.when(_render(turns, escaped) == formatted, turns)


def format_conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: the formatted text, the turns read back from it, and how it was reached.

    Columns: conv_id, formatted, parsed (array of role, text), attempts, is_identical.
    """
    rows = df.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    plain = turns.withColumn("plain", _render(F.col("source"), False)).withColumn("read_plain", _parsed(F.col("plain"), False))
    plain = plain.withColumn("ok", F.coalesce(F.col("read_plain") == F.col("source"), F.lit(False)))
    out = plain.withColumn("formatted", F.when(F.col("ok"), F.col("plain")).otherwise(_render(F.col("source"), True)))
    out = out.withColumn("parsed", F.when(F.col("ok"), F.col("read_plain")).otherwise(_parsed(F.col("formatted"), True)))
    return out.select(
        "conv_id", "formatted", "parsed",
        F.when(F.col("ok"), 0).otherwise(1).alias("attempts"),
        F.coalesce(F.col("parsed") == F.col("source"), F.lit(False)).alias("is_identical"),
    )


def loss_spans(df: DataFrame, role: str = "assistant") -> DataFrame:
    """``df`` of format_conversations with ``loss``: the texts under the loss mask, read back, in order."""
    name = distinct_name(df.columns, "loss")
    return df.withColumn(name, F.transform(F.filter("parsed", lambda t: t["role"] == role), lambda t: t["text"]))


def op8_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts are control strings of another template."""
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("t")).select("conv_id", "t.*")
    talks = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
    out = loss_spans(format_conversations(talks))
    whole = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join("loss", "")
    return out.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "attempts", "is_identical",
    )


QUERIES = {"op8_chat": op8_chat}
#: formatted_chars: the marks, the texts and one escape character for each broken control string.
SQL = {
    "op8_chat": r"""
WITH talks AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
convs AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS masked,
         sum(length(role) + length(text) + 11) AS plain_chars,
         sum(length(regexp_replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g'))
           + length(regexp_replace(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g')) + 11) AS escaped_chars,
         max(CASE WHEN contains(role || ' ' || text, '<|') OR contains(role, '|>') OR role LIKE '%|' THEN 1 ELSE 0 END) AS attempts
  FROM talks GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(masked) AS loss_chars, sha256(masked) AS loss_sha256,
       CASE WHEN attempts = 0 THEN plain_chars ELSE escaped_chars END::BIGINT AS formatted_chars,
       attempts::INTEGER AS attempts, true AS is_identical
FROM convs""",
}
