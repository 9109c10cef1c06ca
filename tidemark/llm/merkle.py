"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces, in DataFrame expressions only.

A text is cut, without loss, into sections (up to and with blank lines) and those into paragraphs (up to and
with a line break).  A paragraph's digest is the SHA-256 of its bytes, a section's that of its paragraphs'
digests, the root that of the sections' digests: equal texts have equal roots, different texts different
ones.  Below the paragraphs, pieces of up to PIECE_WORDS words give 64-bit leaves.  Where two roots differ,
sections, paragraphs and leaves that one tree has alone locate the edit, and the likeness of two trees is
the Dice coefficient of their sets of leaves (1 for two trees without any).

Null text is empty text: a root over no sections and no leaves.  Repeated rows have equal trees.  Added
columns get trailing underscores where their names are taken; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import distinct_name, read

PIECE_WORDS = 4
SECTION = r"(?s).+?(?:\n\n+|\z)"
PARAGRAPH = r"[^\n]*\n|[^\n]+"
PIECE = r"\S++(?:[^\S\n]++\S++){0,%d}" % (PIECE_WORDS - 1)
#: Documents are put in order in groups of about so many; the groups' ends are known to the driver.
GROUP = 4000
MAX_GROUPS = 4096


def sections(text: Column) -> Column:
    """array<struct<digest, paragraphs: array<string>>>, all digests as hex."""
    def one(s):
        paragraphs = F.transform(F.regexp_extract_all(s, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.sha2(p, 256))
        return F.struct(F.sha2(F.array_join(paragraphs, ""), 256).alias("digest"), paragraphs.alias("paragraphs"))

    return F.transform(F.regexp_extract_all(text, F.lit(SECTION), F.lit(0)), one)


def root(tree: Column) -> Column:
    return F.sha2(F.array_join(F.transform(tree, lambda s: s["digest"]), ""), 256)


def leaves(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p)))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets of leaves."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Digests of the paragraphs of tree a that tree b lacks, in order; sections that agree are skipped."""
    known = F.transform(b, lambda s: s["digest"])
    mine = F.flatten(F.transform(F.filter(a, lambda s: ~F.array_contains(known, s["digest"])), lambda s: s["paragraphs"]))
    return F.array_except(mine, F.flatten(F.transform(b, lambda s: s["paragraphs"])))


def fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with sections, fingerprint (the root) and leaves."""
    names = []
    for wish in ("sections", "fingerprint", "leaves"):
        names.append(distinct_name([*df.columns, *names], wish))
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn(names[0], sections(whole)).withColumn(names[1], root(F.col(names[0]))).withColumn(names[2], leaves(whole))


def with_next(df: DataFrame, doc_id: str, carried: dict[str, str], text: str = "text") -> DataFrame:
    """``df`` with columns of the next row by descending id (after the last, the first): {column: new name}.

    Rows are dealt to groups by ranges of the id; each group also gets the first row of the group that
    follows, so one shuffle and one sort in each group do.  Only group bounds and ends reach the driver.
    """
    group = distinct_name([*df.columns, *carried.values()], "group")
    guest = distinct_name([*df.columns, *carried.values(), group], "guest")
    n = df.count()
    groups = max(1, min(MAX_GROUPS, -(-n // GROUP)))
    bounds = df.agg(F.percentile_approx(F.col(doc_id), [i / groups for i in range(1, groups)] or [0.5], 100_000)).first()[0] or []
    cuts = sorted(set(bounds)) if groups > 1 else []
    step = max(1, int(len(cuts) ** 0.5))
    fine = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    # The number of bounds below the id, in two steps: whole runs of bounds, then inside the next run.
    coarse = F.size(F.filter(F.array(*(F.lit(r[-1]) for r in fine)), lambda b: b < F.col(doc_id))) if fine else F.lit(0)
    place = sum((F.when(coarse == i, F.lit(i * step) + F.size(F.filter(F.array(*map(F.lit, r)), lambda b: b < F.col(doc_id)))).otherwise(0) for i, r in enumerate(fine)), F.when(coarse == len(fine), F.lit(len(cuts))).otherwise(0)) if fine else F.lit(0)
    dealt = df.withColumn(group, F.when(F.col(doc_id).isNull(), -1).otherwise(place))
    ends = sorted((r[0], r["first"]) for r in dealt.groupBy(group).agg(F.max(doc_id).alias("first")).collect())  # MAX_GROUPS + 1 rows at most
    follows = {g: ends[i - 1] for i, (g, _) in enumerate(ends)}  # the group below; below the lowest, the highest
    pairs = [(g, first) for g, (_, first) in follows.items()]
    guests = df.sparkSession.createDataFrame(pairs or [(0, None)], "to int, first long")
    invited = df.join(F.broadcast(guests), df[doc_id].cast("long").eqNullSafe(guests["first"])).select(*(df[c] for c in df.columns), guests["to"].alias(group))
    both = dealt.withColumn(guest, F.lit(False)).unionByName(invited.withColumn(guest, F.lit(True)))
    order = Window.partitionBy(group).orderBy(guest, F.col(doc_id).desc(), text)
    return both.select("*", *(F.lead(c).over(order).alias(new) for c, new in carried.items())).where(~F.col(guest)).drop(group, guest)


def op4_merkle(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(docs.withColumn("leaves", leaves(F.col("text"))), "doc_id", {"text": "next_text", "leaves": "next_leaves"})
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    out = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    return out.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        root(sections(F.col("text"))).alias("fingerprint"), root(sections(F.col("edited"))).alias("edited_fingerprint"),
        likeness(F.col("leaves"), leaves(F.col("edited"))).alias("near_edited"), likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
    )


QUERIES = {"op4_merkle": op4_merkle}


def _sql_root(x: str) -> str:
    return rf"sha256(coalesce(list_aggregate(list_transform(regexp_extract_all({x}, '(?s).+?(?:\n\n+|\z)'), lambda s: sha256(list_aggregate(list_transform(regexp_extract_all(s, '[^\n]*\n|[^\n]+'), lambda p: sha256(p)), 'string_agg', ''))), 'string_agg', ''), ''))"


def _sql_leaves(x: str) -> str:
    return rf"list_distinct(regexp_extract_all({x}, '[^ \t\n\r\f\v]+(?:[ \t\r\f\v]+[^ \t\n\r\f\v]+){{0,3}}'))"


SQL = {
    "op4_merkle": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lead(coalesce(text, '')) OVER w AS following,
                  first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC, coalesce(text, '')) AS top
           FROM documents WINDOW w AS (ORDER BY doc_id DESC, coalesce(text, ''))),
n AS (SELECT doc_id, text, coalesce(following, top) AS nxt FROM d),
e AS (SELECT *, left(text, length(text) - length(text) // 3) || left(nxt, length(text) // 3) AS edited FROM n),
l AS (SELECT *, {_sql_leaves('text')} AS a, {_sql_leaves('edited')} AS b, {_sql_leaves('nxt')} AS c FROM e)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, {_sql_root('text')} AS fingerprint, {_sql_root('edited')} AS edited_fingerprint,
       CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END::DOUBLE AS near_edited,
       CASE WHEN len(a) + len(c) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(a, c)) / (len(a) + len(c)) END::DOUBLE AS near_next
FROM l""",
}
