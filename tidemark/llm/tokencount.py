"""Token counts by offset-mapped attribution.

A document is encoded once and whole, so no token is counted twice or cut at a section's edge as it would be
if sections were encoded alone.  Tokens carry character spans (a token that starts inside a multi-byte
character spans that character), the spans are joined to the document's sections by position, and a token
that crosses an edge goes by an explicit rule:

* ``start``: to the section with its first character (the default);
* ``majority``: to the section with most of its characters, the earlier one on a tie;
* ``split``: to each section by its share of the characters.

Sections are the lines of a text (each with its line break), or the fields of a row, joined in order.  Null
text is empty text: one section without tokens; null fields are empty sections.  Repeated rows are counted
each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .bpe import _compiled, default_path, load
from .common import arrow_bounds, distinct_name, read

RULES = ("start", "majority", "split")


def token_spans(ids: np.ndarray, text: str, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last character of each token."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters that begin before each byte
    ends = np.cumsum(widths[ids])
    starts = ends - widths[ids]
    return chars[np.minimum(starts + 1, len(raw))] - 1, chars[ends]


def attribute(first: np.ndarray, last: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section; section i is [edges[i], edges[i + 1]); crossing ones count where they begin."""
    n = len(edges) - 1
    a = np.searchsorted(edges, first, side="right") - 1
    b = np.searchsorted(edges, np.maximum(last - 1, first), side="right") - 1
    crossing = np.bincount(a[a != b], minlength=n)
    if rule == "start":
        return np.bincount(a, minlength=n).astype(float), crossing
    out = np.bincount(a[a == b], minlength=n).astype(float)
    for i in np.flatnonzero(a != b).tolist():
        span = np.arange(a[i], b[i] + 1)
        share = np.minimum(edges[span + 1], last[i]) - np.maximum(edges[span], first[i])
        if rule == "majority":
            out[span[np.argmax(share)]] += 1
        else:
            out[span] += share / share.sum()
    return out, crossing


def _sections(parts: list[list[str]], kept: list, names: list[str], machine, widths, rule: str):
    rows, section, start, end, tokens, crossing = [], [], [], [], [], []
    for row, own in enumerate(parts):
        text = "".join(own)
        edges = np.cumsum([0, *map(len, own)])
        first, last = token_spans(machine.encode(text), text, widths)
        # Empty sections share an edge; the last of them is where searchsorted points, so tokens go to the one that has text.
        got, cross = attribute(first, last, edges, rule)
        rows.extend([row] * len(own))
        section.extend(range(len(own)))
        start.extend(edges[:-1].tolist())
        end.extend(edges[1:].tolist())
        tokens.extend(got.tolist())
        crossing.extend(cross.tolist())
    pick = pa.array(rows, pa.int64())
    made = [pa.array(section, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(tokens, pa.float64()), pa.array(crossing, pa.int64())]
    return pa.RecordBatch.from_arrays([*(c.take(pick) for c in kept), *made], names=names)


def token_counts(df: DataFrame, keep: list[str], text: str | None = "text", fields: list[str] | None = None, rule: str = "start", path: str | None = None) -> DataFrame:
    """Rows of the columns ``keep`` with section, start_char, end_char, n_tokens (double), n_crossing.

    Give ``fields`` for one section a column; else the lines of ``text`` are the sections.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    arrow_bounds(df.sparkSession)
    spec = df.sparkSession.sparkContext.broadcast(load(path or default_path()))
    columns = fields or [text]
    added = []
    for wish in ("section", "start_char", "end_char", "n_tokens", "n_crossing"):
        added.append(distinct_name([*keep, *added], wish))
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.LongType())
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, k) for n, k in zip(added, kinds, strict=True))])
    names, n_keep = [*keep, *added], len(keep)

    def run(batches):
        machine = _compiled(*spec.value)
        widths = np.zeros(max(machine.label) + 1, np.int64)
        for i, b in machine.label.items():
            widths[i] = len(b)
        for batch in batches:
            values = [batch.column(n_keep + k).to_pylist() for k in range(len(columns))]
            parts = [[v or "" for v in row] for row in zip(*values, strict=True)] if fields else [_lines(t or "") for t in values[0]]
            kept = [batch.column(k) for k in range(n_keep)]
            for a in range(0, len(parts), 100):
                yield _sections(parts[a:a + 100], [c.slice(a, 100) for c in kept], names, machine, widths, rule)
        machine.rest()

    parts = []
    for _ in columns:  # read by place, but a clash of names would make them ambiguous
        parts.append(distinct_name([*keep, *parts], "__field"))
    return df.select(*keep, *(F.col(c).cast("string").alias(p) for c, p in zip(columns, parts, strict=True))).mapInArrow(run, schema)


def _lines(text: str) -> list[str]:
    """Lines with their line feed; a text that ends in one has no further line, and the empty text one."""
    out = text.split("\n")
    lines = [x + "\n" for x in out[:-1]] + ([out[-1]] if out[-1] else [])
    return lines or [""]


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = token_counts(docs, ["doc_id"])
    return out.select("doc_id", "section", "start_char", "end_char", F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing")


QUERIES = {"op6_token_counts": op6_token_counts}
SQL: dict[str, str] = {}
