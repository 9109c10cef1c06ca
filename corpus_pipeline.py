"""Corpus pipeline: STAGES applied in order to the documents table.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  All but the last return
the columns of documents; the last returns them without the text but with the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.bpe import encode
from tidemark.llm.common import read, stored
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.neardup import jaccard_join
from tidemark.llm.pii import pseudonymize, query_key
from tidemark.llm.quality import importance


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling selects."""
    return importance(docs, read(spark, sf_dir, "labels")).where("selected").select(*docs.columns)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class, once; of rows without id one of each text."""
    chosen = jaccard_join(docs.where("doc_id is not null").select("doc_id", "text")).where("doc_id = class_id").select("doc_id").distinct()
    kept = docs.join(chosen, "doc_id").select(*docs.columns)
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is not null and n > 1").select("doc_id")
    if not repeated.isEmpty():
        once = kept.join(repeated, "doc_id").dropDuplicates(["doc_id"]).select(*docs.columns)
        kept = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
    return kept.unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark")).where(F.size("hit_spans") == 0).select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; n_chars follows the text."""
    out = pseudonymize(docs, query_key(spark)).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the proof that they decode to it."""
    out = encode(docs, decoded="decoded")
    rest = [c for c in docs.columns if c != "text"]
    return out.select(*rest, "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("decodes"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_group),
    ("benchmark decontamination", drop_contaminated),
    ("PII surrogates", replace_personal_data),
    ("BPE encoding and decoding", tokenize),
]
#: Candidate groups, merges and permutations are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
