"""Adapters from the star-schema tables to events, positions and marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str):
    """Seconds since 1970 of a timestamp without zone, to the microsecond."""
    zoneless = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))
    return zoneless / 1e6


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, unit, user_id, t, value): unit is the kind of event, value serves as 1-D position."""
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("unit"), "user_id", seconds("ts").alias("t"), "value")


def marks(spark: SparkSession, sf_dir: str, n: int = 2) -> DataFrame:
    """(vec_id, unit, m0, m1, ...): the first dimensions of the embeddings as marks."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("unit"), *(F.element_at("embedding", k + 1).cast("double").alias(f"m{k}") for k in range(n)))
