"""Saving and loading: models and results are folders of Parquet tables with one JSON record of parameters."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F


def save_tables(path: str, tables: dict[str, DataFrame], params: dict[str, Any], spark: SparkSession, mode: str = "overwrite") -> None:
    """Write each table to path/name and the parameters, as JSON, to path/params."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")
    listed = json.dumps({"tables": sorted(tables), "params": params}, sort_keys=True)
    spark.range(1).select(F.lit(listed).alias("json")).coalesce(1).write.mode(mode).parquet(f"{path}/params")


def load_tables(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    """What save_tables wrote."""
    found = json.loads(spark.read.parquet(f"{path}/params").first()["json"])
    return {name: spark.read.parquet(f"{path}/{name}") for name in found["tables"]}, found["params"]


def save_results(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Results sorted within files by time, so that time ranges prune row groups."""
    order = [c for c in ("t_idx", "t") if c in df.columns]
    out = df.sortWithinPartitions(*order) if order else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
