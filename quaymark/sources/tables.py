"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as one DataFrame; a file and a folder of files read alike."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
