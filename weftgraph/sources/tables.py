"""Readers of the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table `name` of `sf_dir`, pruned to `columns` (all when none is named)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def small(df: DataFrame, limit: int) -> DataFrame:
    """A broadcast hint for df if it has at most `limit` rows, else df as it is (a shuffled join then serves)."""
    n = df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df
