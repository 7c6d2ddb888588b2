"""Scans of the knowledge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of the folder, as Parquet."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(df: DataFrame, *keys: str) -> DataFrame:
    """Re-delivered rows count once: one row for each key."""
    return df.dropDuplicates(list(keys))


def project_slug(c: Column) -> Column:
    """The slug of a project written as name or slug, whatever its case and blanks; null stays null."""
    return F.regexp_replace(F.trim(F.lower(c)), r"[\s\-_]+", "-")
