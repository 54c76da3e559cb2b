"""Parquet tables of one archive folder, read by name with column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class MissingColumns(ValueError):
    """A table lacks columns a query needs."""


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Read ``name`` from ``folder``, projected to ``columns`` when given.

    Extra columns in the file are ignored, so clashing names cannot reach a join.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if not columns:
        return df
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"{name} lacks {', '.join(missing)}")
    return df.select(*columns)
