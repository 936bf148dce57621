"""Readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickloom.operators.splits import with_file_order


def read_table(spark: SparkSession, path: str, file_order: bool = False) -> DataFrame:
    """A Parquet file or a directory of them. ``file_order`` keeps file and row number for split and export."""
    df = spark.read.parquet(path)
    return with_file_order(df) if file_order else df


def row_cap(df: DataFrame, n: int) -> DataFrame:
    """Any ``n`` rows; the scan stops early. Use ``splits.first_rows`` for the first ones in file order."""
    return df.limit(n)


def by_label(df: DataFrame, value: int, label: str = "label_type") -> DataFrame:
    return df.filter(df[label] == value)
