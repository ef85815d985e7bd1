"""Writing derived tables and reading them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from aislewise.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str, mode: str, partition_by: tuple[str, ...]) -> DataFrame:
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Append rows as they are and return the whole table."""
    return _write(df, path, "append", partition_by)


def replace_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Replace the table (only touched partitions when it is partitioned) and read it back."""
    return _write(df, path, "overwrite", partition_by)


def export_csv(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)
