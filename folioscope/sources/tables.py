"""Reading the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """One row per id with the columns asked for; rows without an id are dropped, they name no record.

    Redelivered rows repeat id and content and differ in arrival time only, so any copy serves; the
    projection comes first so that only the needed columns are shuffled.
    """
    return df.where(df[id_col].isNotNull()).select(id_col, *cols).dropDuplicates([id_col])
