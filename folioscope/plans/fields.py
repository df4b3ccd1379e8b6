"""Queries on fields that pack several values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.packed import split_packed
from folioscope.sources.tables import once, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    locus = once(table(spark, sf_dir, "locus"), "locus_no", "raw_text", "tokens", "certain_tokens")
    return split_packed(locus, "locus_no", ["raw_text"], ["tokens", "certain_tokens"]).select("locus_no", "field", F.col("pos").cast("int").alias("pos"), "value")


QUERIES = {"p3_found": p3_found}
ORACLE: dict[str, str] = {}
