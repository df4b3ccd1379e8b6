"""Readers of logs, language files in many encodings, and reference corpora."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import text


def training_log(lines: DataFrame) -> DataFrame:
    """(kind, at, loss, held_out) of the lines (value) that report an iteration or a step; other lines give none."""
    number = lambda pattern: F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).cast("double")
    rows = lines.where(F.col("value").rlike(r"^(?:iter|step) \d+:"))
    return rows.select(F.regexp_extract("value", "^(iter|step)", 1).alias("kind"), F.regexp_extract("value", r"^(?:iter|step) (\d+):", 1).cast("int").alias("at"), number(r"(?:train )?loss ([0-9.]+[0-9])").alias("loss"), number(r"val loss ([0-9.]+[0-9])").alias("held_out"))


def language_files(spark: SparkSession, folder: str, encodings: Mapping[str, str], priority: Mapping[str, int], least_words: int = 1000) -> DataFrame:
    """(language, file, words) of a folder of text files ``<language>-<rest>.<suffix>``: decoded by suffix, files that don't decode or have
    too few words left out; of several files of a language the one of highest (priority, name) stays.

    ``encodings`` names the encoding of each suffix, ``priority`` its weight. Files are read in the tasks, so any file system will do.
    """
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.regexp_extract(name, r"\.([^.]+)$", 1)
    charset = F.create_map(*[F.lit(x) for kv in encodings.items() for x in kv])[suffix]
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])[suffix], F.lit(0))
    rows = files.select(name.alias("file"), F.regexp_extract(name, r"^([^-.]+)", 1).alias("language"), weight.alias("weight"), charset.alias("charset"), "content").where("charset is not null")
    rows = rows.select("file", "language", "weight", decoded("content", "charset").alias("t")).where("t is not null").select("file", "language", "weight", text.unmarked_words(F.col("t")).alias("words")).where(F.size("words") >= least_words)
    return rows.groupBy("language").agg(F.max_by(F.struct("file", "words"), F.struct("weight", "file")).alias("b")).select("language", "b.file", "b.words")


@F.pandas_udf(T.StringType())
def decoded(content, charset):
    """Text of bytes in a named encoding, null where they don't decode."""
    import pandas as pd

    def one(data: bytes, name: str) -> str | None:
        try:
            return bytes(data).decode(name)
        except (UnicodeDecodeError, LookupError):
            return None

    return pd.Series([one(c, n) for c, n in zip(content, charset)], dtype=object)


def comparison_corpora(spark: SparkSession, folder: str, metadata: DataFrame | None = None, units: int | None = None, family: str = "unknown") -> DataFrame:
    """(name, family, words) of the text files of a folder: hidden files, tables and files that aren't UTF-8 are passed over, the family comes from ``metadata``
    (name, family) by the file's stem, else it is ``family``; words stop after the one that crosses ``units``."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.where(~name.startswith(".") & ~name.rlike(r"\.(csv|xlsx)$")).select(F.regexp_replace(name, r"\.[^.]+$", "").alias("name"), decoded("content", F.lit("utf-8")).alias("t")).where("t is not null")
    rows = kept.select("name", text.letter_mark_words(F.col("t")).alias("words"))
    if units is not None:
        rows = rows.withColumn("words", within_units(F.col("words"), units))
    if metadata is None:
        return rows.select("name", F.lit(family).alias("family"), "words")
    return rows.join(metadata.select("name", F.col("family").alias("f")), "name", "left").select("name", F.coalesce("f", F.lit(family)).alias("family"), "words")


def within_units(words: Column, units: int) -> Column:
    """The first words up to the one with which letters and boundaries cross ``units``."""
    step = lambda s, w: F.when(s["u"] < units, F.struct((s["n"] + 1).alias("n"), (s["u"] + F.length(w) + 1).alias("u"))).otherwise(s)
    return F.slice(words, F.lit(1), F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit(0).alias("u")), step)["n"])
