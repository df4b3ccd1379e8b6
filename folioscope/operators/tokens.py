"""The token fact table: one row a word with its coordinates, strata and neighbours.

Pages hold their lines as nested arrays, so every neighbour within a line or page is read from the arrays; no
shuffle is needed to build the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text


def quire_letter(quire: Column) -> Column:
    """The letter of a quire in any notation, ``?`` where none is stated: the unit held out in folds."""
    found = F.regexp_extract(F.upper(quire), "([A-Z])-?[0-9]+", 1)
    return F.when(found != "", found).otherwise("?")


def pages(df: DataFrame) -> DataFrame:
    """(seq_id, currier, topic, fold, lines) with empty lines and null words dropped; pages without lines give none."""
    lines = F.filter(F.transform("lines", lambda ws: F.filter(ws, lambda w: w.isNotNull())), lambda ws: F.size(ws) > 0)
    return df.select("seq_id", F.coalesce("currier", F.lit("?")).alias("currier"), F.coalesce("topic", F.lit("?")).alias("topic"), quire_letter(F.coalesce("quire", F.lit(""))).alias("fold"), lines.alias("lines")).where(F.size("lines") > 0)


def line_rows(pages_df: DataFrame) -> DataFrame:
    return pages_df.select("seq_id", "currier", "topic", "fold", F.posexplode("lines").alias("ln", "ws"), "lines").select("*", F.size("ws").alias("n"), F.get("lines", F.col("ln") - 1).alias("prev_ws")).drop("lines")


def aligned_index(i: Column, n: Column, m: Column) -> Column:
    """Index into ``m`` words of the one whose normalised midpoint is nearest to that of word i of n; the first of ties."""
    half = F.lit(0.5)
    return F.array_min(F.transform(F.sequence(F.lit(0), m - 1), lambda c: F.struct(F.abs((c + half) / m - (i + half) / n).alias("d"), c.alias("c"))))["c"]


def token_rows(pages_df: DataFrame) -> DataFrame:
    """(seq_id, currier, topic, fold, ln, wi, n, word, prev_word, prev_ws, pl_idx, pl_word, position)."""
    rows = line_rows(pages_df).select("seq_id", "currier", "topic", "fold", "ln", "n", "ws", "prev_ws", F.posexplode("ws").alias("wi", "word"))
    rows = rows.withColumn("prev_word", F.get("ws", F.col("wi") - 1)).drop("ws")
    rows = rows.withColumn("pl_idx", F.when(F.size("prev_ws") > 0, aligned_index(F.col("wi"), F.col("n"), F.size("prev_ws"))))
    return rows.withColumn("pl_word", F.get("prev_ws", "pl_idx")).withColumn("position", text.line_position(F.col("wi"), F.col("n")))


def collapse(df: DataFrame, column: str, vocabulary: DataFrame, sentinel: str = text.OTHER) -> DataFrame:
    """``column`` with words outside the vocabulary (word) replaced; the vocabulary is a top-k table, so it is broadcast."""
    v = vocabulary.select(F.col("word").alias(column), F.lit(True).alias("_known"))
    return df.join(F.broadcast(v), column, "left").withColumn(column, F.when(F.col("_known"), F.col(column)).when(F.col(column).isNotNull(), sentinel)).drop("_known")
