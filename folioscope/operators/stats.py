"""Counts, entropies, mutual information and other aggregates. Every statistic is two levels of combinable aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_words(tokens: DataFrame, k: int, order: Sequence[str], column: str = "word", by: Sequence[str] = ()) -> DataFrame:
    """The k most frequent values (of each group), ties by first occurrence in ``order``."""
    counts = tokens.groupBy(*by, column).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    if by:
        w = Window.partitionBy(*by).orderBy(F.desc("n"), "first")
        return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return counts.orderBy(F.desc("n"), "first").limit(k)


def entropy(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Shannon entropy in bits: log2 N - sum n log2 n / N, from counts alone."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    total = F.sum("n")
    return counts.groupBy(*by).agg(total.alias("total"), F.count("*").alias("types"), (F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("entropy"))


def _log_sum(counts: DataFrame, by: Sequence[str], keys: Sequence[str], name: str) -> DataFrame:
    marginal = counts.groupBy(*by, *keys).agg(F.sum("n").alias("n"))
    return marginal.groupBy(*by).agg(F.sum(F.col("n") * F.log2("n")).alias(name), F.sum("n").alias("total_" + name))


def _beside(parts: list[DataFrame], by: Sequence[str]) -> DataFrame:
    """Joins results of one row a group; without groups each is a single row."""
    join = lambda a, b: a.join(b, list(by)) if by else a.crossJoin(F.broadcast(b))
    return reduce(join, parts)


def mutual_information(df: DataFrame, x: str, y: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Mutual information in bits of two columns: (sum over joint - over x - over y of n log2 n) / N + log2 N.

    No window over a value, so a value in a third of the rows makes no heavy task. No pairs give 0. ``weight``: multiplicity of a row.
    """
    joint = df.groupBy(*by, x, y).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    parts = _beside([_log_sum(joint, by, (x, y), "xy"), _log_sum(joint, by, (x,), "x"), _log_sum(joint, by, (y,), "y")], by)
    n = F.col("total_xy")
    mi = F.coalesce((F.col("xy") - F.col("x") - F.col("y")) / n + F.log2(n), F.lit(0.0))
    return parts.select(*by, F.coalesce(n, F.lit(0)).alias("pairs"), mi.alias("mi"))


def conditional_entropy(df: DataFrame, context: Sequence[str], symbol: str, by: Sequence[str] = ()) -> DataFrame:
    """Entropy of a symbol given its context: (sum over contexts - over context and symbol of n log2 n) / N."""
    joint = df.groupBy(*by, *context, symbol).agg(F.count("*").alias("n"))
    parts = _beside([_log_sum(joint, by, (*context, symbol), "cs"), _log_sum(joint, by, tuple(context), "c")], by)
    return parts.select(*by, F.col("total_cs").alias("events"), ((F.col("c") - F.col("cs")) / F.col("total_cs")).alias("entropy"))


def adjacency_rates(tokens: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of neighbours in a line, the share of repeats and the share one edit apart."""
    from folioscope.functions.text import within_one_edit

    pairs = tokens.where("prev_word is not null")
    counts = pairs.groupBy(*by, "prev_word", "word").agg(F.count("*").alias("n"))  # edit distance once a distinct pair
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n")
    return counts.groupBy(*by).agg(F.sum("n").alias("pairs"), share(F.col("prev_word") == F.col("word")).alias("exact_rate"), share(within_one_edit(F.col("prev_word"), F.col("word"))).alias("edit1_rate"))


def ngrams(words: Column, n: int) -> Column:
    """All runs of n neighbours of an array, joined by a space."""
    last = F.size(words) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def ngram_rows(df: DataFrame, words: str, orders: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(by, ord, ngram) of each order."""
    each = F.array(*[F.struct(F.lit(k).alias("ord"), ngrams(F.col(words), k).alias("g")) for k in orders])
    return df.select(*by, F.inline(each)).select(*by, "ord", F.explode("g").alias("ngram"))


def repeated_ngram_rates(df: DataFrame, words: str, orders: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Share of n-gram instances whose type occurs at least twice."""
    counts = ngram_rows(df, words, orders, by).groupBy(*by, "ord", "ngram").agg(F.count("*").alias("n"))
    return counts.groupBy(*by, "ord").agg(F.sum("n").alias("instances"), (F.sum(F.when(F.col("n") >= 2, F.col("n")).otherwise(0)) / F.sum("n")).alias("rate"))


def sequence_summary(tokens: DataFrame, sequence: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sequences, tokens, types, words seen once, entropy and the share of the most frequent word."""
    counts = tokens.groupBy(*by, "word").agg(F.count("*").alias("n"))
    words = counts.groupBy(*by).agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("hapax"), (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"), F.max_by("word", F.struct("n", F.col("word"))).alias("top_word"), (F.max("n") / F.sum("n")).alias("top_share"))
    sequences = tokens.select(*by, *sequence).distinct().groupBy(*by).agg(F.count("*").alias("sequences"))
    return _beside([words, sequences], by)


def distribution(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    counts = df.groupBy(*by, key).agg(F.count("*").alias("n"))
    total = df.groupBy(*by).agg(F.count("*").alias("all"))
    joined = counts.join(F.broadcast(total), list(by)) if by else counts.crossJoin(F.broadcast(total))
    return joined.select(*by, key, (F.col("n") / F.col("all")).alias("p"))
