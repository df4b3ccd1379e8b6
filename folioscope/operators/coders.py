"""Held-out and online coders over symbol streams, in closed form: count once, subtract what is held out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.text import BOS, EOW, SEP

PLACES = 500_000  # fixed value: symbols that one call of the online coder counts at a time


def context_column(stream: Column, pos: Column, order: int) -> Column:
    """The ``order`` symbols before index ``pos`` (from 0) of an array, joined; shorter near the start."""
    return F.array_join(F.slice(stream, F.greatest(pos - order + 1, F.lit(1)), F.least(F.lit(order), pos)), SEP)


def ngram_events(streams: DataFrame, column: str, order: int, keep: Sequence[str]) -> DataFrame:
    """(keep, ctx, sym) of every symbol with a whole context of its own stream."""
    rows = streams.select(*keep, F.col(column).alias("_s"), F.posexplode(column).alias("_pos", "sym")).where(F.col("_pos") >= order)
    return rows.select(*keep, context_column(F.col("_s"), F.col("_pos"), order).alias("ctx"), "sym")


def leave_group_out_bits(streams: DataFrame, column: str, group: str, order: int = 5, alpha: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """Average bits a symbol when each group is coded by additive n-gram counts of all the other groups.

    The counts of a training set are those of the whole less those of the group, so nothing is counted twice. The
    alphabet holds the symbols of all streams. ``by`` are corpora coded apart, such as permutations.
    """
    events = ngram_events(streams, column, order, [*by, group])
    alphabet = streams.select(*by, F.explode(F.array_distinct(column)).alias("s")).distinct().groupBy(*by).agg(F.count("*").alias("v"))
    own = events.groupBy(*by, group, "ctx", "sym").agg(F.count("*").alias("n"))
    symbol = own.groupBy(*by, "ctx", "sym").agg(F.sum("n").alias("all_n"))
    context = own.groupBy(*by, "ctx").agg(F.sum("n").alias("all_c"))
    held = own.groupBy(*by, group, "ctx").agg(F.sum("n").alias("own_c"))
    rows = own.join(symbol, [*by, "ctx", "sym"]).join(held, [*by, group, "ctx"]).join(context, [*by, "ctx"])
    rows = rows.join(F.broadcast(alphabet), list(by)) if by else rows.crossJoin(F.broadcast(alphabet))
    p = (F.col("all_n") - F.col("n") + alpha) / (F.col("all_c") - F.col("own_c") + F.lit(alpha) * F.col("v"))
    return rows.groupBy(*by).agg(F.sum("n").alias("events"), (-F.sum(F.col("n") * F.log2(p)) / F.sum("n")).alias("bits"))


def word_events(words: DataFrame, units: str, order: int, keep: Sequence[str]) -> DataFrame:
    """(keep, ctx, sym) of every unit and the end mark of each word, contexts padded at the word's beginning."""
    padded = F.concat(F.array_repeat(F.lit(BOS), order), F.col(units), F.array(F.lit(EOW)))
    rows = words.select(*keep, padded.alias("_s")).select(*keep, "_s", F.posexplode("_s").alias("_pos", "sym")).where(F.col("_pos") >= order)
    return rows.select(*keep, F.array_join(F.slice("_s", F.col("_pos") - order + 1, F.lit(order)), SEP).alias("ctx"), "sym")


def channel_model_bits(words: DataFrame, units: str, fold: str, channel: Sequence[str], order: int = 2, alpha: float = 0.1, weight: float = 0.8) -> DataFrame:
    """(fold, units, pooled_bits, channel_bits): held-out bits of each fold under n-gram word models of the other folds.

    The channel model is ``weight`` times the model of the word's channel plus the rest of the pooled one; a channel unseen in training
    is pooled alone. The alphabet holds the units of all folds and the end mark.
    """
    events = word_events(words, units, order, [fold, *channel])
    own = events.groupBy(fold, *channel, "ctx", "sym").agg(F.count("*").alias("n"))
    size = own.agg(F.count_distinct("sym").alias("v"))

    def totals(keys: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
        part = own.groupBy(fold, *keys).agg(F.sum("n").alias("o_" + name))
        return part.groupBy(*keys).agg(F.sum("o_" + name).alias("a_" + name)) if keys else part.agg(F.sum("o_" + name).alias("a_" + name)), part

    rows = own
    for keys, name in ((["ctx", "sym"], "ps"), (["ctx"], "pc"), ([*channel, "ctx", "sym"], "cs"), ([*channel, "ctx"], "cc"), (list(channel), "ch")):
        whole, part = totals(keys, name)
        rows = rows.join(whole, keys).join(part, [fold, *keys])
        rows = rows.withColumn(name, F.col("a_" + name) - F.col("o_" + name)).drop("a_" + name, "o_" + name)
    rows = rows.crossJoin(F.broadcast(size))
    prob = lambda n, c: (F.col(n) + alpha) / (F.col(c) + F.lit(alpha) * F.col("v"))
    pooled = prob("ps", "pc")
    mixed = F.when(F.col("ch") > 0, weight * prob("cs", "cc") + (1 - weight) * pooled).otherwise(pooled)
    bits = lambda p: -F.sum(F.col("n") * F.log2(p)) / F.sum("n")
    return rows.groupBy(fold).agg(F.sum("n").alias("units"), bits(pooled).alias("pooled_bits"), bits(mixed).alias("channel_bits"))


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A dense number of each key, and how often the key stood before it."""
    order = np.argsort(keys, kind="stable")
    placed = keys[order]
    new = np.concatenate([[True], placed[1:] != placed[:-1]])
    group, at = np.cumsum(new) - 1, np.arange(len(keys))
    number, seen = np.empty(len(keys), dtype=np.int64), np.empty(len(keys), dtype=np.int64)
    number[order], seen[order] = group, at - at[new][group]
    return number, seen


def online_sums(sizes: np.ndarray, codes: np.ndarray, max_order: int, concentration: float) -> tuple[np.ndarray, np.ndarray]:
    """(alphabet sizes, log2 probabilities of each stream under each order) of streams that stand one after the other in ``codes``.

    Earlier uses of a context are those of its last symbol after the rest of it, one place before: one ranking serves an order.
    """
    starts = np.cumsum(sizes) - sizes
    stream, pos = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(codes)) - np.repeat(starts, sizes)
    width = int(codes.max()) + 1
    number, seen = _ranks(stream * width + codes)
    alphabet = np.bincount(stream, weights=seen == 0, minlength=len(sizes)).astype(np.int64)
    p = (seen + 0.5) / (pos + 0.5 * alphabet[stream])
    sums = [np.bincount(stream, weights=np.log2(p), minlength=len(sizes))]
    at, before = np.arange(len(codes)), seen
    for k in range(1, max_order + 1):
        at_k = at[pos[at] >= k]
        if len(at_k):
            place = np.empty(len(codes), dtype=np.int64)
            place[at] = np.arange(len(at))
            last = place[at_k - 1]  # the symbol before, as it stood in its own context
            context, used = number[last], before[last]
            number, before = _ranks(context * width + codes[at_k])
            p = p.copy()
            p[at_k] = (before + concentration * p[at_k]) / (used + concentration)
        at = at_k
        sums.append(np.bincount(stream, weights=np.log2(p), minlength=len(sizes)))
    return alphabet, np.stack(sums, axis=1)


def prequential(streams: DataFrame, column: str, stream: Sequence[str], max_order: int = 8, concentration: float = 2.0) -> DataFrame:
    """(stream, units, alphabet, bits, weights) of the online mixture over context orders 0 to ``max_order``.

    The order-0 predictor is the Krichevsky-Trofimov one; p_k = (n_k + c p_{k-1}) / (N_k + c); orders without a whole context copy
    the one below. With prior weights alike the code length is -log2 (sum_k 2^{S_k} / (K + 1)), S_k the log2
    probability of the stream under order k, so counts before each place are all that has to be ordered.

    A row holds one whole stream, so the counts are made where the row lies: no exchange, and no row for each place and order.
    Empty streams give no row.
    """
    fields = [streams.schema[c] for c in stream]
    schema = T.StructType([*fields, T.StructField("units", T.LongType()), T.StructField("alphabet", T.IntegerType()), T.StructField("_sums", T.ArrayType(T.DoubleType()))])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            array = batch.column(len(stream))
            length = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            total, first = np.cumsum(length), 0
            while first < batch.num_rows:  # slices of about PLACES symbols, one stream at least
                last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + PLACES, side="right")))
                part = batch.slice(first, last - first)
                kept = np.flatnonzero(length[first:last])
                first = last
                if not len(kept):
                    continue
                part = part.take(pa.array(kept))
                symbols = pc.list_flatten(part.column(len(stream)))
                codes = symbols.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = pc.list_value_length(part.column(len(stream))).to_numpy(zero_copy_only=False).astype(np.int64)
                alphabet, sums = online_sums(sizes, codes, max_order, concentration)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * (max_order + 1), pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(stream)], pa.array(sizes, pa.int64()), pa.array(alphabet, pa.int32()), lists], names=schema.names)

    sums = streams.select(*stream, column).mapInArrow(code, schema)
    top = F.array_max("_sums")
    powers = F.transform("_sums", lambda x: F.pow(F.lit(2.0), x - top))
    mass = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return sums.select(*stream, "units", "alphabet", (-(top + F.log2(mass / (max_order + 1)))).alias("bits"), F.transform(powers, lambda x: x / mass).alias("weights"))
