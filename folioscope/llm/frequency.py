"""Frequency of every distinct term and n-gram, from a distributed suffix array.

How deep a suffix must be known is found by prefix doubling: round r names the runs of 2^r terms by the names of their
two halves, and only the places whose run stands twice or more go on, until none does. A suffix is then carried to a depth
above its longest repeat, so single runs cost little however long the records are. A range partitioning by (suffix,
record, position) and a sort within partitions give the suffix array in pieces; the position in the key splits a term that
makes up a third of all rows, or fills one record, over many pieces. In a piece the common prefixes of neighbours give
the intervals of suffixes that share their first d terms: the interval's size is the n-gram's occurrences, and its records
are its size less the duplicate adjacencies of one record in it. An interval that touches the end of a piece (an Arrow
batch) may go on in the next: it is passed on by record and closed by a shuffle of those rows only.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.session import cut_lineage


@F.pandas_udf(T.StringType())
def clean_term(values: pd.Series) -> pd.Series:
    """NFC, without spaces at the ends, lower case; null for null and empty values."""
    codes, distinct = pd.factorize(values)
    made = [unicodedata.normalize("NFC", x).strip(" ").lower() or None for x in distinct]
    return pd.Series(np.array([*made, None], object)[codes])


_OUT = pa.schema([("collection", pa.string()), ("ngram", pa.list_(pa.string())), ("record", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def _codes(x: pa.Array) -> np.ndarray:
    return x.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _intervals():
    def piece(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        collection, suffix, record = (batch.column(k) for k in range(3))
        n = len(record)
        order = int(pa.compute.max(suffix.value_lengths()).as_py())
        flat, sizes = _codes(suffix.flatten()), suffix.value_lengths().to_numpy(zero_copy_only=False)
        terms = np.full((n, order), -1, np.int64)
        terms[np.arange(order) < sizes[:, None]] = flat
        same = np.ones((n, order + 1), bool)
        same[:, 0] = np.append(False, np.diff(_codes(collection)) == 0)
        same[0] = False
        same[1:, 1:] = terms[1:] == terms[:-1]
        prefix = np.logical_and.accumulate(same, axis=1)  # prefix[i, d]: d terms in common with the row before
        records = _codes(record)
        for d in range(1, order + 1):
            interval = np.cumsum(~prefix[:, d])
            rows = np.flatnonzero(sizes >= d)
            rows = rows[np.lexsort((records[rows], interval[rows]))]
            if not len(rows):
                continue
            iv, rc = interval[rows], records[rows]
            new_iv = np.append(True, iv[1:] != iv[:-1])
            new_pair = new_iv | np.append(True, rc[1:] != rc[:-1])  # its complement: duplicate adjacencies of a record
            open_iv = (iv == interval[0]) | (iv == interval[-1])
            starts, pairs = np.flatnonzero(new_iv), np.flatnonzero(new_pair)
            size = np.diff(np.append(starts, len(rows)))
            duplicates = np.add.reduceat((~new_pair).astype(np.int64), starts)
            closed = ~open_iv[starts]
            yield made(batch, d, rows[starts[closed]], size[closed], (size - duplicates)[closed], None)
            part, count = open_iv[pairs], np.diff(np.append(pairs, len(rows)))
            yield made(batch, d, rows[pairs[part]], count[part], np.ones(part.sum(), np.int64), record)

    def made(batch: pa.RecordBatch, d: int, at: np.ndarray, size: np.ndarray, records: np.ndarray, record: pa.Array | None) -> pa.RecordBatch:
        take = pa.array(at)
        ngram = pa.compute.list_slice(batch.column(1).take(take), 0, d)
        ngram = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * d, pa.int32()), ngram.flatten().cast(pa.string()))
        of = record.take(take).cast(pa.string()) if record is not None else pa.nulls(len(at), pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0).take(take).cast(pa.string()), ngram, of, pa.array(size), pa.array(records)], schema=_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            if batch.num_rows:
                yield from piece(batch)

    return run


def suffix_counts(suffixes: DataFrame, order: int = 1, pieces: int | None = None) -> DataFrame:
    """(collection, n, ngram, occurrences, records) of every n-gram of 1 to ``order`` terms.

    ``suffixes`` has (collection string, record string, pos long, suffix array of up to ``order`` terms without
    nulls). A null collection or record counts as ''; empty suffixes count nothing; an empty table gives an empty result;
    repeated rows are repeated occurrences. ``n`` is the number of terms of ``ngram``. Other columns play no part.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    pieces = pieces or int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = suffixes.where(F.size("suffix") > 0).select(F.coalesce("collection", F.lit("")).alias("collection"), F.slice("suffix", 1, order).alias("suffix"), F.coalesce("record", F.lit("")).alias("record"), "pos")
    keys = ("collection", "suffix", "record", "pos")
    rows = cut_lineage(rows)  # drawing the ranges reads it once more
    ordered = rows.repartitionByRange(pieces, *keys).sortWithinPartitions(*keys).select("collection", "suffix", "record")
    parts = ordered.mapInArrow(_intervals(), "collection string, ngram array<string>, record string, occurrences long, records long")
    by_record = parts.groupBy("collection", "ngram", "record").agg(F.sum("occurrences").alias("occurrences"), F.max("records").alias("records"))
    total = by_record.groupBy("collection", "ngram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return total.select("collection", F.size("ngram").alias("n"), "ngram", "occurrences", "records")


def term_rows(records: DataFrame) -> DataFrame:
    """(collection, record, pos, term) of the elements of (collection, record, words). Values are cleaned (`clean_term`); null and
    empty ones are no terms, and no n-gram reads across them."""
    single = records.select("collection", "record", F.posexplode("words").alias("pos", "word"))
    return single.select("collection", "record", F.col("pos").cast("long").alias("pos"), clean_term("word").alias("term")).where("term is not null")


def repeat_depths(terms: DataFrame) -> tuple[DataFrame, int]:
    """(collection, record, pos, depth) of the places where a run of terms begins that stands elsewhere too, with a depth above the
    longest such run, and the greatest depth. Places not named have depth 1.

    ``terms`` has (collection, record, pos, term), each place once; runs are of successive ``pos``.
    """
    at = ["collection", "record", "pos"]
    names = terms.select(*at, F.xxhash64("term").alias("x"), F.xxhash64(F.lit("second lane"), "term").alias("y"))
    depth, found = 1, []
    while True:
        twice = names.groupBy("collection", "x", "y").agg(F.count("*").alias("n")).where("n > 1").select("collection", "x", "y")
        names = cut_lineage(names.join(twice, ["collection", "x", "y"], "left_semi").select(*at, "x", "y"))
        if names.isEmpty():
            break
        found.append(names.select(*at, F.lit(2 * depth).alias("depth")))
        after = names.select("collection", "record", (F.col("pos") - depth).alias("pos"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        names = names.join(after, at).select(*at, F.xxhash64(F.lit(depth), "x", "x2").alias("x"), F.xxhash64(F.lit(depth), "y", "y2").alias("y"))
        depth *= 2
    if not found:
        return terms.select(*at, F.lit(1).alias("depth")).limit(0), 1
    return cut_lineage(reduce(DataFrame.unionByName, found).groupBy(*at).agg(F.max("depth").alias("depth"))), depth


def deep_suffixes(terms: DataFrame, block: int = 1024) -> tuple[DataFrame, int]:
    """(collection, record, pos, suffix) of every place, to the depth that tells it from all others, and the greatest depth.

    Records are cut into blocks of at most ``block`` places (or the greatest depth, if more) with the places after them that their last
    suffixes reach, so a record of any length is many rows.
    """
    depths, deepest = repeat_depths(terms)
    size = max(block, deepest)
    at = ["collection", "record", "pos"]
    own = F.floor(F.col("pos") / size)
    rows = terms.join(depths, at, "left").select("collection", "record", "pos", "term", F.coalesce("depth", F.lit(1)).alias("depth"))
    homes = F.when((own > 0) & (F.col("pos") % size < deepest), F.array(own, own - 1)).otherwise(F.array(own))
    blocks = rows.select("collection", "record", F.explode(homes).alias("block"), F.struct("pos", "term", "depth").alias("t")).groupBy("collection", "record", "block").agg(F.array_sort(F.collect_list("t")).alias("t"))
    each = blocks.select("collection", "record", "block", "t", F.posexplode("t").alias("k", "own")).where(F.floor(F.col("own.pos") / size) == F.col("block"))
    ahead = F.slice("t", F.col("k") + 1, F.col("own.depth"))
    whole = F.filter(ahead, lambda x, i: x["pos"] == F.col("own.pos") + i)  # a place without a term ends the suffix: positions only grow
    return each.select("collection", "record", F.col("own.pos").alias("pos"), F.transform(whole, lambda x: x["term"]).alias("suffix")), deepest


def repeated_ngrams(terms: DataFrame) -> DataFrame:
    """(collection, n, ngram, occurrences, records) of every run of n >= 1 terms, of any length, that stands at least twice.

    All other runs stand once. ``terms`` has (collection, record, pos, term), each place once; null collections and records count
    as '', null terms are none. The work grows with the sum of the lengths of repeats. An empty table gives an empty result.
    """
    made = terms.where("term is not null").select(F.coalesce("collection", F.lit("")).alias("collection"), F.coalesce("record", F.lit("")).alias("record"), F.col("pos").cast("long").alias("pos"), "term")
    suffixes, deepest = deep_suffixes(cut_lineage(made))
    return suffix_counts(suffixes, deepest).where("occurrences > 1")


def mark_terms(counts: DataFrame, record_totals: DataFrame, min_records: int = 3, max_share: float = 0.1) -> DataFrame:
    """``counts`` with a verdict: 'rare' below ``min_records`` records, else 'common' above ``max_share`` of the
    collection's records (collection, total), else null. ``record_totals`` has one row a collection."""
    joined = counts.join(F.broadcast(record_totals), "collection", "left")
    verdict = F.when(F.col("records") < min_records, "rare").when(F.col("records") > max_share * F.col("total"), "common")
    return joined.withColumn("verdict", verdict).drop("total")
