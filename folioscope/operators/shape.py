"""Word-shape distances between corpora, rankings and matched bootstraps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import text
from folioscope.operators import digests, resample
from folioscope.operators.ranking import ranked_rows
from folioscope.session import cut_lineage


def shapes(words: DataFrame, keep: Sequence[str], grouped: bool = False) -> DataFrame:
    """(keep, len, pattern, n): counts of word shapes, patterns computed once a distinct word."""
    counts = words.groupBy(*keep, "word").agg(F.count("*").alias("n"))
    u = text.units(F.col("word"), grouped)
    return counts.withColumns({"len": F.size(u), "pattern": text.unit_pattern(u)}).groupBy(*keep, "len", "pattern").agg(F.sum("n").alias("n"))


def distances(targets: DataFrame, references: DataFrame, target: Sequence[str], reference: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Bhattacharyya distance of every target to every reference over shape counts; infinite without a common key."""
    one = lambda df, names: (df.groupBy(*names, *keys).agg(F.sum("n").alias("n")), df.groupBy(*names).agg(F.sum("n").alias("t")))
    (tc, tt), (rc, rt) = one(targets, target), one(references, reference)
    overlap = tc.withColumnRenamed("n", "a").join(rc.withColumnRenamed("n", "b"), list(keys)).groupBy(*target, *reference).agg(F.sum(F.sqrt(F.col("a").cast("double") * F.col("b"))).alias("s"))
    every = tt.withColumnRenamed("t", "ta").crossJoin(F.broadcast(rt.withColumnRenamed("t", "tb")))  # one row a group on either side
    joined = every.join(overlap, [*target, *reference], "left")
    c = F.col("s") / F.sqrt(F.col("ta").cast("double") * F.col("tb"))
    return joined.select(*target, *reference, F.when(c > 0, -F.ln(c)).otherwise(F.lit(float("inf"))).alias("distance"))


def conditional_distances(targets: DataFrame, references: DataFrame, target: Sequence[str], reference: Sequence[str]) -> DataFrame:
    """Distance of patterns given the target's mix of lengths: -ln sum_len p(len) sum_pattern sqrt(p q); a length the
    reference lacks adds nothing."""
    per = lambda df, names, n: df.join(df.groupBy(*names, "len").agg(F.sum("n").alias("l")), [*names, "len"]).select(*names, "len", "pattern", (F.col("n") / F.col("l")).alias(n), F.col("l").alias("l" + n))
    t, r = per(targets, target, "p"), per(references, reference, "q").drop("lq")
    total = targets.groupBy(*target).agg(F.sum("n").alias("t"))
    both = t.join(r, ["len", "pattern"]).join(total, list(target))
    return both.groupBy(*target, *reference).agg((-F.ln(F.sum(F.col("lp") / F.col("t") * F.sqrt(F.col("p") * F.col("q"))))).alias("distance"))


def ranked(df: DataFrame, target: Sequence[str], name: str) -> DataFrame:
    """Rank by distance, then name."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*target).orderBy("distance", name)))


def _pruning(count: Column, size: int, widen: int) -> Column:
    """The hex digits below which the hashes of ``size`` rows of ``count``, and some more, are expected; each widening doubles the share."""
    share = F.lit((size + 8 * size**0.5 + 64) * 2**widen) / count
    return F.when(share >= 1, "g").otherwise(F.lower(F.lpad(F.hex(F.floor(share * 2**48)), 12, "0")))


def _below_bound(rows: DataFrame, trials: int, seed: int) -> DataFrame:
    """``rows`` with trial and md5 (``_h``) of (seed, trial, ``_keys``) of each trial in which that is less than ``_below``.

    The first word of a digest leaves out nearly all rows; the others are hashed whole.
    """
    names = [c for c in rows.columns if c not in ("_below", "_keys")]
    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("trial", T.IntegerType()), T.StructField("_h", T.StringType())])
    prefixes = [f"{seed}|{t}|" for t in range(1, trials + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in digests.gathered(batches):
            keys, bound = table.column("_keys"), table.column("_below").dictionary_encode()
            bounds = bound.dictionary.to_pylist()
            code = bound.indices.to_numpy()
            most = np.array([0xFFFFFFFF if b == "g" else int(b[:8], 16) for b in bounds], dtype=np.uint32)[code]
            rows, trial, digest = [], [], []
            for k, at, first in digests.first_words(keys, prefixes):
                near = np.flatnonzero(first <= most[at : at + len(first)]) + at
                for j, key in zip(near.tolist(), keys.take(pa.array(near)).to_pylist()):
                    h = md5((prefixes[k] + key).encode()).hexdigest()
                    if h < bounds[code[j]]:
                        rows.append(j)
                        trial.append(k + 1)
                        digest.append(h)
            if rows:
                found = table.select(names).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*found.columns, pa.array(trial, pa.int32()), pa.array(digest, pa.string())], names=[*names, "trial", "_h"])

    return rows.mapInArrow(run, schema)


def sample_words(words: DataFrame, group: Sequence[str], size: int, trials: int, seed: int, order: Sequence[str]) -> DataFrame:
    """``size`` words of each group without replacement in every trial, the first in md5 order; smaller groups fall out.

    Every row is hashed in every trial, but only rows below a bound of their group are kept and ordered: the first ``size`` lie
    below it, or the bound is raised until they do, so the sample is that of the whole order. Groups are one row each. ``words`` is read
    twice.
    """
    counts = cut_lineage(words.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") >= size))
    keys = F.concat_ws("|", *[F.col(c).cast("string") for c in (*group, *order)])
    names = words.columns
    for widen in range(64):
        bound = counts.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], _pruning(F.col("_n"), size, widen).alias("_below"))
        on = [F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(group)]
        rows = words.join(F.broadcast(bound), on) if group else words.crossJoin(F.broadcast(bound))
        near = cut_lineage(_below_bound(rows.select(*names, "_below", keys.alias("_keys")), trials, seed))
        found = near.groupBy("trial", *group).agg(F.count("*").alias("_k")).where(F.col("_k") >= size).count()
        if found == trials * counts.count():
            break
    return ranked_rows(near, ["trial", *group], ["_h", *order], "_r").where(F.col("_r") < size).select(*names, "trial")


def pseudo_word(pattern: Column, key: Column) -> Column:
    """A word of the given pattern in fresh symbols, in an order that depends on ``key``: same multiplicities, other letters."""
    counts = F.transform(F.split(pattern, ","), lambda c: c.cast("int"))
    letters = F.flatten(F.transform(counts, lambda c, i: F.array_repeat(F.substring(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), i + 1, F.lit(1)), c)))
    mixed = F.array_sort(F.transform(letters, lambda x, i: F.struct(F.md5(F.concat_ws("|", key, i.cast("string"))).alias("h"), x.alias("x"))))
    return F.array_join(F.transform(mixed, lambda m: m["x"]), "")


def bootstrap_winners(words: DataFrame, references: DataFrame, group: Sequence[str], reference: str, size: int, trials: int, seed: int, order: Sequence[str], keys: Sequence[str] = ("len", "pattern")) -> DataFrame:
    """(group, reference, wins, top5): how often a reference is nearest, and among the five nearest, to a sample of the group."""
    sample = shapes(sample_words(words, group, size, trials, seed, order), ["trial", *group])
    d = distances(sample, references, ["trial", *group], [reference], keys)
    r = ranked(d.withColumn("distance", F.round("distance", 9)), ["trial", *group], reference)
    return r.groupBy(*group, reference).agg(F.count_if(F.col("rank") == 1).alias("wins"), F.count_if(F.col("rank") <= 5).alias("top5")).where("top5 > 0")

