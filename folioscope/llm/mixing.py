"""Mixing sources to target weights, by Sainte-Lague apportionment.

The total is cut into blocks of equal size, which go to the sources by the highest quotients share / (2 n + 1), never
more than a source can fill at its cap of uses. Each source's blocks are apportioned in the same way first over bundles of
shards and then, in a task a bundle, over the shards of the bundle. Shards are hash classes of about ``SHARD_ROWS`` records, so
that a source with a third of all records is many shards; the driver sees one sum a bundle of ``BUNDLE`` shards. A shard
uses all its records as often as its blocks allow and then, in a seeded order, once more those that fit into what is left.
"""

from __future__ import annotations

import heapq
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut_lineage

BLOCK_TOKENS = 64
SHARD_ROWS = 2_000
BUNDLE = 2_048


def sainte_lague(weights: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats for each party by highest quotients weight / (2 n + 1), at most ``caps``; earlier parties win ties.

    Seats that no divisor method would deny are given at once, the rest by quotient, so the work grows with
    parties, not seats. Fewer than ``seats`` are given where all caps are reached.
    """
    caps = list(caps) if caps is not None else [seats] * len(weights)
    given = [0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    left = min(seats, sum(caps[i] for i in open_))
    while open_ and left > 2 * len(open_):  # parties at their caps leave, the others share again
        total = sum(weights[i] for i in open_)
        most = {i: int((left + sum(given[j] for j in open_)) * weights[i] / total) - 1 for i in open_}
        capped = [i for i in open_ if most[i] >= caps[i]]
        for i in capped or open_:
            new = caps[i] if capped else max(given[i], most[i])
            left -= new - given[i]
            given[i] = new
        if not capped:
            break
        open_ = [i for i in open_ if i not in capped]
    heap = [(-weights[i] / (2 * given[i] + 1), i) for i in open_ if given[i] < caps[i]]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        given[i] += 1
        left -= 1
        if given[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * given[i] + 1), i))
    return given


def _select(shard: pd.DataFrame) -> pd.DataFrame:
    """Whole passes over the shard, then records in seeded order as long as they fit into what is left; records
    used less than the cap come again where larger ones don't fit."""
    shard = shard.sort_values(["turn", "id"])
    quota, whole, cap = (int(shard[c].iloc[0]) for c in ("quota", "all_tokens", "cap"))
    passes, left = divmod(quota, whole)
    sizes = shard["tokens"].to_numpy()
    least, uses = sizes.min(), np.full(len(sizes), passes)
    while left >= least:
        before = left
        for k, size in enumerate(sizes):
            if size <= left and uses[k] < cap:
                uses[k], left = uses[k] + 1, left - size
                if left < least:
                    break
        if left == before:
            break
    shard = shard.assign(repeats=uses)
    return shard.loc[shard["repeats"] > 0, ["id", "source", "tokens", "repeats"]]


def _apportion(block: int, cap_of: dict[str, int]):
    """Quotas of the shards of one bundle (source, bundle, blocks, shard, all_tokens), at most BUNDLE rows."""

    def apportion(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        cap, sums = cap_of[pdf["source"].iloc[0]], [int(x) for x in pdf["all_tokens"]]
        own = sainte_lague([float(x) for x in sums], int(pdf["blocks"].iloc[0]), [cap * x // block for x in sums])
        return pd.DataFrame({"source": pdf["source"], "shard": pdf["shard"], "quota": [n * block for n in own], "all_tokens": sums, "cap": cap})

    return apportion


def mix(records: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 408, block: int = BLOCK_TOKENS, shard_rows: int = SHARD_ROWS, bundle: int = BUNDLE) -> tuple[DataFrame, DataFrame]:
    """The chosen records (id, source, tokens, repeats) and a report (source, target_share, max_repeats, available,
    quota, reached, reached_share).

    ``records`` has (id long, source string, tokens long), each id once; ``targets`` (source, target_share, max_repeats). Without
    ``total_tokens`` the total is the largest at which every source that has records reaches its share; absent sources fall out and
    the others keep their proportions. With it, sources too small for their share give what they can and the others
    make up for it. Records of other or null sources, without an id or without tokens aren't used. Targets with a null source, a share or
    a cap that isn't positive get nothing; repeated sources are an error. Empty tables give empty choices. The table
    of targets is small by definition: it and one sum for each ``bundle`` x ``shard_rows`` records are collected.
    """
    wanted = targets.select("source", "target_share", "max_repeats").collect()
    if len({r.source for r in wanted}) != len(wanted):
        raise ValueError("a source has more than one target")
    wanted = sorted((r for r in wanted if r.source is not None), key=lambda r: r.source)
    names = [r.source for r in wanted]
    used = cut_lineage(records.where(F.col("id").isNotNull() & (F.col("tokens") > 0) & F.col("source").isin(names)).select("id", "source", F.col("tokens").cast("long").alias("tokens")))
    rows = {r[0]: r[1] for r in used.groupBy("source").count().collect()}
    shards = {s: ceil(n / shard_rows) for s, n in rows.items()}
    of_source = F.create_map(*[F.lit(x) for kv in shards.items() for x in kv])[F.col("source")] if shards else F.lit(1)
    used = used.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "id"), of_source.cast("long")))
    by_shard = cut_lineage(used.groupBy("source", "shard").agg(F.sum("tokens").alias("all_tokens")).withColumn("bundle", F.floor(F.col("shard") / bundle)))
    sums: dict[str, dict[int, int]] = {s: {} for s in names}
    for r in by_shard.groupBy("source", "bundle").agg(F.sum("all_tokens").alias("t")).collect():
        sums[r.source][r.bundle] = r.t
    available = {s: sum(sums[s].values()) for s in names}
    share = {r.source: r.target_share if (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0 and available[r.source] else 0.0 for r in wanted}
    room = {r.source: available[r.source] * max(r.max_repeats or 0, 0) for r in wanted}
    if total_tokens is None:
        all_shares = sum(share.values())
        total_tokens = int(min((room[s] * all_shares / share[s] for s in names if share[s]), default=0))
    blocks = sainte_lague([share[s] for s in names], total_tokens // block, [room[s] // block for s in names])
    quota, cap = dict(zip(names, blocks)), {r.source: r.max_repeats or 0 for r in wanted}
    plan = []
    for s in names:
        keys = sorted(sums[s])
        own = sainte_lague([float(sums[s][k]) for k in keys], quota[s], [cap[s] * sums[s][k] // block for k in keys])
        plan += [(s, k, int(n)) for k, n in zip(keys, own)]
    spark = records.sparkSession
    bundles = spark.createDataFrame(plan, "source string, bundle long, blocks long")  # one row for bundle x shard_rows records
    quotas = cut_lineage(by_shard.join(F.broadcast(bundles), ["source", "bundle"]).groupBy("source", "bundle").applyInPandas(_apportion(block, cap), "source string, shard long, quota long, all_tokens long, cap int"))
    joined = used.join(quotas, ["source", "shard"]).withColumn("turn", F.xxhash64(F.lit(seed), F.lit("order"), "id"))
    chosen = joined.groupBy("source", "shard").applyInPandas(_select, "id long, source string, tokens long, repeats int")
    goals = spark.createDataFrame([(r.source, float(r.target_share or 0), int(r.max_repeats or 0), available[r.source], quota[r.source] * block) for r in wanted], "source string, target_share double, max_repeats int, available long, quota long")
    reached = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("reached"))
    report = goals.join(reached, "source", "left").fillna(0, ["reached"])
    whole = report.agg(F.sum("reached").alias("whole"))
    report = report.crossJoin(F.broadcast(whole)).withColumn("reached_share", F.when(F.col("whole") > 0, F.col("reached") / F.col("whole")).otherwise(0.0)).drop("whole")
    return chosen, report
