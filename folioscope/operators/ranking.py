"""Ranks inside strata of any size: no window partition holds a stratum.

Rows are range-partitioned by stratum and order, so a stratum that holds a third of the table lies in many partitions. A
row's rank is its index in the sorted partition, less that of its stratum's first row there, plus the rows of the stratum
in earlier partitions. Only one row a partition and stratum enters the sums over partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import cut_lineage

_BITS = 33  # fixed value: bits of the row index in a monotonically increasing id


def ranked_rows(df: DataFrame, strata: Sequence[str], order: Sequence[str | Column], rank: str = "rank", size: str | None = None) -> DataFrame:
    """``df`` with the rank from 0 in its stratum by ``order``, and with the size of the stratum where a name is given.

    Null strata are strata of their own; without strata the whole table is one. Rows equal in ``order`` have different ranks in
    no fixed order, so order by a key. An empty table gives an empty result.
    """
    keyed = df.select("*", *[(F.col(o) if isinstance(o, str) else o).alias(f"_o{k}") for k, o in enumerate(order)])
    keys = [*strata, *[f"_o{k}" for k in range(len(order))]]
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).drop(*keys[len(strata) :])
    placed = cut_lineage(placed)  # the ranges are drawn once
    part = F.shiftrightunsigned("_at", _BITS).alias("_part")
    stats = placed.groupBy(*strata, part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    over = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))  # at most one row a partition in each
    before = F.sum("_n").over(over.orderBy("_part")) - F.col("_n")
    stats = cut_lineage(stats.select(*[F.col(s).alias(f"_s{k}") for k, s in enumerate(strata)], "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(over).alias("_size")))
    on = [placed[s].eqNullSafe(stats[f"_s{k}"]) for k, s in enumerate(strata)] + [F.shiftrightunsigned(placed["_at"], _BITS) == stats["_part"]]
    joined = placed.join(stats, on)
    return joined.select(*[placed[c] for c in df.columns], (F.col("_at") + F.col("_shift")).alias(rank), *([F.col("_size").alias(size)] if size else []))
