"""Filling containers of fixed capacity, by hierarchical residual packing.

Items fall into groups by a hash, so that groups have like mixtures of sizes. Each group is packed by best fit, largest
first. After that at most one bin of a group is half full or less, for two such bins would have been one. Bins that
are nearly full, or whose room is below the smallest bin left anywhere, are done. The others go on as items, their members kept
together, in a tree: ``FAN_IN`` groups become one, which takes the emptiest bins of each, never more than ``group_items``
in all; bins that find no place in it are done as they stand. The tree ends in one group. All items are kept; what may
be lost is one merge for each bin that didn't go on.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut_lineage

GROUP_ITEMS = 2_000
NEARLY_FULL = 0.98
FAN_IN = 8

_BINS = "container_kind string, capacity int, container string, fill int, goes_on int, members array<struct<item:bigint,piece:int,size:int>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indexes; items come in the order given, each to the open bin with least room that holds it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: a bin with room r is open
    for k, size in enumerate(sizes):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(k)
        if room > size:
            by_room.setdefault(room - size, []).append(at)
            rooms |= 1 << (room - size)
    return bins


def _pack(round_no: int, keep: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, group, capacity = pdf["container_kind"].iloc[0], int(pdf["group"].iloc[0]), int(pdf["capacity"].iloc[0])
        rows = sorted(zip(pdf["fill"], pdf["container"], pdf["members"]), key=lambda r: (-r[0], r[1]))
        bins = best_fit([int(r[0]) for r in rows], capacity)
        fills = [sum(int(rows[k][0]) for k in b) for b in bins]
        on = {n for n in sorted(range(len(bins)), key=lambda n: (fills[n], n))[:keep] if fills[n] < capacity * NEARLY_FULL}
        made = [(kind, capacity, f"{kind}-{round_no}-{group}-{n}", fills[n], group if n in on else -1, [m for k in b for m in rows[k][2]]) for n, b in enumerate(bins)]
        return pd.DataFrame(made, columns=["container_kind", "capacity", "container", "fill", "goes_on", "members"])

    return pack


def pack(items: DataFrame, containers: DataFrame, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(container_kind, container, item, piece, place, start, size) for items (id long, size long) in containers of each
    kind (container_kind string, capacity_tokens int); once for each kind.

    An item stays whole unless it exceeds the capacity; then its first pieces fill containers of their own and the last is
    packed like other items. ``place`` counts from 0 in the container, ``start`` is where the piece begins in it. Items
    of size 0, null or less need no room and give no row, nor do null ids; repeated ids are packed as often as they come. Equal sizes go
    in order of id. Kinds without a name or a positive capacity are an error. No items give an empty result. The kinds table is small by
    definition: it is collected.
    """
    kinds = [(r[0], r[1]) for r in containers.select("container_kind", "capacity_tokens").distinct().collect()]
    if any(not k or not c or c < 1 for k, c in kinds) or len({k for k, _ in kinds}) != len(kinds):
        raise ValueError("every kind needs one name and a positive capacity")
    spark = items.sparkSession
    empty = spark.createDataFrame([], _BINS)
    sized = items.where("id is not null and size > 0").select(F.col("id").alias("item"), F.col("size").cast("long").alias("size"))
    spec = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("int").alias("capacity")) for k, c in kinds])
    each = sized.select("item", "size", F.inline(spec)) if kinds else None
    if each is None:
        return _places(empty)
    pieces = each.select("container_kind", "capacity", "item", "size", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / F.col("capacity")).cast("int") - 1)).alias("piece"))
    length = F.least(F.col("capacity").cast("long"), F.col("size") - F.col("piece").cast("long") * F.col("capacity")).cast("int")
    pieces = pieces.select("container_kind", "capacity", "item", "piece", length.alias("fill"))
    bins = pieces.select("container_kind", "capacity", F.concat_ws("-", F.lit("item"), F.lpad(F.col("item").cast("string"), 20, "0"), "piece").alias("container"), "fill", F.array(F.struct("item", "piece", F.col("fill").alias("size"))).alias("members"))

    bins = cut_lineage(bins.withColumn("goes_on", F.when(F.col("fill") == F.col("capacity"), -1).otherwise(0)).select("container_kind", "capacity", "container", "fill", "goes_on", "members"))
    done, open_bins = [bins.where("goes_on < 0")], bins.where("goes_on >= 0")
    groups = {r[0]: ceil(r[1] / group_items) for r in open_bins.groupBy("container_kind").count().collect()}
    round_no, of_row = 0, F.xxhash64("container")
    while groups:
        of_kind = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])[F.col("container_kind")].cast("long")
        packed = open_bins.withColumn("group", F.pmod(of_row, of_kind)).groupBy("container_kind", "group").applyInPandas(_pack(round_no, max(1, group_items // FAN_IN)), _BINS)
        packed = cut_lineage(packed)
        last = [k for k, n in groups.items() if n == 1]
        left = packed.where(F.col("goes_on") >= 0).where(~F.col("container_kind").isin(last)) if last else packed.where("goes_on >= 0")
        least = {r[0]: r[1] for r in left.groupBy("container_kind").agg(F.min("fill")).collect()}
        # The smallest bin itself goes on; a bin whose room is below it can take no other.
        on = F.lit(False)
        for kind, size in least.items():
            on = on | ((F.col("container_kind") == kind) & (F.col("goes_on") >= 0) & (F.col("capacity") - F.col("fill") >= size))
        done.append(packed.where(~on))
        open_bins = packed.where(on)
        groups = {k: ceil(n / FAN_IN) for k, n in groups.items() if k in least}
        round_no, of_row = round_no + 1, F.col("goes_on").cast("long")
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return _places(result)


def _places(bins: DataFrame) -> DataFrame:
    starts = F.transform("members", lambda m, k: F.struct(m["item"].alias("item"), m["piece"].alias("piece"), k.alias("place"), F.aggregate(F.slice("members", F.lit(1), k), F.lit(0), lambda s, x: s + x["size"]).alias("start"), m["size"].alias("size")))
    return bins.select("container_kind", "container", F.inline(starts))
