"""Splits that keep related records together.

Components come from hash-to-min: every node keeps a cluster of nodes as rows ``(v, u)``; in a round it sends its
cluster to the smallest member and that member to the whole cluster, until nothing changes. Clusters are rows, not
arrays, so the cluster of a component that holds a third of all nodes is spread like any other rows (the joins to
one row a node are split by adaptive execution). Each round ends in a reliable checkpoint.

Components go to splits by weighted rendezvous hashing, all of them: the split with the smallest ``-ln(hash)/share``
wins. Hashing evens out over many light components; a few heavy ones, the same for every seed, may not. So the seed is
chosen: among ``SEEDS`` candidates the one that brings the components of at least ``HEAVY`` of the weight (at most
``1/HEAVY`` rows) nearest to the shares. The light components are hashed with what the heavy ones leave of each share.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut_lineage

HEAVY = 0.002
SEEDS = 4096
MAX_ROUNDS = 60


def plain_quire(quire: Column) -> Column:
    """Capital letter and number without leading zeros, null where the field states no quire."""
    parts = r"(?i)^\W*(?:\$q\s*=|quire\b|q\.)?\W*([a-z])\W*0*(\d+)\W*$"
    return F.when(quire.rlike(parts), F.concat(F.upper(F.regexp_extract(quire, parts, 1)), F.regexp_extract(quire, parts, 2)))


def plain_page(page: Column) -> Column:
    """``f``, number without leading zeros, side; other names trimmed and in lower case; null if blank."""
    parts = r"(?i)^\W*f(?:ol|olio)?\W*0*(\d+)\W*([rv]\d*)\W*$"
    other = F.lower(F.regexp_replace(page, r"^\s+|\s+$", ""))
    return F.when(page.rlike(parts), F.concat(F.lit("f"), F.regexp_extract(page, parts, 1), F.lower(F.regexp_extract(page, parts, 2)))).when(other != "", other)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b) of strings; the component is named by its smallest node in string order.

    A null on one side makes the other a node without that link; rows null on both sides give nothing. Self
    loops and repeated edges are harmless; an empty table gives an empty result. Other columns play no part.
    """
    e = edges.select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b")).where("a is not null").distinct()
    state = e.select(F.inline(F.array(*[F.struct(F.col(x).alias("v"), F.col(y).alias("u")) for x, y in ("ab", "ba", "aa", "bb")]))).distinct()
    state, seen = cut_lineage(state), None
    for _ in range(MAX_ROUNDS):
        smallest = state.groupBy("v").agg(F.min("u").alias("m"))
        sent = state.join(smallest, "v").select(F.inline(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u"))))).distinct()
        state = cut_lineage(sent)
        now = state.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x")).first()
        if now == seen:
            return state.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node")
        seen = now
    raise RuntimeError(f"clusters still change after {MAX_ROUNDS} rounds")


def rendezvous(component: Column, seed: Column, shares: Mapping[str, float]) -> Column:
    """The split of a component by weighted rendezvous hashing."""
    uniform = lambda split: (F.pmod(F.xxhash64(seed, F.lit(split), component), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.array_min(F.array(*[F.struct((-F.log(uniform(k)) / w).alias("s"), F.lit(k).alias("split")) for k, w in sorted(shares.items())]))["split"]


def balanced_seed(weights: DataFrame, shares: Mapping[str, float], total: float, seed: int, seeds: int) -> tuple[int, dict[str, float]]:
    """Among ``seeds`` seeds from ``seed`` on the one under which the heavy components come nearest to the shares, the first of
    equals, and the heavy weight it gives to each split."""
    names = sorted(shares)
    heavy = weights.where((F.col("weight") >= HEAVY * total) & (F.col("weight") > 0))
    tried = heavy.crossJoin(F.broadcast(weights.sparkSession.range(seed, seed + seeds).withColumnRenamed("id", "seed")))  # at most seeds / HEAVY rows
    split = rendezvous(F.col("component"), F.col("seed"), shares)
    per = tried.groupBy("seed").agg(F.sum("weight").alias("all"), *[F.sum(F.when(split == k, F.col("weight")).otherwise(0.0)).alias(f"w{i}") for i, k in enumerate(names)])
    off = sum((F.abs(F.col(f"w{i}") - F.col("all") * shares[k]) for i, k in enumerate(names)), F.lit(0.0))
    best = per.orderBy(F.round(off, 6), "seed").first()
    return (best["seed"], {k: best[f"w{i}"] for i, k in enumerate(names)}) if best else (seed, dict.fromkeys(names, 0.0))


def assign_splits(components: DataFrame, shares: Mapping[str, float], seed: int = 408, seeds: int = SEEDS) -> DataFrame:
    """(component, weight, split) for components with non-negative weights, shares summing to 1.

    Every component is placed by weighted rendezvous hashing under one seed. Unless ``seeds`` is 1, the seed is chosen and the light
    components are hashed with the shares that the heavy ones leave (`balanced_seed`).
    Null components give no row, null weights count as 0. Equal components are one: their weights are added. The result
    depends on names, weights and seed only. An empty table gives an empty result. Other columns play no part.
    """
    if not shares or min(shares.values()) <= 0 or abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("shares must be positive and sum to 1")
    weights = components.where("component is not null").groupBy("component").agg(F.sum(F.coalesce(F.col("weight").cast("double"), F.lit(0.0))).alias("weight"))
    if seeds == 1:
        return weights.withColumn("split", rendezvous(F.col("component"), F.lit(seed).cast("long"), shares))
    weights = cut_lineage(weights)
    total = weights.agg(F.sum("weight")).first()[0] or 0.0
    seed, placed = balanced_seed(weights, shares, total, seed, seeds)
    left = {k: max(v * total - placed[k], 1e-9 * total) for k, v in shares.items()} if total else dict(shares)
    by = lambda parts: rendezvous(F.col("component"), F.lit(seed).cast("long"), parts)
    return weights.withColumn("split", F.when((F.col("weight") >= HEAVY * total) & (F.col("weight") > 0), by(shares)).otherwise(by(left)))


def quire_page_edges(pages: DataFrame, words: DataFrame) -> DataFrame:
    """Edges between quires and pages of ``pages`` (name, quire) and ``words`` (page, quire); quires sort before pages."""
    both = pages.select(F.col("name").alias("page"), "quire").unionByName(words.select("page", "quire")).distinct()
    return both.select(quire_node(F.col("quire")).alias("a"), page_node(F.col("page")).alias("b"))


def quire_node(quire: Column) -> Column:
    return F.concat(F.lit("0"), plain_quire(quire))


def page_node(page: Column) -> Column:
    return F.concat(F.lit("1"), plain_page(page))
