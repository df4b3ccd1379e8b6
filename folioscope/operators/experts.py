"""Mixtures of probability experts for word identity: density ratios, edit channel, word classes, EM weights.

An expert reweights a base distribution over the support of a word's morphology. Contexts are reduced to their distinct
keys before they meet the support, so the work grows with distinct contexts, and Python sees distinct pairs of words only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import residual
from folioscope.session import cut_lineage

# Settings (insertion, deletion, copy) of the edit channel.
EDITS = {"edit_tight": (0.05, 0.05, 0.9), "edit_loose": (0.15, 0.15, 0.7)}
BASE_KEY = ("test", "morph", "currier", "topic", "position", "prev_morph", "pl_morph")


def edit_probability(source: Sequence[str], target: Sequence[str], insertion: float, deletion: float, copy: float, alphabet: int) -> float:
    """Probability that ``source`` becomes ``target`` when each gap may take one insertion and each unit is dropped, kept or replaced."""
    n = len(target)
    state = np.zeros(n + 1)
    state[0] = 1.0
    inserted = lambda p: p * (1 - insertion) + np.concatenate([[0.0], p[:-1]]) * (insertion / alphabet)
    target_units = np.array(target, dtype=object)
    for unit in source:
        gap = inserted(state)
        emit = np.where(target_units == unit, copy, (1 - copy) / (alphabet - 1)) if n else np.zeros(0)
        state = gap * deletion
        state[1:] += gap[:-1] * (1 - deletion) * emit
    return float(inserted(state)[n])


def edit_pairs(pairs: DataFrame, alphabet: int, grouped: bool = True) -> DataFrame:
    """(source, target, edit_tight, edit_loose) for distinct pairs of words."""
    from folioscope.functions.text import UNIT_GROUPS
    import re

    cut = re.compile("|".join(UNIT_GROUPS) + "|.", re.S) if grouped else re.compile(".", re.S)

    def run(batches):
        for pdf in batches:
            known = {w: cut.findall(w) for w in {*pdf["source"], *pdf["target"]}}
            for name, (i, d, c) in EDITS.items():
                pdf[name] = [edit_probability(known[a], known[b], i, d, c, alphabet) for a, b in zip(pdf["source"], pdf["target"])]
            yield pdf

    return pairs.select("source", "target").distinct().mapInPandas(run, "source string, target string, edit_tight double, edit_loose double")


def reweight(candidates: DataFrame, context: Sequence[str], cond_keys: Sequence[str], marg_keys: Sequence[str], train: DataFrame, category: Column | str, alpha: float = 0.5, strength: float = 20.0, name: str = "p") -> DataFrame:
    """Base probabilities times smoothed conditional / marginal of the candidate's category, normalised over each context.

    ``candidates`` holds context, the condition columns, ``cand``, ``cat`` (its category, null for factor 1) and ``p0``; ``train`` the
    training rows with the condition columns and the observed category as ``cat``.
    """
    cond = train.groupBy(*cond_keys, "cat").agg(F.count("*").alias("cn"))
    marg = train.groupBy(*marg_keys, "cat").agg(F.count("*").alias("mn"))
    cond_t, marg_t = cond.groupBy(*cond_keys).agg(F.sum("cn").alias("ct")), marg.groupBy(*marg_keys).agg(F.sum("mn").alias("mt"), F.count("*").alias("mc"))
    rows = candidates.join(marg, [*marg_keys, "cat"], "left").join(marg_t, list(marg_keys), "left").join(cond, [*cond_keys, "cat"], "left").join(cond_t, list(cond_keys), "left").fillna(0, ["mn", "mt", "cn", "ct"]).fillna(1, ["mc"])
    m = (F.col("mn") + alpha) / (F.col("mt") + F.lit(alpha) * F.col("mc"))
    factor = F.when(F.col("cat").isNull(), 1.0).otherwise((F.col("cn") + strength * m) / (F.col("ct") + strength) / m)
    rows = rows.withColumn("_w", F.col("p0") * factor)
    total = rows.groupBy(*context).agg(F.sum("_w").alias("_t"))
    return rows.join(total, list(context)).select(*context, "cand", (F.col("_w") / F.col("_t")).alias(name))


def base_distribution(encoded: DataFrame, contexts: DataFrame) -> DataFrame:
    """(base key, cand, p0) over the support of each distinct base key."""
    train = encoded.where("train")
    support = train.select("test", "morph", F.col("word").alias("cand")).union(train.select("test", "morph", F.lit(text.UNKNOWN))).distinct()
    every = contexts.select(*BASE_KEY).distinct().join(support, ["test", "morph"], "left").fillna(text.UNKNOWN, ["cand"])
    scored = residual.probabilities(encoded, every.withColumnRenamed("cand", "word").withColumns({"prev_word": F.lit(None).cast("string"), "pl_word": F.lit(None).cast("string")}))
    return scored.select(*BASE_KEY, F.col("word").alias("cand"), F.col("procedural_morphology").alias("p0"))


def mixture_weights(rows: np.ndarray, iterations: int = 200, floor: float = 1e-9) -> np.ndarray:
    """Maximum-likelihood weights of experts (columns) by EM, floored before they are made to sum to 1."""
    k = rows.shape[1]
    if not len(rows):
        raise ValueError("no rows to fit")
    w = np.full(k, 1.0 / k)
    if k == 1:
        return np.ones(1)
    for _ in range(iterations):
        part = rows * w
        new = np.maximum(floor, (part / part.sum(1, keepdims=True)).mean(0))
        new /= new.sum()
        done = np.abs(new - w).max() < 1e-9
        w = new
        if done:
            break
    return w


def fit_mixture(scored: DataFrame, experts: Sequence[str], by: Sequence[str], iterations: int = 200) -> dict[tuple, dict[str, float]]:
    """EM weights of each group by rounds of one distributed aggregate: no group is gathered in one task.

    Equal rows are collapsed first. Each round returns one row a group.
    """
    rows = scored.groupBy(*by, *experts).agg(F.count("*").alias("n")).cache()
    groups = [tuple(r) for r in rows.select(*by).distinct().collect()]
    weights = {g: np.full(len(experts), 1.0 / len(experts)) for g in groups}
    open_groups = set(groups) if len(experts) > 1 else set()
    spark = scored.sparkSession
    for _ in range(iterations):
        if not open_groups:
            break
        table = spark.createDataFrame([(*g, [float(x) for x in weights[g]]) for g in open_groups], ", ".join([f"{b} string" for b in by] + ["w array<double>"]))
        part = [F.col("w")[k] * F.col(e) for k, e in enumerate(experts)]
        mass = sum(part[1:], part[0])
        step = rows.join(F.broadcast(table), list(by)).groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * p / mass).alias(f"e{k}") for k, p in enumerate(part)])
        for r in step.collect():
            g = tuple(r[b] for b in by)
            new = np.maximum(1e-9, np.array([r[f"e{k}"] for k in range(len(experts))]) / r["n"])
            new /= new.sum()
            if np.abs(new - weights[g]).max() < 1e-9:
                open_groups.discard(g)
            weights[g] = new
    rows.unpersist()
    return {g: dict(zip(experts, map(float, w))) for g, w in weights.items()}


def ppmi(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, word, feature, value): positive pointwise mutual information of words with their left and right neighbours,
    rows of length 1. ``pairs`` has (prev_word, word) in the words of a vocabulary, unknown words as a sentinel."""
    known = lambda c: F.col(c).isNotNull() & (F.col(c) != text.UNKNOWN)
    left = pairs.where(known("word") & F.col("prev_word").isNotNull()).select(*by, "word", F.concat(F.lit("L:"), "prev_word").alias("feature"))
    right = pairs.where(known("prev_word")).select(*by, F.col("prev_word").alias("word"), F.concat(F.lit("R:"), F.col("word")).alias("feature"))
    joint = left.unionByName(right).groupBy(*by, "word", "feature").agg(F.count("*").alias("n"))
    row, column = joint.groupBy(*by, "word").agg(F.sum("n").alias("r")), joint.groupBy(*by, "feature").agg(F.sum("n").alias("c"))
    total = joint.groupBy(*by).agg(F.sum("n").alias("t"))
    every = joint.join(row, [*by, "word"]).join(column, [*by, "feature"])
    every = every.join(F.broadcast(total), list(by)) if by else every.crossJoin(F.broadcast(total))
    ratio = F.col("n") * F.col("t") / (F.col("r") * F.col("c"))
    value = every.where(ratio > 1).select(*by, "word", "feature", F.log2(ratio).alias("v"))
    norm = value.groupBy(*by, "word").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return value.join(norm, [*by, "word"]).select(*by, "word", "feature", (F.col("v") / F.col("norm")).alias("value"))


def spherical_classes(vectors: pd.DataFrame, frequencies: dict[str, int], classes: int, rounds: int = 12) -> dict[str, int]:
    """Deterministic spherical k-means over unit rows (word, feature, value): farthest-first seeds, centroids weighted by the
    root of the frequency; words without a row get class 0. The vocabulary is at most the coder's limit."""
    words = sorted(frequencies, key=lambda w: (-frequencies[w], w))
    usable = [w for w in words if w in set(vectors["word"])]
    if not usable:
        return dict.fromkeys(words, 0)
    at, features = {w: k for k, w in enumerate(usable)}, {f: k for k, f in enumerate(sorted(set(vectors["feature"])))}
    m = np.zeros((len(usable), len(features)))
    m[[at[w] for w in vectors["word"]], [features[f] for f in vectors["feature"]]] = vectors["value"]
    k = min(classes, len(usable))
    seeds, nearest = [0], m @ m[0]
    while len(seeds) < k:
        free = [i for i in range(len(usable)) if i not in seeds]
        seeds.append(min(free, key=lambda i: (nearest[i], i)))
        nearest = np.maximum(nearest, m @ m[seeds[-1]])
    centroids, own = m[seeds].copy(), None
    weight = np.sqrt([max(1, frequencies[w]) for w in usable])
    for _ in range(rounds):
        new = (m @ centroids.T).argmax(1)
        if own is not None and (new == own).all():
            break
        own = new
        for c in range(k):
            total = (m[own == c] * weight[own == c, None]).sum(0)
            length = math.sqrt((total**2).sum())
            centroids[c] = total / length if length else (m[seeds[c]] if not (own == c).any() else 0)
    found = {w: int(own[at[w]]) for w in usable}
    return {w: found.get(w, 0) for w in words}


def edit_grid(pairs: DataFrame, grid: Sequence[tuple[float, float, float]], alphabet: int) -> DataFrame:
    """(source, target, setting, edit): the edit channel of each distinct pair under every setting (insertion, deletion, copy)."""
    import re

    cut = re.compile("|".join(text.UNIT_GROUPS) + "|.", re.S)

    def run(batches):
        for pdf in batches:
            known = {w: cut.findall(w) for w in {*pdf["source"], *pdf["target"]}}
            for i, d, c in grid:
                yield pdf.assign(setting=f"{i}/{d}/{c}", edit=[edit_probability(known[a], known[b], i, d, c, alphabet) for a, b in zip(pdf["source"], pdf["target"])])

    return pairs.select("source", "target").distinct().mapInPandas(run, "source string, target string, setting string, edit double")


def fit_copy_weights(rows: DataFrame, by: Sequence[str], rounds: int = 30) -> DataFrame:
    """(by, weight, log_likelihood): weight of ``edit`` against ``base`` from .25, kept in [.001, .999], by rounds of one distributed aggregate.

    Each round returns one row a group; ``n`` is the multiplicity of a row. Equal rows are collapsed into a table first, so that a round
    reads two numbers a row and its plan, which the driver keeps, has no part of the making of ``rows``.
    """
    rows = cut_lineage(rows.groupBy(*by, "base", "edit").agg(F.sum("n").alias("n")))
    weights = rows.select(*by).distinct().withColumn("w", F.lit(0.25))
    spark = rows.sparkSession
    part = F.col("w") * F.col("edit")
    mass = part + (1 - F.col("w")) * F.col("base")
    for _ in range(rounds):
        step = rows.join(F.broadcast(weights), list(by)).groupBy(*by).agg(F.least(F.greatest(F.sum(F.col("n") * part / mass) / F.sum("n"), F.lit(0.001)), F.lit(0.999)).alias("w"))
        weights = spark.createDataFrame(step.collect(), step.schema)  # one row a group
    return rows.join(F.broadcast(weights), list(by)).groupBy(*by).agg(F.round(F.max("w"), 6).alias("weight"), F.round(F.sum(F.col("n") * F.log2(mass)), 4).alias("log_likelihood"))
