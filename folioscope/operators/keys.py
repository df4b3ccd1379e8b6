"""Substitution keys: constraints from cribs, consistent merges, key counts, search and scoring."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Mapped = tuple[tuple[str, str], ...]


def pair_mapping(cipher: Column, plain: Column, injective: bool = True) -> Column:
    """Sorted distinct (cipher, plain) pairs of two arrays, null unless they make a (one-to-one) function."""
    pairs = F.array_distinct(F.zip_with(cipher, plain, lambda a, b: F.struct(a.alias("c"), b.alias("p"))))
    once = lambda part: F.size(F.array_distinct(F.transform(pairs, lambda x: x[part]))) == F.size(pairs)
    ok = (F.size(cipher) == F.size(plain)) & once("c")
    return F.when(ok & once("p") if injective else ok, F.array_sort(pairs))


def constraints(labels: DataFrame, forms: DataFrame, injective: bool = True) -> DataFrame:
    """(page, target, mapping, locus_id, form, reversed): every mapping under which a label (page, locus_id, units) reads a
    form (target, form) forwards or backwards, kept once with its least source. Both tables are small dimensions."""
    both = labels.crossJoin(F.broadcast(forms)).withColumn("reversed", F.explode(F.array(F.lit(False), F.lit(True))))
    letters = F.split("form", "")
    m = pair_mapping(F.when(F.col("reversed"), F.reverse("units")).otherwise(F.col("units")), letters, injective)
    found = both.withColumn("mapping", m).where("mapping is not null")
    return found.groupBy("page", "target", "mapping").agg(F.min(F.struct("locus_id", "form", "reversed")).alias("s")).select("page", "target", "mapping", "s.*")


def satisfies(key: Column, mapping: Column) -> Column:
    return F.forall(mapping, lambda x: F.coalesce(key[x["c"]] == x["p"], F.lit(False)))


def merge(a: Mapped, b: Mapped, injective: bool = True) -> Mapped | None:
    out = dict(a)
    for c, p in b:
        if out.setdefault(c, p) != p:
            return None
    if injective and len(set(out.values())) != len(out):
        return None
    return tuple(sorted(out.items()))


def fit_keys(options: Mapping[str, Sequence[Mapped]], beam: int = 50_000, injective: bool = True) -> tuple[int, list[Mapped], bool]:
    """(pages met, best keys, cut off): keys consistent with as many pages as can be; pages with fewer options first, any may be left out."""
    states: dict[Mapped, frozenset] = {(): frozenset()}
    cut = False
    for page in sorted(options, key=lambda p: (len(options[p]), p)):
        grown = dict(states)
        for key, met in states.items():
            for option in options[page]:
                made = merge(key, option, injective)
                if made is not None and len(met) + 1 > len(grown.get(made, ())):
                    grown[made] = met | {page}
        ordered = sorted(grown.items(), key=lambda x: (-len(x[1]), len(x[0]), x[0]))
        cut, states = cut or len(ordered) > beam, dict(ordered[:beam])
    best = max(map(len, states.values()))
    keys = sorted((k for k, met in states.items() if len(met) == best), key=lambda k: (len(k), k))
    return best, keys, cut


def fit_runs(options: DataFrame, by: str, beam: int = 50_000) -> DataFrame:
    """(by, met, keys, cut): the beam search of each run in a task of its own.

    ``options`` has (by, page, mapping array<struct<c:string,p:string>>); a run holds the cribs of a few pages, which the design bounds.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        per: dict[str, list[Mapped]] = {}
        for page, mapping in zip(pdf["page"], pdf["mapping"]):
            per.setdefault(page, []).append(tuple((x["c"], x["p"]) for x in mapping))
        met, found, cut = fit_keys(per, beam)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "met": [met], "keys": [len(found)], "cut": [cut]})

    return options.groupBy(by).applyInPandas(one, f"{by} {options.schema[by].dataType.simpleString()}, met int, keys long, cut boolean")


def anagram_key_count(cipher: Column, plain: Column) -> Column:
    """One-to-one keys that make one array an anagram of the other: product of factorials of the groups of equal multiplicity."""
    counts = lambda a: F.array_sort(F.transform(F.array_distinct(a), lambda s: F.size(F.filter(a, lambda x: x == s))))
    c = counts(cipher)
    product = F.aggregate(F.array_distinct(c), F.lit(1).cast("long"), lambda acc, k: acc * F.factorial(F.size(F.filter(c, lambda x: x == k))))
    return F.when((F.size(cipher) == F.size(plain)) & (c == counts(plain)), product).otherwise(F.lit(0).cast("long"))


def reduce_alphabet(words: Sequence[Sequence[str]]) -> dict[str, str]:
    """Letter to class with the two rarest letters (then first in order) as one class."""
    # Fixed value: the name of the merged class.
    n = Counter(x for w in words for x in w)
    rare = sorted(n, key=lambda x: (n[x], x))[:2]
    return {x: "<HEBREW_RARE>" if x in rare else x for x in n}


class Objective:
    """Log-probability of transition counts under a key, with an index from symbol to the transitions it is in."""

    def __init__(self, transitions: Mapping[tuple[str, str], int], log_p: Mapping[tuple[str, str], float], floor: float = -20.0):
        self.items, self.log_p, self.floor = list(transitions.items()), log_p, floor
        self.of: dict[str, list[int]] = defaultdict(list)
        for k, ((a, b), _) in enumerate(self.items):
            for s in {a, b}:
                self.of[s].append(k)

    def part(self, key: Mapping[str, str], which: Sequence[int]) -> float:
        return sum(self.items[k][1] * self.log_p.get((key[self.items[k][0][0]], key[self.items[k][0][1]]), self.floor) for k in which)

    def score(self, key: Mapping[str, str]) -> float:
        return self.part(key, range(len(self.items)))

    def gain(self, key: dict[str, str], a: str, b: str) -> float:
        touched = sorted({*self.of[a], *self.of[b]})
        before = self.part(key, touched)
        key[a], key[b] = key[b], key[a]
        after = self.part(key, touched)
        key[a], key[b] = key[b], key[a]
        return after - before


def polish(objective: Objective, key: Mapping[str, str]) -> dict[str, str]:
    """Best swap after best swap until none gains more than 1e-9."""
    key, symbols = dict(key), sorted(key)
    pairs = [(a, b) for i, a in enumerate(symbols) for b in symbols[i + 1 :]]
    while pairs:
        gain, a, b = max((objective.gain(key, a, b), a, b) for a, b in pairs)
        if gain <= 1e-9:
            break
        key[a], key[b] = key[b], key[a]
    return key


# Temperatures of the published search, in natural logarithms of the mean score.
HOT, COLD = 0.025, 0.0002


def anneal(objective: Objective, key: Mapping[str, str], steps: int = 6000, seed: int = 408, hot: float = HOT, cold: float = COLD) -> dict[str, str]:
    """The best key met by swaps accepted at a temperature falling geometrically, polished.

    Scores are log2 probabilities; the rule of acceptance takes natural logarithms, so a change counts ln 2 times. Every seed but the first
    of a search starts from a permuted key, so restarts explore different regions.
    """
    rng, key, symbols = random.Random(seed), dict(key), sorted(key)
    if len(symbols) < 2:
        return key
    total, at, best_at, best = max(1, sum(n for _, n in objective.items)), 0.0, 0.0, dict(key)
    for step in range(steps):
        a, b = rng.sample(symbols, 2)
        change = objective.gain(key, a, b) * math.log(2) / total
        if change >= 0 or rng.random() < math.exp(change / (hot * (cold / hot) ** (step / max(1, steps - 1)))):
            key[a], key[b] = key[b], key[a]
            at += change
            if at > best_at + 1e-15:
                best_at, best = at, dict(key)
    return polish(objective, best)


def restart_key(key: Mapping[str, str], run: int, seed: int) -> dict[str, str]:
    """The starting key of a restart: the given one for the first run, else its values in seeded order."""
    if run == 0:
        return dict(key)
    symbols = sorted(key)
    values = [key[s] for s in symbols]
    random.Random(seed * 1_000_003 + run).shuffle(values)
    return dict(zip(symbols, values))


def search(runs: DataFrame, objective: Objective, key: Mapping[str, str], steps: int = 6000) -> DataFrame:
    """(run, score, key) of independent restarts (run, seed), one task a restart; the objective is a bounded alphabet squared."""
    shared = runs.sparkSession.sparkContext.broadcast((objective, dict(key)))

    def one(batches):
        for pdf in batches:
            task, start = shared.value
            keys = [anneal(task, restart_key(start, int(r), int(s)), steps, int(s)) for r, s in zip(pdf["run"], pdf["seed"])]
            yield pdf[["run"]].assign(score=np.array([task.score(k) for k in keys], float), key=[sorted(k.items()) for k in keys])

    return runs.select("run", "seed").repartition("run").mapInPandas(one, "run int, score double, key array<struct<c:string,p:string>>")
