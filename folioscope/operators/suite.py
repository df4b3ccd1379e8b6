"""A suite of experts for word identity, scored on held-out words.

All experts reweight one base distribution over the support of a word's morphology. Contexts are reduced to the distinct keys an
expert looks at before they meet the support, so the work grows with distinct contexts; supports are bounded by the vocabulary.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import experts, residual
from folioscope.session import cut_lineage

# Names of the experts and numbers of word classes.
NAMES = ("base", "paragraph", "boundary", "edit_tight", "edit_loose", "class_8", "class_16", "exact_previous", "exact_aligned")
CLASSES = {"class_8": 8, "class_16": 16}
KEY = list(experts.BASE_KEY)
ABSENT = "\x00"


def prepared(tokens: DataFrame, limit: int, depth: int = 0) -> DataFrame:
    """Rows by test fold in the words of the fold's vocabulary, with paragraph state, end of the word before and beginning of the word."""
    edge = lambda c, k: F.element_at(text.units(F.col(c)), k)
    marked = tokens.withColumns({"pstate": text.paragraph_state(F.col("ln"), F.lit(False)), "pfinal": edge("prev_word", -1), "tinit": edge("word", 1)})
    return cut_lineage(residual.held_out(marked, limit, depth).fillna(ABSENT, ["prev_morph", "pl_morph"]).select(*KEY, "train", "seq_id", "ln", "wi", "word", "prev_word", "pl_word", "pstate", "pfinal", "tinit"))


def known(word: str) -> Column:
    return F.col(word).isNotNull() & (F.col(word) != text.UNKNOWN)


def word_classes(train: DataFrame, count: int) -> DataFrame:
    """(test, word, cls): spherical classes of each fold's vocabulary, one task a fold with at most the vocabulary's words."""
    vectors = experts.ppmi(train.select("test", "prev_word", "word"), ["test"])
    n = train.where(known("word")).groupBy("test", "word").agg(F.count("*").alias("n"))
    rows = n.join(vectors.groupBy("test", "word").agg(F.collect_list(F.struct("feature", "value")).alias("v")), ["test", "word"], "left")

    def classify(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pd.DataFrame([(w, x["feature"], x["value"]) for w, xs in zip(pdf["word"], pdf["v"]) if xs is not None for x in xs], columns=["word", "feature", "value"])
        found = experts.spherical_classes(v, dict(zip(pdf["word"], pdf["n"])), count)
        return pd.DataFrame({"test": pdf["test"].iloc[0], "word": list(found), "cls": [str(c) for c in found.values()]})

    return rows.groupBy("test").applyInPandas(classify, "test string, word string, cls string")


def distributions(rows: DataFrame, alphabet: int = 26) -> tuple[DataFrame, dict[str, tuple[list[str], DataFrame]]]:
    """(base distribution, expert -> (context, distribution over candidates)) for the contexts of the held-out words.

    An expert has no rows for contexts it falls back to the base in: no word before, or one outside the vocabulary.
    """
    train, held = rows.where("train"), rows.where("not train")
    contexts = cut_lineage(held.select(*KEY, "pstate", "pfinal", "prev_word", "pl_word").distinct())
    base = cut_lineage(experts.base_distribution(rows, contexts))

    def ratio(name: str, extra: Sequence[str], cond: Sequence[str], marg: Sequence[str], seen: DataFrame, category: Column, where: Column) -> tuple[list[str], DataFrame]:
        each = contexts.where(where).select(*KEY, *extra).distinct().join(base, KEY).withColumn("cat", category)
        return [*KEY, *extra], experts.reweight(each, [*KEY, *extra], cond, marg, seen, "cat", name=name)

    out = {"paragraph": ratio("paragraph", ["pstate"], ["test", "morph", "pstate"], ["test", "morph"], train.withColumn("cat", F.col("word")), F.col("cand"), F.lit(True))}
    first = F.when(F.col("cand") != text.UNKNOWN, F.element_at(text.units(F.col("cand")), 1))
    out["boundary"] = ratio("boundary", ["pfinal"], ["test", "morph", "prev_morph", "pfinal"], ["test", "morph", "prev_morph"], train.where("pfinal is not null").withColumn("cat", F.col("tinit")), first, F.col("pfinal").isNotNull())
    for name, word, morph in (("exact_previous", "prev_word", "prev_morph"), ("exact_aligned", "pl_word", "pl_morph")):
        out[name] = ratio(name, [word], ["test", "morph", morph, word], ["test", "morph", morph], train.where(known(word)).withColumn("cat", F.col("word")), F.col("cand"), known(word))
    for name, count in CLASSES.items():
        classes = cut_lineage(word_classes(train, count))
        source, target = classes.toDF("test", "prev_word", "source"), classes.toDF("test", "word", "cat")
        seen = train.join(source, ["test", "prev_word"]).join(target, ["test", "word"])
        each = contexts.where(known("prev_word")).select(*KEY, "prev_word").distinct().join(source, ["test", "prev_word"]).join(base, KEY).join(classes.toDF("test", "cand", "cat"), ["test", "cand"], "left")
        made = experts.reweight(each.select(*KEY, "source", "cand", "cat", "p0").distinct(), [*KEY, "source"], ["test", "prev_morph", "source"], ["test", "prev_morph"], seen, "cat", name=name)
        out[name] = ([*KEY, "prev_word"], contexts.select(*KEY, "prev_word").distinct().join(source, ["test", "prev_word"]).join(made, [*KEY, "source"]).drop("source"))
    each = cut_lineage(contexts.where(known("prev_word")).select(*KEY, "prev_word").distinct().join(base, KEY))
    pairs = experts.edit_pairs(each.where(F.col("cand") != text.UNKNOWN).select(F.col("prev_word").alias("source"), F.col("cand").alias("target")), alphabet)
    edits = cut_lineage(each.join(pairs.toDF("prev_word", "cand", "edit_tight", "edit_loose"), ["prev_word", "cand"], "left"))
    for name in ("edit_tight", "edit_loose"):
        # Known words share what the base leaves to them by the edit channel; the unknown word keeps its mass.
        sums = edits.groupBy(*KEY, "prev_word").agg(F.sum(name).alias("_e"), F.sum(F.when(F.col("cand") == text.UNKNOWN, F.col("p0")).otherwise(0.0)).alias("_u"))
        p = F.when(F.coalesce(F.col("_e"), F.lit(0.0)) <= 0, F.col("p0")).when(F.col("cand") == text.UNKNOWN, F.col("p0")).otherwise((1 - F.col("_u")) * F.col(name) / F.col("_e"))
        out[name] = ([*KEY, "prev_word"], edits.join(sums, [*KEY, "prev_word"]).select(*KEY, "prev_word", "cand", p.alias(name)))
    return base, out


def token_probabilities(rows: DataFrame) -> DataFrame:
    """(seq_id, ln, wi, test, word, one column a name of ``NAMES``) of each held-out word; a word outside the support counts as unknown."""
    base, made = distributions(rows)
    held = rows.where("not train").join(base.select(*KEY, F.col("cand").alias("word"), F.lit(True).alias("_s")), [*KEY, "word"], "left")
    held = held.withColumn("word", F.when(F.col("_s"), F.col("word")).otherwise(text.UNKNOWN)).drop("_s").join(base.select(*KEY, F.col("cand").alias("word"), F.col("p0").alias("base")), [*KEY, "word"])
    for name in NAMES[1:]:
        context, p = made[name]
        held = held.join(p.withColumnRenamed("cand", "word"), [*context, "word"], "left").withColumn(name, F.coalesce(name, "base"))
    return held.select("seq_id", "ln", "wi", "test", "word", *NAMES)


def masses(rows: DataFrame) -> DataFrame:
    """(expert, contexts, violations): contexts whose probabilities don't sum to 1."""
    base, made = distributions(rows)
    parts = [(n, made[n][0], made[n][1].withColumnRenamed(n, "p")) for n in NAMES[1:]] + [("base", KEY, base.withColumnRenamed("p0", "p"))]
    sums = [p.groupBy(*c).agg(F.sum("p").alias("m")).agg(F.count("*").alias("contexts"), F.count_if(F.abs(F.col("m") - 1) > 1e-9).alias("violations")).select(F.lit(n).alias("expert"), "contexts", "violations") for n, c, p in parts]
    return reduce(DataFrame.unionByName, sums)
