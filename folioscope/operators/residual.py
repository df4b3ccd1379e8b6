"""Hierarchical coder of word identity given morphology, layout and neighbours, held out by fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.session import cut_lineage

MODELS = ("morphology", "layout", "procedural_morphology", "previous_word_identity", "previous_line_identity", "neighbor_identity_mixture")
LAYOUT = ("morph", "currier", "topic", "position")
PROCEDURAL = (*LAYOUT, "prev_morph", "pl_morph")
PREVIOUS = ("morph", "prev_morph", "prev_word")
ALIGNED = ("morph", "pl_morph", "pl_word")


def with_morphology(tokens: DataFrame, depth: int = 1) -> DataFrame:
    """Adds signatures of the word and its two neighbours, as strings; null for an absent neighbour."""
    sig = lambda c: F.when(F.col(c).isNotNull(), F.array_join(text.signature(text.units(F.col(c)), depth), ","))
    return tokens.withColumns({"morph": sig("word"), "prev_morph": sig("prev_word"), "pl_morph": sig("pl_word")})


def by_test_fold(tokens: DataFrame, fold: str = "fold") -> DataFrame:
    """Every row once for each held-out fold, with ``train``. Folds are a small design constant: one array of their names meets each row."""
    folds = tokens.select(fold).distinct().agg(F.array_sort(F.collect_list(fold)).alias("_folds"))
    return tokens.crossJoin(F.broadcast(folds)).withColumn("test", F.explode("_folds")).drop("_folds").withColumn("train", F.col(fold) != F.col("test"))


def vocabularies(rows: DataFrame, limit: int, order: Sequence[str], by: Sequence[str] = ("test",)) -> DataFrame:
    """The ``limit - 1`` most frequent training words of each test fold, ties by first occurrence in training."""
    counts = rows.where("train").groupBy(*by, "word").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first"))).where(F.col("r") < limit).select(*by, "word")


def encode(rows: DataFrame, vocabulary: DataFrame, columns: Sequence[str], by: Sequence[str] = ("test",)) -> DataFrame:
    """Words of ``columns`` outside the fold's vocabulary replaced by a sentinel; at most limit x folds rows are broadcast."""
    for c in columns:
        v = F.broadcast(vocabulary.select(*by, F.col("word").alias(c), F.lit(True).alias("_in")))
        rows = rows.join(v, [*by, c], "left").withColumn(c, F.when(F.col("_in"), F.col(c)).when(F.col(c).isNotNull(), text.UNKNOWN)).drop("_in")
    return rows


def _key(columns: Sequence[str]) -> Column:
    return F.concat_ws(text.SEP, *[F.coalesce(F.col(c), F.lit("\x00")) for c in columns])


def _counts(train: DataFrame, keys: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    joint = train.groupBy("test", _key(keys).alias(f"k_{name}"), "word").agg(F.count("*").alias(f"n_{name}"))
    return joint, joint.groupBy("test", f"k_{name}").agg(F.sum(f"n_{name}").alias(f"t_{name}"))


def probabilities(encoded: DataFrame, targets: DataFrame, alpha: float = 0.5, strength: float = 20.0) -> DataFrame:
    """``targets`` with a column of probability for each of ``MODELS``.

    ``encoded`` are the training rows, ``targets`` rows with the same columns; both hold words of the fold's vocabulary. A target outside the
    support of its morphology is coded as unknown; an unseen morphology supports the unknown word only. An identity
    coder falls back where the neighbour is absent, not where it is unknown.
    """
    train = encoded.where("train")
    support = train.select("test", "morph", "word").union(train.select("test", "morph", F.lit(text.UNKNOWN).alias("word"))).distinct()
    size = support.groupBy("test", "morph").agg(F.count("*").alias("support"))
    rows = targets.join(support.withColumn("_s", F.lit(True)), ["test", "morph", "word"], "left")
    rows = rows.withColumn("word", F.when(F.col("_s"), F.col("word")).otherwise(text.UNKNOWN)).drop("_s").join(size, ["test", "morph"], "left").fillna(1, ["support"])
    tables = [(("morph",), "m", None), (LAYOUT, "l", None), (PROCEDURAL, "p", None), (PREVIOUS, "w", "prev_word"), (ALIGNED, "a", "pl_word")]
    for keys, name, needed in tables:
        joint, total = _counts(train.where(f"{needed} is not null") if needed else train, keys, name)
        rows = rows.withColumn(f"k_{name}", _key(keys)).join(joint, ["test", f"k_{name}", "word"], "left").join(total, ["test", f"k_{name}"], "left").fillna(0, [f"n_{name}", f"t_{name}"]).drop(f"k_{name}")
    posterior = lambda name, prior: (F.col(f"n_{name}") + strength * prior) / (F.col(f"t_{name}") + strength)
    rows = rows.withColumn(MODELS[0], (F.col("n_m") + alpha) / (F.col("t_m") + alpha * F.col("support")))
    rows = rows.withColumn(MODELS[1], posterior("l", F.col(MODELS[0]))).withColumn(MODELS[2], posterior("p", F.col(MODELS[1])))
    rows = rows.withColumn(MODELS[3], F.when(F.col("prev_word").isNull(), F.col(MODELS[2])).otherwise(posterior("w", F.col(MODELS[2]))))
    rows = rows.withColumn(MODELS[4], F.when(F.col("pl_word").isNull(), F.col(MODELS[2])).otherwise(posterior("a", F.col(MODELS[2]))))
    rows = rows.withColumn(MODELS[5], (F.col(MODELS[3]) + F.col(MODELS[4])) / 2)
    return rows.drop(*[f"{a}_{b}" for a in "nt" for b in "mlpwa"])


def held_out(tokens: DataFrame, limit: int = 512, depth: int = 1) -> DataFrame:
    """Rows by test fold, with morphology, in the words of each fold's vocabulary."""
    rows = by_test_fold(with_morphology(tokens, depth))
    rows = cut_lineage(rows)
    return cut_lineage(encode(rows, vocabularies(rows, limit, ("seq_id", "ln", "wi")), ("word", "prev_word", "pl_word")))


def bits(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*by).agg(F.count("*").alias("words"), *[(-F.sum(F.log2(m)) / F.count("*")).alias(m) for m in MODELS])
