"""Closed formulas of model sizes, floating-point work, loss and schedules, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decoder_params(d: Column, layers: Column, vocabulary: Column, inner: Column, relative: bool = False) -> Column:
    """Parameters without embeddings: attention, projections, feed-forward, norms and the output layer."""
    block = 4 * d * d + 2 * d * inner + inner + 9 * d + ((d * d + 2 * d) if relative else F.lit(0))
    return layers * block + 2 * d + d * vocabulary


def training_flops(d: Column, layers: Column, heads: Column, seq: Column, inner: Column) -> Column:
    """Forward and backward work for one sequence, without embeddings and logits."""
    kv = F.floor(d / heads) * heads
    attention = 6 * seq * d * kv + 4 * seq * seq * kv + 3 * heads * seq * seq + 2 * seq * kv * d
    return 3 * layers * (attention + 4 * seq * d * inner)


def loss(n: Column, tokens: Column) -> Column:
    """Fitted loss surface E + A / N^alpha + B / D^beta."""
    # Constants of the published fit.
    return 1.69 + 406.4 / F.pow(n, F.lit(0.34)) + 410.7 / F.pow(tokens, F.lit(0.28))


def best_split(budgets: DataFrame, steps: int = 400) -> DataFrame:
    """(c, n, d, loss): for each budget c = 6 n d the split of least loss on a grid of n from 1e7 to 1e12."""
    grid = budgets.select("c", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: F.pow(F.lit(10.0), 7 + 5 * k / steps))).alias("n"))
    grid = grid.withColumn("d", F.col("c") / (6 * F.col("n"))).withColumn("loss", loss(F.col("n"), F.col("d")))
    return grid.groupBy("c").agg(F.min_by(F.struct("n", "d", "loss"), "loss").alias("b")).select("c", "b.*")


def log_log_fit(points: DataFrame, x: str, y: str) -> DataFrame:
    lx, ly = F.log(x), F.log(y)
    return points.agg(F.regr_slope(ly, lx).alias("slope"), F.regr_intercept(ly, lx).alias("intercept"))


def learning_rate(step: Column, peak: float, least: float, warmup: int, decay: int) -> Column:
    """Linear warm-up, cosine decay, then the least rate."""
    share = (step - warmup) / (decay - warmup)
    return F.when(step < warmup, peak * (step + 1) / (warmup + 1)).when(step > decay, least).otherwise(least + 0.5 * (1 + F.cos(F.lit(math.pi) * share)) * (peak - least))


def work(parameters: Column, tokens: Column) -> Column:
    """Floating-point operations of training by the rule 6 N D."""
    return 6.0 * parameters * tokens


def training_days(parameters: Column, tokens: float, peak_flops: float, utilisation: float, devices: int) -> Column:
    return work(parameters, F.lit(tokens)) / (peak_flops * utilisation * devices) / 86400
