"""Word-shape rankings, bootstraps, and expert queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import experts, residual, shape
from folioscope.plans.common import CORPORA_SQL, PAGES_SQL, SEED, corpora, token_facts
from folioscope.plans.coding import _CODED, _V, _two_folds, rest

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_PAT = "array_to_string(list_sort(list_transform(list_distinct(string_split(word, '')), lambda s: len(list_filter(string_split(word, ''), lambda x: x = s))), 'DESC'), ',')"
_SHAPES = f"""WITH {PAGES_SQL.strip()}, {CORPORA_SQL.strip()},
ts AS (SELECT currier, CAST(length(word) AS INTEGER) AS len, {_PAT} AS pattern, CAST(sum(n) AS BIGINT) AS n FROM (SELECT currier, word, count(*) AS n FROM tok GROUP BY ALL) GROUP BY ALL),
rs AS (SELECT lang, CAST(length(word) AS INTEGER) AS len, {_PAT} AS pattern, CAST(sum(n) AS BIGINT) AS n FROM (SELECT lang, lower(word) AS word, count(*) AS n FROM cw GROUP BY ALL) GROUP BY ALL)"""


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = shape.shapes(token_facts(spark, sf_dir).select("currier", "word"), ["currier"])
    return pages, shape.shapes(corpora(spark, sf_dir).select("lang", F.explode(F.transform("words", F.lower)).alias("word")), ["lang"])


def _rank_sql(keys: str) -> str:
    return f"""{_SHAPES},
t AS (SELECT currier, {keys}, sum(n) AS n FROM ts GROUP BY ALL), r AS (SELECT lang, {keys}, sum(n) AS n FROM rs GROUP BY ALL),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY currier) AS p FROM t), q AS (SELECT *, n / sum(n) OVER (PARTITION BY lang) AS q FROM r),
d AS (SELECT currier, lang, round(-ln(sum(sqrt(p * q))), 6) AS distance FROM p JOIN q USING ({keys}) GROUP BY ALL)
SELECT currier, lang, distance, row_number() OVER (PARTITION BY currier ORDER BY distance, lang) AS rank FROM d"""


def _ranked(d: DataFrame) -> DataFrame:
    return shape.ranked(d.withColumn("distance", F.round("distance", 6)), ["currier"], "lang").withColumn("rank", F.col("rank").cast("long"))


@query(_rank_sql("pattern"))
def bhattacharyya_rank(spark, sf_dir):
    t, r = _both(spark, sf_dir)
    return _ranked(shape.distances(t, r, ["currier"], ["lang"], ["pattern"]))


@query(_rank_sql("len"))
def length_only_rank(spark, sf_dir):
    t, r = _both(spark, sf_dir)
    return _ranked(shape.distances(t, r, ["currier"], ["lang"], ["len"]))


@query(_SHAPES + """,
p AS (SELECT currier, len, pattern, n / sum(n) OVER (PARTITION BY currier, len) AS p, sum(n) OVER (PARTITION BY currier, len) / sum(n) OVER (PARTITION BY currier) AS w FROM ts),
q AS (SELECT lang, len, pattern, n / sum(n) OVER (PARTITION BY lang, len) AS q FROM rs),
d AS (SELECT currier, lang, round(-ln(sum(w * sqrt(p * q))), 6) AS distance FROM p JOIN q USING (len, pattern) GROUP BY ALL)
SELECT currier, lang, distance, row_number() OVER (PARTITION BY currier ORDER BY distance, lang) AS rank FROM d""")
def conditional_pattern_rank(spark, sf_dir):
    t, r = _both(spark, sf_dir)
    return _ranked(shape.conditional_distances(t, r, ["currier"], ["lang"]))


@query(_SHAPES + "\nSELECT pattern, CAST(sum(n) AS BIGINT) AS n, CAST(0 AS BIGINT) AS difference FROM ts GROUP BY pattern")
def pseudotext_invariance(spark, sf_dir):
    """Shapes of pseudo-words made from the patterns of all words, less those of the words: no difference."""
    w = token_facts(spark, sf_dir).select("seq_id", "ln", "wi", "word")
    pattern = text.unit_pattern(text.units(F.col("word"), False))
    made = w.select(pattern.alias("before"), shape.pseudo_word(pattern, F.concat_ws("|", F.lit(str(SEED)), "seq_id", "ln", "wi")).alias("word"))
    after = made.select(text.unit_pattern(text.units(F.col("word"), False)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("m"))
    before = made.groupBy(F.col("before").alias("pattern")).agg(F.count("*").alias("n"))
    return before.join(after, "pattern", "full").fillna(0, ["m", "n"]).select("pattern", "n", (F.col("m") - F.col("n")).alias("difference"))


@query(_SHAPES + f""",
sm AS (SELECT trial, currier, word FROM (SELECT x.trial, currier, word, row_number() OVER (PARTITION BY x.trial, currier ORDER BY md5(concat_ws('|', '{SEED}', x.trial, currier, seq_id, ln, wi)), seq_id, ln, wi) AS r, count(*) OVER (PARTITION BY x.trial, currier) AS c FROM tok, (SELECT unnest(range(1, 11)) AS trial) x) WHERE r <= 300 AND c >= 300),
sp AS (SELECT trial, currier, CAST(length(word) AS INTEGER) AS len, {_PAT} AS pattern, count(*) AS n FROM sm GROUP BY ALL),
d AS (SELECT trial, currier, lang, round(-ln(sum(sqrt((a.n / 300.0) * (b.n / b.t)))), 9) AS distance FROM sp a JOIN (SELECT *, sum(n) OVER (PARTITION BY lang) AS t FROM rs) b USING (len, pattern) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY trial, currier ORDER BY distance, lang) AS rank FROM d)
SELECT currier, lang, count(*) FILTER (rank = 1) AS wins, count(*) FILTER (rank <= 5) AS top5 FROM k GROUP BY ALL HAVING count(*) FILTER (rank <= 5) > 0""")
def matched_bootstrap_winners(spark, sf_dir):
    """In ten samples of 300 words of each stratum, which language's word shapes are nearest."""
    _, refs = _both(spark, sf_dir)
    words = token_facts(spark, sf_dir).select("currier", "seq_id", "ln", "wi", "word")
    return shape.bootstrap_winners(words, refs, ["currier"], "lang", 300, 10, SEED, ["seq_id", "ln", "wi"])


@query(rest(_CODED + """,
l AS (SELECT test, word, 'L:' || prev_word AS feature FROM en WHERE train AND word <> '<UNKNOWN>' AND prev_word IS NOT NULL), r AS (SELECT test, prev_word AS word, 'R:' || word AS feature FROM en WHERE train AND prev_word <> '<UNKNOWN>'),
jn AS (SELECT test, word, feature, count(*) AS n FROM (FROM l UNION ALL FROM r) GROUP BY ALL), w AS (SELECT *, n * sum(n) OVER (PARTITION BY test) / (sum(n) OVER (PARTITION BY test, word) * sum(n) OVER (PARTITION BY test, feature)) AS ratio FROM jn),
v AS (SELECT test, word, feature, log2(ratio) AS v FROM w WHERE ratio > 1)
SELECT test, word, feature, round(v / sqrt(sum(v * v) OVER (PARTITION BY test, word)), 6) AS value FROM v"""))
def ppmi_vectors(spark, sf_dir):
    rows = residual.held_out(_two_folds(spark, sf_dir), _V)
    v = experts.ppmi(rows.where("train").select("test", "prev_word", "word"), ["test"])
    return v.select("test", "word", "feature", F.round("value", 6).alias("value"))
