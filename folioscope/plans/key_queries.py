"""Keys, formulas and source analogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import formulas, keys
from folioscope.plans.common import UNITS_SQL
from folioscope.sources.tables import once, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_MULTI = "list_sort(list_transform(list_distinct({a}), lambda s: len(list_filter({a}, lambda x: x = s))))"
_LABELS = f"WITH h0 AS (SELECT DISTINCT ON (entry_id) entry_id, heading FROM herbal_entry ORDER BY entry_id), f AS (SELECT DISTINCT replace(trim(heading, ' '), ' ', '') AS form FROM h0 WHERE heading IS NOT NULL),\nw0 AS (SELECT DISTINCT word FROM sequence_record WHERE trim(word) <> ''), l AS (SELECT word, {UNITS_SQL.format(w='word')} AS u FROM w0)"


def _labels(spark, sf_dir):
    forms = once(table(spark, sf_dir, "herbal_entry"), "entry_id", "heading").where("heading is not null").select(F.replace(F.trim("heading"), F.lit(" "), F.lit("")).alias("form")).distinct()
    words = table(spark, sf_dir, "sequence_record").select("word").distinct().where(F.trim("word") != "")
    return words.withColumn("u", text.units(F.col("word"))), forms


@query(_LABELS + f""",
s AS (SELECT form, string_split(form, '') AS p FROM f), x AS (SELECT len(u) AS n, {_MULTI.format(a='u')} AS m, count(*) AS words FROM l GROUP BY ALL)
SELECT form, CAST(sum(words * list_reduce(list_transform(list_distinct(m), lambda k: CAST(factorial(CAST(len(list_filter(m, lambda y: y = k)) AS INTEGER)) AS BIGINT)), lambda a, b: a * b)) AS BIGINT) AS keys FROM s JOIN x ON x.n = len(p) AND x.m = {_MULTI.format(a='p')} GROUP BY form""")
def anagram_key_counts(spark, sf_dir):
    """One-to-one keys that make words anagrams of headings, by heading: words and headings meet on their multiplicities."""
    words, forms = _labels(spark, sf_dir)
    count = lambda a: F.array_sort(F.transform(F.array_distinct(a), lambda s: F.size(F.filter(a, lambda x: x == s))))
    by = words.groupBy(F.array_join(count(F.col("u")).cast("array<string>"), ",").alias("m")).agg(F.count("*").alias("words"), F.first("u").alias("u"))
    p = F.split("form", "")
    met = forms.withColumn("p", p).withColumn("m", F.array_join(count(F.col("p")).cast("array<string>"), ",")).join(by, "m")
    return met.select("form", (F.col("words") * keys.anagram_key_count(F.col("u"), F.col("p"))).alias("keys"))


@query(_LABELS + """,
d AS (SELECT word, form, list_distinct(list_transform(range(1, len(u) + 1), lambda i: u[i] || chr(31) || form[i])) AS pr, list_distinct(u) AS cu, list_distinct(string_split(form, '')) AS pu FROM l, f WHERE len(u) = length(form))
SELECT form, count(*) AS labels FROM d WHERE len(pr) = len(cu) AND len(pr) = len(pu) GROUP BY form""")
def mapping_constraints(spark, sf_dir):
    """How many words read each heading under some one-to-one key. There is one exactly if both have the same pattern of
    first occurrences (abca: 1,2,3,1), so words are counted by pattern and headings look theirs up."""
    words, forms = _labels(spark, sf_dir)
    pattern = lambda a: F.array_join(F.transform(a, lambda x: F.array_position(a, x).cast("string")), ",")
    counts = words.groupBy(pattern(F.col("u")).alias("pattern")).agg(F.count("*").alias("labels"))
    return forms.withColumn("p", F.split("form", "")).withColumn("pattern", pattern(F.col("p"))).join(counts, "pattern").select("form", "labels")


@query("SELECT n_nationkey AS k, CAST((n_nationkey + 1) * (12 * 64 * 64 + 13 * 64) + 2 * 64 + 64 * 1000 AS BIGINT) AS params, round(CASE WHEN n_nationkey < 5 THEN 0.001 * (n_nationkey + 1) / 6.0 WHEN n_nationkey > 20 THEN 0.0001 ELSE 0.0001 + 0.5 * (1 + cos(pi() * (n_nationkey - 5) / 15.0)) * 0.0009 END, 9) AS rate FROM nation")
def model_sizes_and_rates(spark, sf_dir):
    k = F.col("n_nationkey")
    d, v = F.lit(64).cast("long"), F.lit(1000).cast("long")
    return table(spark, sf_dir, "nation").select(k.alias("k"), formulas.decoder_params(d, k + 1, v, 4 * d).cast("long").alias("params"), F.round(formulas.learning_rate(k, 0.001, 0.0001, 5, 20), 9).alias("rate"))


@query("WITH b AS (SELECT 10.0 ** (17 + r_regionkey) AS c FROM region), g AS (SELECT c, 10.0 ** (7 + 5 * CAST(k AS DOUBLE) / 400) AS n FROM b, (SELECT unnest(range(0, 401)) AS k)), l AS (SELECT c, n, 1.69 + 406.4 / n ** 0.34 + 410.7 / (c / (6 * n)) ** 0.28 AS loss FROM g)\nSELECT round(log10(c), 3) AS log_c, round(log10(arg_min(n, loss)), 4) AS log_n, round(min(loss), 6) AS loss FROM l GROUP BY c")
def best_model_by_budget(spark, sf_dir):
    b = table(spark, sf_dir, "region").select(F.pow(F.lit(10.0), 17 + F.col("r_regionkey")).alias("c"))
    return formulas.best_split(b).select(F.round(F.log10("c"), 3).alias("log_c"), F.round(F.log10("n"), 4).alias("log_n"), F.round("loss", 6).alias("loss"))


@query("SELECT round(regr_slope(ln(p_retailprice), ln(p_size + 1)), 6) AS slope, round(regr_intercept(ln(p_retailprice), ln(p_size + 1)), 6) AS intercept FROM part WHERE p_retailprice > 0")
def log_log_fit(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_retailprice > 0").select((F.col("p_size") + 1).alias("x"), F.col("p_retailprice").alias("y"))
    return formulas.log_log_fit(p, "x", "y").select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("WITH s(section, lo, hi) AS (VALUES ('I', 0, 99), ('II', 100, 199), ('III', 200, 1000000)), d AS (SELECT DISTINCT ON (rec_id) rec_id, page_index FROM decomposition_record ORDER BY rec_id)\nSELECT section, count(*) AS words, count(DISTINCT page_index) AS pages FROM d JOIN s ON page_index BETWEEN lo AND hi GROUP BY section")
def range_join_sections(spark, sf_dir):
    """Words by section of their page number; three ranges are a fixed, tiny table."""
    s = spark.createDataFrame([("I", 0, 99), ("II", 100, 199), ("III", 200, 1000000)], "section string, lo int, hi int")
    d = once(table(spark, sf_dir, "decomposition_record"), "rec_id", "page_index").groupBy("page_index").agg(F.count("*").alias("n"))
    return d.join(F.broadcast(s), F.col("page_index").between(F.col("lo"), F.col("hi"))).groupBy("section").agg(F.sum("n").alias("words"), F.count("*").alias("pages"))
