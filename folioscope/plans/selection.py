"""Filters, lookups, set operations, ranks and summaries as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import resample, stats, tokens
from folioscope.operators.ranking import ranked_rows
from folioscope.plans.common import CORPORA_SQL, SEED, UNITS_SQL, corpora, page_lines, token_facts, with_pages
from folioscope.sources.tables import once, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def pages_sql(sql: str) -> str:
    return with_pages("@@").replace("\n@@", ",\n" + sql)


def corpora_sql(sql: str) -> str:
    return f"WITH {CORPORA_SQL.strip()},\n{sql}"


_LOCI = "l0 AS (SELECT DISTINCT ON (locus_no) locus_no, substring(locus_type, 1, 1) AS kind, certain_tokens FROM locus ORDER BY locus_no), lw AS (SELECT locus_no, kind, unnest(regexp_extract_all(certain_tokens, '[a-z]+', 0)) AS word FROM l0 WHERE certain_tokens IS NOT NULL)"


def _locus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    loci = once(table(spark, sf_dir, "locus"), "locus_no", "locus_type", "certain_tokens")
    return loci.select("locus_no", F.substring("locus_type", 1, 1).alias("kind"), F.explode(F.regexp_extract_all("certain_tokens", F.lit("([a-z]+)"), F.lit(1))).alias("word"))


@query(f"WITH {_LOCI}, c AS (SELECT kind, word, count(*) AS n FROM lw GROUP BY ALL) SELECT c.kind, any_value(l.loci) AS loci, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS types, count(*) FILTER (n = 1) AS hapax FROM c JOIN (SELECT kind, count(DISTINCT locus_no) AS loci FROM lw GROUP BY kind) l USING (kind) GROUP BY c.kind")
def locus_type_summary(spark, sf_dir):
    """Loci that hold certain words, their words, types and words seen once, by kind of locus."""
    w = _locus_words(spark, sf_dir)
    loci = w.groupBy("kind").agg(F.count_distinct("locus_no").alias("loci"))
    return w.groupBy("kind", "word").agg(F.count("*").alias("n")).groupBy("kind").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("hapax")).join(loci, "kind")


@query(f"WITH {_LOCI}, p AS (SELECT DISTINCT word FROM lw WHERE kind = 'P'), l AS (SELECT word, count(*) AS n FROM lw WHERE kind = 'L' GROUP BY word) SELECT CAST(sum(n) AS BIGINT) AS tokens, CAST(coalesce(sum(n) FILTER (p.word IS NOT NULL), 0) AS BIGINT) AS attested_tokens, count(*) AS types, count(p.word) AS attested_types FROM l LEFT JOIN p USING (word)")
def label_overlap(spark, sf_dir):
    """Label words that stand in paragraphs too: a semi-join kept as a flag."""
    w = _locus_words(spark, sf_dir)
    labels = w.where("kind = 'L'").groupBy("word").agg(F.count("*").alias("n"))
    j = labels.join(w.where("kind = 'P'").select("word", F.lit(True).alias("p")).distinct(), "word", "left")
    return j.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(F.col("p"), F.col("n"))), F.lit(0)).alias("attested_tokens"), F.count("*").alias("types"), F.count("p").alias("attested_types"))


@query("""WITH a AS (SELECT DISTINCT folio AS x FROM documents WHERE folio IS NOT NULL), b AS (SELECT DISTINCT name AS x FROM page_sequence WHERE name IS NOT NULL)
SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS in_both, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS documents_only, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS pages_only""")
def page_set_comparison(spark, sf_dir):
    """Intersection and both differences of the page names of two tables, by one distributed count of sides."""
    a = table(spark, sf_dir, "documents").select(F.col("folio").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = table(spark, sf_dir, "page_sequence").select(F.col("name").alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    s = a.unionByName(b).where("x is not null").groupBy("x").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return s.agg(F.count_if(F.expr("a = 1 and b = 1")).alias("in_both"), F.count_if(F.expr("a = 1 and b = 0")).alias("documents_only"), F.count_if(F.expr("a = 0 and b = 1")).alias("pages_only"))


@query("""SELECT d.name AS page, count(*) AS words FROM (SELECT DISTINCT ON (seq_id) seq_id, name, lines FROM page_sequence ORDER BY seq_id) d, (SELECT 1) WHERE name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents x WHERE x.folio = d.name) GROUP BY d.name""")
def pages_without_documents(spark, sf_dir):
    """Pages that miss what is required of them: a left anti-join on the names."""
    pages = once(table(spark, sf_dir, "page_sequence"), "seq_id", "name").where("name is not null")
    return pages.join(table(spark, sf_dir, "documents").select(F.col("folio").alias("name")), "name", "left_anti").groupBy(F.col("name").alias("page")).agg(F.count("*").alias("words"))


@query("""WITH c AS (SELECT DISTINCT ON (corpus_id) corpus_id, lower(split_part(name, '_', 1)) AS lang FROM corpus ORDER BY corpus_id), r AS (SELECT lang, count(*) AS n FROM lang_reference GROUP BY lang)
SELECT c.lang, count(*) AS corpora, coalesce(CAST(any_value(r.n) AS VARCHAR), 'unknown') AS reference FROM c LEFT JOIN r USING (lang) GROUP BY c.lang""")
def corpus_reference_lookup(spark, sf_dir):
    """Left join to a dimension with a default; corpora are counted before they meet it."""
    c = once(table(spark, sf_dir, "corpus"), "corpus_id", "name").groupBy(F.lower(F.substring_index("name", "_", 1)).alias("lang")).agg(F.count("*").alias("corpora"))
    r = table(spark, sf_dir, "lang_reference").groupBy("lang").agg(F.count("*").alias("n"))
    return c.join(r, "lang", "left").select("lang", "corpora", F.coalesce(F.col("n").cast("string"), F.lit("unknown")).alias("reference"))


@query("""WITH c AS (SELECT DISTINCT name, row_number() OVER (ORDER BY name) AS rank FROM (SELECT DISTINCT name FROM corpus WHERE name IS NOT NULL)), q AS (SELECT DISTINCT lang FROM lang_reference)
SELECT q.lang, min(name) AS first_name, min(rank) AS rank, count(*) AS hits FROM q JOIN c ON contains(lower(name), q.lang) GROUP BY q.lang""")
def first_containing_name(spark, sf_dir):
    """First name in order that contains a text, with its rank; the texts are a small table, broadcast by its size."""
    names = ranked_rows(table(spark, sf_dir, "corpus").select("name").where("name is not null").distinct(), [], ["name"], "r")
    q = table(spark, sf_dir, "lang_reference").select("lang").distinct()
    hits = names.join(F.broadcast(q), F.contains(F.lower("name"), F.col("lang")))  # eight codes, a fixed table
    return hits.groupBy("lang").agg(F.min("name").alias("first_name"), (F.min("r") + 1).alias("rank"), F.count("*").alias("hits"))


@query(pages_sql("""t AS (SELECT fold, word FROM (SELECT fold, word, row_number() OVER (PARTITION BY fold ORDER BY n DESC, f) AS r FROM (SELECT fold, word, count(*) AS n, min((seq_id, ln, wi)) AS f FROM tok GROUP BY ALL)) WHERE r <= 20)
SELECT a.fold AS first, b.fold AS second, count(*) AS agreeing FROM t a JOIN t b ON a.word = b.word AND a.fold < b.fold GROUP BY ALL"""))
def fold_agreement(spark, sf_dir):
    """Words that two folds have in common among their 20 most frequent: pairs are made over a word's folds, not over folds."""
    t = stats.top_words(token_facts(spark, sf_dir), 20, ["seq_id", "ln", "wi"], by=["fold"]).groupBy("word").agg(F.array_sort(F.collect_set("fold")).alias("f"))
    first = t.select("f", F.explode("f").alias("first"))
    return first.select("first", F.explode(F.filter("f", lambda x: x > F.col("first"))).alias("second")).groupBy("first", "second").agg(F.count("*").alias("agreeing"))


@query(corpora_sql("""n AS (SELECT lang, lower(word) AS w, count(*) AS n FROM cw GROUP BY ALL), s AS (SELECT lang, sqrt(sum(CAST(n AS DOUBLE) * n)) AS z FROM n GROUP BY lang)
SELECT a.lang AS first, b.lang AS second, round(sum(CAST(a.n AS DOUBLE) * b.n) / any_value(x.z) / any_value(y.z), 6) AS cosine FROM n a JOIN n b ON a.w = b.w AND a.lang < b.lang JOIN s x ON x.lang = a.lang JOIN s y ON y.lang = b.lang GROUP BY ALL"""))
def language_cosine(spark, sf_dir):
    """Cosine of the word counts of languages: sparse dot products, made in each word's list of languages."""
    n = corpora(spark, sf_dir).select("lang", F.explode("words").alias("w")).groupBy("lang", F.lower("w").alias("w")).agg(F.count("*").cast("double").alias("n"))
    norm = n.groupBy("lang").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("z"))
    by = n.groupBy("w").agg(F.collect_list(F.struct("lang", "n")).alias("v")).where(F.size("v") > 1)
    pairs = by.select("v", F.explode("v").alias("a")).select("a", F.explode(F.filter("v", lambda x: x["lang"] > F.col("a.lang"))).alias("b"))
    dot = pairs.groupBy(F.col("a.lang").alias("first"), F.col("b.lang").alias("second")).agg(F.sum(F.col("a.n") * F.col("b.n")).alias("d"))
    return dot.join(norm.toDF("first", "x"), "first").join(norm.toDF("second", "y"), "second").select("first", "second", F.round(F.col("d") / F.col("x") / F.col("y"), 6).alias("cosine"))


@query("""WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE n_chars IS NOT NULL AND source IS NOT NULL)
SELECT source, max(n_chars) FILTER (r = CAST(round_even(0.25 * (n - 1), 0) AS BIGINT)) AS q25, max(n_chars) FILTER (r = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT)) AS q50, max(n_chars) FILTER (r = greatest(0, CAST(floor(0.05 * n) AS BIGINT) - 1)) AS q05, max(n_chars) FILTER (r = least(n - 1, CAST(floor(0.95 * n) AS BIGINT))) AS q95 FROM r GROUP BY source""")
def exact_quantiles(spark, sf_dir):
    """Both rules of quantiles: the element at round-half-even(p (n - 1)), and those at floor(.05 n) - 1 and floor(.95 n)."""
    r = ranked_rows(table(spark, sf_dir, "documents").select("source", "n_chars", "doc_id").where("n_chars is not null and source is not null"), ["source"], ["n_chars", "doc_id"], "r", "n")
    at = lambda i, name: F.max(F.when(F.col("r") == i, F.col("n_chars"))).alias(name)
    n = F.col("n")
    return r.groupBy("source").agg(at(F.bround(0.25 * (n - 1), 0).cast("long"), "q25"), at(F.bround(0.5 * (n - 1), 0).cast("long"), "q50"), at(F.greatest(F.lit(0), F.floor(0.05 * n) - 1), "q05"), at(F.least(n - 1, F.floor(0.95 * n)), "q95"))


@query(pages_sql("""w AS (SELECT fold, topic, count(*) AS n FROM tok GROUP BY ALL), p AS (SELECT fold, topic, n / sum(n) OVER (PARTITION BY fold) AS w FROM w),
e AS (SELECT f.fold, t.topic, coalesce(p.w, 0.0) AS w FROM (SELECT DISTINCT fold FROM w) f CROSS JOIN (SELECT DISTINCT topic FROM w) t LEFT JOIN p ON p.fold = f.fold AND p.topic = t.topic)
SELECT topic, round(avg(w), 6) AS mean, round(median(w), 6) AS median, round(min(w), 6) AS least, round(max(w), 6) AS most FROM e GROUP BY topic HAVING avg(w) >= 0.01"""))
def weight_summary(spark, sf_dir):
    """Weights of topics made to sum to 1 in each fold, then over folds, a missing one as 0; reported from a mean of .01 on."""
    n = token_facts(spark, sf_dir).groupBy("fold", "topic").agg(F.count("*").alias("n"))
    folds = n.groupBy("fold").agg(F.sum("n").alias("all"))
    every = folds.select("fold").crossJoin(F.broadcast(n.select("topic").distinct()))  # folds x topics: labels of the layout
    w = every.join(n, ["fold", "topic"], "left").join(folds, "fold").withColumn("w", F.coalesce("n", F.lit(0)) / F.col("all"))
    out = w.groupBy("topic").agg(F.avg("w").alias("mean"), F.median("w").alias("median"), F.min("w").alias("least"), F.max("w").alias("most")).where("mean >= 0.01")
    return out.select("topic", *[F.round(c, 6).alias(c) for c in ("mean", "median", "least", "most")])


@query(pages_sql("""x AS (SELECT t.*, v.test FROM tok t, (SELECT DISTINCT fold AS test FROM tok) v), vo AS (SELECT test, word FROM (SELECT test, word, row_number() OVER (PARTITION BY test ORDER BY count(*) DESC, min((seq_id, ln, wi))) AS r FROM x WHERE fold <> test GROUP BY test, word) WHERE r < 512)
SELECT t.fold, count(*) AS words, count(vo.word) AS covered, round(count(vo.word) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM tok t LEFT JOIN vo ON vo.test = t.fold AND vo.word = t.word GROUP BY t.fold"""))
def vocabulary_coverage(spark, sf_dir):
    """Share of each fold's words among the 511 most frequent words of the other folds: counts of the whole less the fold's own."""
    t = token_facts(spark, sf_dir).groupBy("fold", "word").agg(F.count("*").alias("own"), F.min(F.struct("seq_id", "ln", "wi")).alias("first"))
    folds = t.select(F.col("fold").alias("test")).distinct()
    per = t.groupBy("word").agg(F.sum("own").alias("all"), F.collect_list(F.struct("fold", "own", "first")).alias("f"))  # one entry a fold
    others = per.crossJoin(F.broadcast(folds)).withColumn("o", F.filter("f", lambda x: x["fold"] != F.col("test"))).where(F.size("o") > 0)
    n, first = F.aggregate("o", F.lit(0).cast("long"), lambda a, x: a + x["own"]), F.array_min(F.transform("o", lambda x: x["first"]))
    ranked = others.select("test", "word", n.alias("n"), first.alias("first")).withColumn("r", F.row_number().over(Window.partitionBy("test").orderBy(F.desc("n"), "first"))).where("r < 512")
    j = t.join(ranked.select(F.col("test").alias("fold"), "word", F.lit(True).alias("v")), ["fold", "word"], "left")
    covered = F.sum(F.when(F.col("v"), F.col("own")).otherwise(0))
    return j.groupBy("fold").agg(F.sum("own").alias("words"), covered.alias("covered"), F.round(covered / F.sum("own"), 6).alias("coverage"))


@query(corpora_sql("""e AS (SELECT lang, corpus_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS h FROM (SELECT lang, corpus_id, word, count(*) AS n FROM cw GROUP BY ALL) GROUP BY ALL),
m AS (SELECT lang, round(median(h), 6) AS h, count(*) AS corpora FROM e GROUP BY lang)
SELECT lang, corpora, h AS median_bits, rank() OVER (ORDER BY h, lang) AS rank, round((count(*) OVER (ORDER BY h RANGE UNBOUNDED PRECEDING)) / (count(*) OVER () + 0.0), 6) AS bound FROM m"""))
def reference_rank_bound(spark, sf_dir):
    """Median word entropy of each language's corpora, and where it lies in the range of all: (others at or below + 1) / (others + 1)."""
    n = corpora(spark, sf_dir).select("lang", "corpus_id", F.explode("words").alias("word"))
    e = stats.entropy(n, "word", ["lang", "corpus_id"]).withColumn("h", F.round("entropy", 6))
    m = e.groupBy("lang").agg(F.round(F.median("h"), 6).alias("h"), F.count("*").alias("corpora"))  # one row a language from here on
    over = Window.orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return m.select("lang", "corpora", F.col("h").alias("median_bits"), F.row_number().over(Window.orderBy("h", "lang")).cast("long").alias("rank"), F.round(F.count("*").over(over) / F.count("*").over(Window.partitionBy()), 6).alias("bound"))


_VOTES = """tw AS (SELECT topic, word FROM (SELECT topic, word, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, min((seq_id, ln, wi))) AS r FROM tok WHERE topic NOT IN ('?', '@') GROUP BY topic, word) WHERE r <= 50),
v AS (SELECT t.seq_id, t.topic AS truth, w.topic AS candidate, CAST(count(*) AS DOUBLE) AS votes FROM tok t JOIN tw w USING (word) WHERE t.topic NOT IN ('?', '@') GROUP BY ALL),
s AS (SELECT v.*, max(votes) FILTER (candidate = truth) OVER (PARTITION BY seq_id) AS own FROM v),
g AS (SELECT seq_id, truth, any_value(own) AS own, count(*) FILTER (votes > own + 1e-9 * own) AS above, count(*) FILTER (abs(votes - own) <= 1e-9 * greatest(votes, own)) AS level FROM s GROUP BY seq_id, truth)"""


@query(pages_sql(_VOTES + "\nSELECT truth, count(*) AS pages, round(sum(CASE WHEN own IS NULL THEN 0 WHEN above = 0 THEN 1.0 / level ELSE 0 END), 6) AS top1, round(sum(CASE WHEN own IS NULL THEN 0 ELSE 1 / (above + (level + 1) / 2.0) END) / count(*), 6) AS mrr FROM g GROUP BY truth"))
def version_space_votes(spark, sf_dir):
    """Votes of a page's words for topics; credit for the first place is shared by ties, the reciprocal rank takes the middle of ties."""
    t = token_facts(spark, sf_dir).where(~F.col("topic").isin("?", "@"))
    top = stats.top_words(t, 50, ["seq_id", "ln", "wi"], by=["topic"]).select(F.col("topic").alias("candidate"), "word")
    n = t.groupBy("seq_id", F.col("topic").alias("truth"), "word").agg(F.count("*").alias("n"))
    v = n.join(top, "word").groupBy("seq_id", "truth", "candidate").agg(F.sum("n").cast("double").alias("votes"))
    own = v.groupBy("seq_id", "truth").agg(F.max(F.when(F.col("candidate") == F.col("truth"), F.col("votes"))).alias("own"), F.collect_list("votes").alias("v"))  # one entry a topic
    o = F.col("own")
    above, level = F.size(F.filter("v", lambda x: x > o + 1e-9 * o)), F.size(F.filter("v", lambda x: F.abs(x - o) <= 1e-9 * F.greatest(x, o)))
    top1 = F.when(o.isNull(), 0.0).when(above == 0, 1.0 / level).otherwise(0.0)
    mrr = F.when(o.isNull(), 0.0).otherwise(1 / (above + (level + 1) / 2))
    return own.groupBy("truth").agg(F.count("*").alias("pages"), F.round(F.sum(top1), 6).alias("top1"), F.round(F.sum(mrr) / F.count("*"), 6).alias("mrr"))


@query("""WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL)
SELECT user_id, round(sum(value * CASE WHEN r = 0 THEN 0.9 ** (n - 1) ELSE 0.1 * 0.9 ** (n - 1 - r) END), 6) AS ewma FROM e GROUP BY user_id""")
def moving_average(spark, sf_dir):
    """Exponential average with weights .9 and .1 in closed form over ranks, so that no user's history is one row."""
    e = ranked_rows(table(spark, sf_dir, "events").where("value is not null").select("user_id", "value", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "r", "n")
    power = F.pow(F.lit(0.9), F.col("n") - 1 - F.col("r"))
    return e.groupBy("user_id").agg(F.round(F.sum(F.col("value") * F.when(F.col("r") == 0, power).otherwise(0.1 * power)), 6).alias("ewma"))


@query("""SELECT coalesce(family, 'unknown') AS family, arg_max(name, (len(words), name)) AS largest, max(len(words)) AS words, arg_max(corpus_id, (made_at, corpus_id)) AS latest FROM corpus WHERE words IS NOT NULL AND name IS NOT NULL AND made_at IS NOT NULL GROUP BY ALL""")
def best_per_key(spark, sf_dir):
    """Keyed upserts: the best one wins (longest, then by name), and the last one wins."""
    c = table(spark, sf_dir, "corpus").where("words is not null and name is not null and made_at is not null").select(F.coalesce("family", F.lit("unknown")).alias("family"), "corpus_id", "name", "made_at", F.size("words").cast("long").alias("n"))
    return c.groupBy("family").agg(F.max_by("name", F.struct("n", "name")).alias("largest"), F.max("n").alias("words"), F.max_by("corpus_id", F.struct("made_at", "corpus_id")).alias("latest"))


@query(pages_sql("""m AS (SELECT fold, avg(length(word)) AS v FROM tok GROUP BY fold) SELECT count(*) AS folds, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(min(v), 6) AS least, round(max(v), 6) AS most FROM m"""))
def fold_summary(spark, sf_dir):
    """Mean, median and range over folds of a value of each fold."""
    m = token_facts(spark, sf_dir).groupBy("fold").agg(F.avg(F.length("word")).alias("v"))
    return m.agg(F.count("*").alias("folds"), *[F.round(f("v"), 6).alias(a) for f, a in ((F.avg, "mean"), (F.median, "median"), (F.min, "least"), (F.max, "most"))])


@query(pages_sql("""r AS (SELECT seq_id, CAST(len(flatten(lines)) AS BIGINT) AS words, row_number() OVER (ORDER BY seq_id) - 1 AS r FROM pg WHERE len(lines) > 0)
SELECT rule, part, count(*) AS pages, CAST(sum(words) AS BIGINT) AS words FROM (SELECT 'alternating' AS rule, CASE WHEN r % 2 = 0 THEN 'first' ELSE 'second' END AS part, words FROM r UNION ALL SELECT 'every_fifth', CASE WHEN r % 5 = 0 THEN 'evaluation' ELSE 'training' END, words FROM r UNION ALL SELECT 'modulo_of_id', CASE WHEN seq_id % 5 = 0 THEN 'calibration' ELSE 'source' END, words FROM r) GROUP BY ALL"""))
def split_rules(spark, sf_dir):
    """Pages in two alternating folds, every fifth for evaluation, and split by the id modulo five."""
    r = ranked_rows(page_lines(spark, sf_dir).select("seq_id", F.size(F.flatten("lines")).cast("long").alias("words")), [], ["seq_id"], "r")
    rules = F.array(
        F.struct(F.lit("alternating").alias("rule"), F.when(F.col("r") % 2 == 0, "first").otherwise("second").alias("part")),
        F.struct(F.lit("every_fifth").alias("rule"), F.when(F.col("r") % 5 == 0, "evaluation").otherwise("training").alias("part")),
        F.struct(F.lit("modulo_of_id").alias("rule"), F.when(F.col("seq_id") % 5 == 0, "calibration").otherwise("source").alias("part")))
    return r.select("words", F.inline(rules)).groupBy("rule", "part").agg(F.count("*").alias("pages"), F.sum("words").alias("words"))


@query(f"""WITH i AS (SELECT unnest(range(0, 6)) AS slot), p AS (SELECT unnest(range(1, 40)) AS perm), s AS (SELECT perm, slot, row_number() OVER (PARTITION BY perm ORDER BY md5(concat_ws('|', '{SEED}', perm, slot)), slot) - 1 AS target FROM p, i)
SELECT perm, string_agg(CAST(target AS VARCHAR), ' ' ORDER BY slot) AS targets FROM s GROUP BY perm HAVING count(*) FILTER (slot <> target) > 0""")
def block_permutations(spark, sf_dir):
    """Assignments of targets to six blocks in seeded order, without the identity; blocks are a fixed, small design."""
    p = spark.range(1, 40).withColumnRenamed("id", "perm")
    slots = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.struct(F.md5(F.concat_ws("|", F.lit(str(SEED)), F.col("perm").cast("string"), k.cast("string"))).alias("h"), k.alias("k"))))
    ranks = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.array_position(F.transform(slots, lambda x: x["k"]), k) - 1)
    return p.select("perm", F.array_join(F.transform(ranks, lambda x: x.cast("string")), " ").alias("targets")).where("targets <> '0 1 2 3 4 5'")


@query(pages_sql("""s AS (SELECT seq_id, ln, wi, word, row_number() OVER (ORDER BY seq_id, ln, wi) AS slot, row_number() OVER (ORDER BY md5(concat_ws('|', '408', 'global', seq_id, ln, wi)), seq_id, ln, wi) AS h FROM tok)
SELECT a.seq_id, md5(string_agg(b.word, ' ' ORDER BY a.ln, a.wi)) AS digest FROM s a JOIN s b ON a.slot = b.h GROUP BY a.seq_id"""))
def global_reshape(spark, sf_dir):
    """All words of the corpus in one seeded order, laid on the slots of its lines: ranks of the whole table without one window."""
    t = token_facts(spark, sf_dir).select("seq_id", "ln", "wi", "word")
    out = resample.shuffle_within(t, ["word"], [], ["seq_id", "ln", "wi"], SEED, "global")
    words = F.transform(F.array_sort(F.collect_list(F.struct("ln", "wi", "word"))), lambda x: x["word"])
    return out.groupBy("seq_id").agg(F.md5(F.array_join(words, " ")).alias("digest"))


@query(pages_sql("e AS (SELECT DISTINCT seq_id, topic FROM tok) SELECT topic, count(*) AS pages, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM e WHERE topic NOT IN ('?', '@') GROUP BY topic"))
def topic_histogram(spark, sf_dir):
    """Pages of each topic among those that state one."""
    n = page_lines(spark, sf_dir).where(~F.col("topic").isin("?", "@")).groupBy("topic").agg(F.count("*").alias("pages"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("pages").alias("all")))).select("topic", "pages", F.round(F.col("pages") / F.col("all"), 6).alias("share"))


@query(corpora_sql("""c AS (SELECT DISTINCT ON (corpus_id) corpus_id, family FROM corpus ORDER BY corpus_id), a AS (SELECT corpus_id, lang, count(DISTINCT lower(u)) AS letters FROM (SELECT corpus_id, lang, unnest(string_split(word, '')) AS u FROM cw) GROUP BY ALL)
SELECT CASE WHEN starts_with(family, 'historical') THEN 'historical' ELSE 'modern' END AS cohort, count(*) AS corpora, count(*) FILTER (letters BETWEEN 15 AND 35) AS alphabetic, count(*) FILTER (ends_with(family, 'semitic') AND NOT starts_with(lang, 'a')) AS semitic FROM a JOIN c USING (corpus_id) WHERE family IS NOT NULL GROUP BY ALL"""))
def cohort_filters(spark, sf_dir):
    """Cohorts by prefix and pattern of names and by size of alphabet."""
    c = once(table(spark, sf_dir, "corpus"), "corpus_id", "family").where("family is not null")
    letters = F.size(F.array_distinct(F.flatten(F.transform("words", lambda w: F.split(F.lower(w), "")))))
    a = corpora(spark, sf_dir).select("corpus_id", "lang", letters.alias("letters")).join(c, "corpus_id")
    return a.groupBy(F.when(F.startswith("family", F.lit("historical")), "historical").otherwise("modern").alias("cohort")).agg(F.count("*").alias("corpora"), F.count_if(F.col("letters").between(15, 35)).alias("alphabetic"), F.count_if(F.endswith("family", F.lit("semitic")) & ~F.startswith("lang", F.lit("a"))).alias("semitic"))


@query("""WITH l0 AS (SELECT DISTINCT ON (locus_no) locus_no, page, locus_type, tokens, certain_tokens FROM locus ORDER BY locus_no)
SELECT page, count(*) AS labels, count(*) FILTER (tokens = certain_tokens) AS certain, md5(string_agg(CASE WHEN tokens = certain_tokens THEN array_to_string(regexp_extract_all(certain_tokens, '[a-z]+', 0), '') ELSE '' END, '|' ORDER BY locus_no)) AS digest FROM l0 WHERE locus_type = 'Lz' GROUP BY page""")
def label_extraction(spark, sf_dir):
    """Labels whose every word is certain, their words joined, by page."""
    l = once(table(spark, sf_dir, "locus").where("locus_type = 'Lz'"), "locus_no", "page", "tokens", "certain_tokens")
    made = F.when(F.col("tokens") == F.col("certain_tokens"), F.array_join(F.regexp_extract_all("certain_tokens", F.lit("([a-z]+)"), F.lit(1)), "")).otherwise("")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("locus_no", made.alias("m")))), lambda x: x["m"])
    return l.groupBy("page").agg(F.count("*").alias("labels"), F.count_if(F.col("tokens") == F.col("certain_tokens")).alias("certain"), F.md5(F.array_join(rows, "|")).alias("digest"))


@query(pages_sql(f"""u AS (SELECT unnest({UNITS_SQL.format(w='word')}) AS x FROM tok), a AS (SELECT x, row_number() OVER (ORDER BY count(*) DESC, x) AS r, row_number() OVER (ORDER BY count(*), x) AS rare FROM u GROUP BY x),
l AS (SELECT unnest(string_split(lower(w), '')) AS y FROM (SELECT unnest(words) AS w FROM (SELECT DISTINCT ON (corpus_id) words, name FROM corpus ORDER BY corpus_id) WHERE starts_with(name, 'fr_'))), b AS (SELECT y, row_number() OVER (ORDER BY count(*) DESC, y) AS r FROM l WHERE regexp_full_match(y, '[a-z]') GROUP BY y)
SELECT x AS cipher, y AS plain, r AS rank, rare <= 2 AS rarest FROM a JOIN b USING (r)"""))
def frequency_key(spark, sf_dir):
    """Units and letters matched by rank of frequency, and the two rarest units: alphabets are bounded, so one window each is fine."""
    a = token_facts(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n")).select("n", F.explode(text.units(F.col("word"))).alias("x")).groupBy("x").agg(F.sum("n").alias("n"))
    a = a.select(F.col("x").alias("cipher"), F.row_number().over(Window.orderBy(F.desc("n"), "x")).alias("rank"), (F.row_number().over(Window.orderBy("n", "x")) <= 2).alias("rarest"))
    words = once(table(spark, sf_dir, "corpus"), "corpus_id", "name", "words").where(F.startswith("name", F.lit("fr_"))).select(F.explode("words").alias("w"))
    b = words.select(F.explode(F.split(F.lower("w"), "")).alias("y")).where(F.col("y").rlike("^[a-z]$")).groupBy("y").agg(F.count("*").alias("n"))
    return a.join(b.select(F.col("y").alias("plain"), F.row_number().over(Window.orderBy(F.desc("n"), "y")).alias("rank")), "rank").select("cipher", "plain", F.col("rank").cast("long").alias("rank"), "rarest")


@query("""WITH h AS (SELECT DISTINCT ON (entry_id) entry_id, heading FROM herbal_entry ORDER BY entry_id), w AS (SELECT entry_id, regexp_replace(heading, '\\s+', '', 'g') AS t FROM h WHERE heading IS NOT NULL), f AS (SELECT DISTINCT entry_id, substring(t, 1, k) AS form FROM w, (SELECT CAST(unnest(range(2, 40)) AS INTEGER) AS k) WHERE length(t) >= k)
SELECT form, count(*) AS entries FROM f GROUP BY form HAVING count(*) > 1""")
def heading_forms(spark, sf_dir):
    """Prefixes of headings, longest first and once each, that several entries share."""
    h = once(table(spark, sf_dir, "herbal_entry"), "entry_id", "heading").where("heading is not null")
    return h.select("entry_id", F.explode(text.title_forms(F.col("heading"))).alias("form")).groupBy("form").agg(F.count("*").alias("entries")).where("entries > 1")


@query("""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s)<p>(.*?)</p>', 1)) AS p, generate_subscripts(regexp_extract_all(text, '(?s)<p>(.*?)</p>', 1), 1) AS k FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS paragraphs, md5(string_agg(trim(regexp_replace(regexp_replace(regexp_replace(p, '\\[[^\\]]*\\]', '', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '|' ORDER BY k)) AS digest FROM m GROUP BY doc_id""")
def markup_paragraphs(spark, sf_dir):
    """Paragraphs between tags, without bracketed notes, tags and doubled white space."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.paragraphs(F.col("text")).alias("p")).where(F.size("p") > 0)
    return d.select("doc_id", F.size("p").cast("long").alias("paragraphs"), F.md5(F.array_join("p", "|")).alias("digest"))


@query()
def skipped_header_text(spark, sf_dir):
    """Texts without their first two lines, roman numerals and bracketed notes."""
    lines = F.split("text", "\n")
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & (F.size(lines) > 2))
    return d.select("doc_id", F.md5(text.drop_romans_and_brackets(F.array_join(F.slice(lines, F.lit(3), F.size(lines)), " "))).alias("digest"))


@query("""WITH m AS (SELECT doc_id, text, strpos(text, '<p>') AS a FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, text, a, strpos(substring(text, a + 3), '</p>') AS n FROM m WHERE a > 0)
SELECT doc_id, len(regexp_extract_all(replace(lower(substring(text, a + 3, n - 1)), 'ß', 'ss'), '\\p{L}+', 0)) AS words FROM e WHERE n > 0""")
def anchored_slice(spark, sf_dir):
    """Words between the first opening anchor and the next closing one; texts that lack one give no row."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.between_anchors(F.col("text"), "<p>", "</p>").alias("s")).where("s is not null")
    return d.select("doc_id", F.size(text.plain_words(F.col("s"))).cast("long").alias("words"))
