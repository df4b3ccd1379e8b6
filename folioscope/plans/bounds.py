"""Resampling of both sides, coder comparisons, mixtures, formulas and clusters as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import coders, experts, formulas, keys, residual, resample, shape, tokens
from folioscope.plans.coding import _PREQ, _RES, _V, _sig, _two_folds, rest
from folioscope.plans.common import CORPORA_SQL, SEED, corpora, page_lines, token_facts
from folioscope.plans.shape_queries import _PAT, _SHAPES, _both
from folioscope.session import cut_lineage
from folioscope.sources.tables import once, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _dist(keys: str, name: str) -> str:
    return f"""{name} AS (SELECT currier, lang, -ln(sum(sqrt(p * q))) AS d FROM (SELECT currier, {keys}, sum(n) / any_value(t) AS p FROM (SELECT *, sum(n) OVER (PARTITION BY currier) AS t FROM ts) GROUP BY currier, {keys}) JOIN (SELECT lang, {keys}, sum(n) / any_value(t) AS q FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS t FROM rs) GROUP BY lang, {keys}) USING ({keys}) GROUP BY currier, lang)"""


@query(_SHAPES + f""",
{_dist('len, pattern', 'd1')}, {_dist('len', 'd2')},
tl AS (SELECT *, n / sum(n) OVER (PARTITION BY currier, len) AS p, sum(n) OVER (PARTITION BY currier, len) / sum(n) OVER (PARTITION BY currier) AS pl FROM ts), rl AS (SELECT *, n / sum(n) OVER (PARTITION BY lang, len) AS q FROM rs),
d3 AS (SELECT currier, lang, -ln(sum(pl * sqrt(p * q))) AS d FROM tl JOIN rl USING (len, pattern) GROUP BY ALL)
SELECT d1.currier, d1.lang, round(d1.d, 6) AS both_distance, round(d2.d, 6) AS length_distance, round(d3.d, 6) AS conditional_distance FROM d1 JOIN d2 USING (currier, lang) JOIN d3 USING (currier, lang)""")
def three_distances(spark, sf_dir):
    """Distance of each stratum to each language by shape, by length alone, and by pattern given length."""
    t, r = (cut_lineage(x) for x in _both(spark, sf_dir))
    by = ["currier", "lang"]
    whole = shape.distances(t, r, ["currier"], ["lang"], ["len", "pattern"]).withColumnRenamed("distance", "a")
    length = shape.distances(t, r, ["currier"], ["lang"], ["len"]).withColumnRenamed("distance", "b")
    cond = shape.conditional_distances(t, r, ["currier"], ["lang"]).withColumnRenamed("distance", "c")
    return whole.join(length, by).join(cond, by).select(*by, F.round("a", 6).alias("both_distance"), F.round("b", 6).alias("length_distance"), F.round("c", 6).alias("conditional_distance"))


_N, _T = 200, 20
_PICK = f"""sm AS (SELECT trial, currier, word FROM (SELECT x.trial, currier, word, row_number() OVER (PARTITION BY x.trial, currier ORDER BY md5(concat_ws('|', '{SEED}', x.trial, currier, seq_id, ln, wi)), seq_id, ln, wi) AS r, count(*) OVER (PARTITION BY x.trial, currier) AS c FROM tok, (SELECT unnest(range(1, {_T + 1})) AS trial) x) WHERE r <= {_N} AND c >= {_N}),
rm AS (SELECT trial, lang, lower(word) AS word FROM (SELECT x.trial, lang, word, row_number() OVER (PARTITION BY x.trial, lang ORDER BY md5(concat_ws('|', '{SEED}', x.trial, lang, corpus_id, pos)), corpus_id, pos) AS r, count(*) OVER (PARTITION BY x.trial, lang) AS c FROM cw, (SELECT unnest(range(1, {_T + 1})) AS trial) x) WHERE r <= {_N} AND c >= {_N}),
sp AS (SELECT trial, currier, length(word) AS len, {_PAT} AS pattern, count(*) AS n FROM sm GROUP BY ALL), rp AS (SELECT trial, lang, length(word) AS len, {_PAT} AS pattern, count(*) AS n FROM rm GROUP BY ALL),
d AS (SELECT trial, currier, lang, round(-ln(sum(sqrt(CAST(a.n AS DOUBLE) * b.n)) / {_N}), 9) AS distance FROM sp a JOIN rp b USING (trial, len, pattern) GROUP BY ALL)"""


def _resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trial, currier, lang, distance) with words of both sides sampled in every trial."""
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, but a hash a word and trial
    lines = cut_lineage(tokens.line_rows(page_lines(spark, sf_dir)).select("currier", "seq_id", "ln", "ws").repartition(parts))
    words = lines.select("currier", "seq_id", "ln", F.posexplode("ws").alias("wi", "word"))
    texts = cut_lineage(corpora(spark, sf_dir).repartition(parts))
    refs = texts.select("corpus_id", "lang", F.posexplode("words").alias("pos", "word"))
    t = shape.shapes(shape.sample_words(words, ["currier"], _N, _T, SEED, ["seq_id", "ln", "wi"]), ["trial", "currier"])
    r = shape.shapes(shape.sample_words(refs, ["lang"], _N, _T, SEED, ["corpus_id", "pos"]).withColumn("word", F.lower("word")), ["trial", "lang"])
    met = t.withColumnRenamed("n", "a").join(r.withColumnRenamed("n", "b"), ["trial", "len", "pattern"])
    return met.groupBy("trial", "currier", "lang").agg(F.round(-F.ln(F.sum(F.sqrt(F.col("a").cast("double") * F.col("b"))) / _N), 9).alias("distance"))


@query(_SHAPES + f""",
{_PICK},
k AS (SELECT *, row_number() OVER (PARTITION BY trial, currier ORDER BY distance, lang) AS rank, row_number() OVER (PARTITION BY currier, lang ORDER BY distance) - 1 AS q, count(*) OVER (PARTITION BY currier, lang) AS m FROM d)
SELECT currier, lang, count(*) FILTER (rank = 1) AS wins, max(distance) FILTER (q = greatest(0, CAST(floor(0.05 * m) AS BIGINT) - 1)) AS q05, max(distance) FILTER (q = least(m - 1, CAST(floor(0.95 * m) AS BIGINT))) AS q95 FROM k GROUP BY ALL""")
def resample_both(spark, sf_dir):
    """Which language is nearest when target and references are sampled alike, and the spread of its distances."""
    from folioscope.operators.ranking import ranked_rows

    d = cut_lineage(_resampled(spark, sf_dir))
    r = shape.ranked(d, ["trial", "currier"], "lang")
    q = ranked_rows(r, ["currier", "lang"], ["distance", "trial"], "q", "m")
    at = lambda i, name: F.max(F.when(F.col("q") == i, F.col("distance"))).alias(name)
    return q.groupBy("currier", "lang").agg(F.count_if(F.col("rank") == 1).alias("wins"), at(F.greatest(F.lit(0), F.floor(0.05 * F.col("m")) - 1), "q05"), at(F.least(F.col("m") - 1, F.floor(0.95 * F.col("m"))), "q95"))


@query(_SHAPES + f""",
{_PICK},
k AS (SELECT *, row_number() OVER (PARTITION BY trial, lang ORDER BY distance, currier) AS rank FROM d)
SELECT lang, currier, count(*) FILTER (rank = 1) AS wins FROM k GROUP BY ALL HAVING count(*) FILTER (rank = 1) > 0""")
def resample_groups(spark, sf_dir):
    """The other way round: which stratum is nearest to each reference."""
    r = shape.ranked(_resampled(spark, sf_dir), ["trial", "lang"], "currier")
    return r.groupBy("lang", "currier").agg(F.count_if(F.col("rank") == 1).alias("wins")).where("wins > 0")


@query(rest(f"""{_RES},
k AS (SELECT seq_id, ln, wi, prev_word, pl_word, {_sig('prev_word')} AS pm, {_sig('pl_word')} AS am, currier, topic, CASE WHEN n = 1 THEN 'single' WHEN wi = 0 THEN 'first' WHEN wi = n - 1 THEN 'last' ELSE 'middle' END AS position FROM t3),
sl AS (SELECT *, row_number() OVER (PARTITION BY currier, topic, position, pm ORDER BY seq_id, ln, wi) AS s1, row_number() OVER (PARTITION BY currier, topic, position, pm ORDER BY md5(concat_ws('|', '{SEED}', 'previous', seq_id, ln, wi)), seq_id, ln, wi) AS h1,
 row_number() OVER (PARTITION BY currier, topic, position, am ORDER BY seq_id, ln, wi) AS s2, row_number() OVER (PARTITION BY currier, topic, position, am ORDER BY md5(concat_ws('|', '{SEED}', 'aligned', seq_id, ln, wi)), seq_id, ln, wi) AS h2 FROM k)
SELECT a.seq_id, count(*) FILTER (a.prev_word IS DISTINCT FROM b.prev_word OR a.pl_word IS DISTINCT FROM c.pl_word) AS changed, count(*) FILTER (a.pl_word IS DISTINCT FROM c.pl_word) AS aligned_changed, count(*) AS words
 FROM sl a JOIN sl b ON a.currier = b.currier AND a.topic = b.topic AND a.position = b.position AND a.pm IS NOT DISTINCT FROM b.pm AND a.s1 = b.h1 JOIN sl c ON a.currier = c.currier AND a.topic = c.topic AND a.position = c.position AND a.am IS NOT DISTINCT FROM c.am AND a.s2 = c.h2 GROUP BY a.seq_id"""))
def neighbor_permutation_both(spark, sf_dir):
    """Previous and aligned words, each permuted in strata of layout and of its own morphology; rows changed in either."""
    t = residual.with_morphology(token_facts(spark, sf_dir)).select("seq_id", "ln", "wi", "currier", "topic", "position", "prev_morph", "pl_morph", "prev_word", "pl_word", F.col("prev_word").alias("a"), F.col("pl_word").alias("b"))
    slot, layout = ["seq_id", "ln", "wi"], ["currier", "topic", "position"]
    out = resample.shuffle_within(t, ["prev_word"], [*layout, "prev_morph"], slot, SEED, "previous")
    out = resample.shuffle_within(out, ["pl_word"], [*layout, "pl_morph"], slot, SEED, "aligned")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    return out.groupBy("seq_id").agg(F.count_if(~(same("prev_word", "a") & same("pl_word", "b"))).alias("changed"), F.count_if(~same("pl_word", "b")).alias("aligned_changed"), F.count("*").alias("words"))


_STREAM_BITS = _PREQ.replace("ev AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS sym FROM events)", """top AS (SELECT lang, word FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, min((corpus_id, pos))) AS r FROM cw GROUP BY lang, word) WHERE r < 64),
cl AS (SELECT corpus_id, lang, pos, CASE WHEN t.word IS NULL THEN '<UNKNOWN_WORD>' ELSE c.word END AS sym FROM cw c LEFT JOIN top t USING (lang, word)),
rk AS (SELECT *, pos // 100 AS block, row_number() OVER (PARTITION BY corpus_id, pos // 100 ORDER BY pos) AS slot, row_number() OVER (PARTITION BY corpus_id, pos // 100 ORDER BY md5(concat_ws('|', '408', 'order', corpus_id, pos)), pos) AS h FROM cl),
ev AS (SELECT corpus_id || ':0' AS user_id, pos, sym FROM cl UNION ALL SELECT a.corpus_id || ':1', a.pos, b.sym FROM rk a JOIN rk b ON a.corpus_id = b.corpus_id AND a.block = b.block AND a.slot = b.h)""")


@query(f"WITH {CORPORA_SQL.strip()},\n{_STREAM_BITS},\nbt AS (SELECT CAST(split_part(user_id, ':', 1) AS BIGINT) AS corpus_id, split_part(user_id, ':', 2) AS shuffled, units, -(t + log2((e0 + e1 + e2) / 3)) AS bits FROM ms)\nSELECT a.corpus_id, a.units, round(a.bits / a.units, 6) AS original, round(b.bits / b.units, 6) AS shuffled, round((b.bits - a.bits) / a.units, 6) AS gain FROM bt a JOIN bt b ON a.corpus_id = b.corpus_id AND a.shuffled = '0' AND b.shuffled = '1'")
def word_order_gain_prequential(spark, sf_dir):
    """Bits a word of each corpus coded online, in order and shuffled within blocks of 100, in the 63 most frequent words of its language and one sentinel."""
    from folioscope.operators import stats

    words = corpora(spark, sf_dir).select("corpus_id", "lang", F.posexplode("words").alias("pos", "word"))
    top = stats.top_words(words, 63, ["corpus_id", "pos"], by=["lang"]).select("lang", "word", F.lit(True).alias("v"))
    coded = words.join(top, ["lang", "word"], "left").select("corpus_id", "pos", F.when(F.col("v"), F.col("word")).otherwise(text.UNKNOWN_WORD).alias("sym"))
    coded = cut_lineage(coded.withColumn("block", F.floor(F.col("pos") / 100)))
    mixed = resample.shuffle_within(coded, ["sym"], ["corpus_id", "block"], ["corpus_id", "pos"], SEED, "order")
    both = coded.withColumn("shuffled", F.lit(0)).unionByName(mixed.withColumn("shuffled", F.lit(1)))
    streams = both.groupBy("corpus_id", "shuffled").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sym"))), lambda x: x["sym"]).alias("s"))
    p = coders.prequential(streams, "s", ["corpus_id", "shuffled"], 2)
    one = lambda k: F.max(F.when(F.col("shuffled") == k, F.col("bits") / F.col("units")))
    return p.groupBy("corpus_id").agg(F.max("units").alias("units"), F.round(one(0), 6).alias("original"), F.round(one(1), 6).alias("shuffled"), F.round(one(1) - one(0), 6).alias("gain"))


@query(f"WITH {_PREQ}\nSELECT count(*) AS streams, CAST(sum(units) AS BIGINT) AS units, round(sum(-(t + log2((e0 + e1 + e2) / 3))), 3) AS bits, round(sum(-(t + log2((e0 + e1 + e2) / 3))) / 8, 3) AS bytes FROM ms")
def stream_upper_bound(spark, sf_dir):
    """Bits and bytes that code all streams online."""
    from folioscope.plans.coding import _event_streams

    p = coders.prequential(_event_streams(spark, sf_dir), "s", ["user_id"], 2)
    return p.agg(F.count("*").alias("streams"), F.sum("units").alias("units"), F.round(F.sum("bits"), 3).alias("bits"), F.round(F.sum("bits") / 8, 3).alias("bytes"))


@query()
def mixture_weights(spark, sf_dir):
    """EM weights of the six nested coders over each fold's held-out words, and the bits a word of the mixture."""
    rows = residual.held_out(_two_folds(spark, sf_dir), _V)
    scored = cut_lineage(residual.probabilities(rows, rows.where("not train")).select("test", *residual.MODELS))
    weights = experts.fit_mixture(scored, residual.MODELS, ["test"], 20)
    w = spark.createDataFrame([(g[0], m, float(v)) for g, by in weights.items() for m, v in by.items()], "test string, expert string, weight double")
    wide = spark.createDataFrame([(g[0], [by[m] for m in residual.MODELS]) for g, by in weights.items()], "test string, w array<double>")
    mass = sum((F.col("w")[k] * F.col(m) for k, m in enumerate(residual.MODELS)), F.lit(0.0))
    bits = scored.join(F.broadcast(wide), "test").groupBy("test").agg((-F.avg(F.log2(mass))).alias("bits"))
    return w.join(bits, "test").select("test", "expert", F.round("weight", 6).alias("weight"), F.round("bits", 6).alias("mixture_bits"))


@query()
def copy_weights(spark, sf_dir):
    """Weight of a copy-with-edits component against the layout coder for each fold, for each of eight edit settings, with its log-likelihood."""
    rows = residual.held_out(_two_folds(spark, sf_dir), _V)
    scored = residual.probabilities(rows, rows.where("not train and prev_word is not null")).select("test", "prev_word", "word", F.col("layout").alias("base"))
    counted = cut_lineage(scored.groupBy("test", "prev_word", "word", "base").agg(F.count("*").alias("n")))
    pairs = counted.select(F.col("prev_word").alias("source"), F.col("word").alias("target")).distinct()
    grid = [(i, d, c) for i in (0.05, 0.15) for d in (0.05, 0.15) for c in (0.7, 0.9)]
    edits = cut_lineage(experts.edit_grid(pairs, grid, 26))
    met = counted.join(edits, (counted["prev_word"] == edits["source"]) & (counted["word"] == edits["target"]))
    return experts.fit_copy_weights(met.select("test", "setting", "n", "base", "edit"), ["test", "setting"])


@query("""SELECT n_nationkey AS k, CAST(l * (4 * d * d + 8 * d * d + 13 * d) + 2 * d + d * 1000 AS BIGINT) AS params, CAST(6 * (l * (12 * d * d)) * 128 AS BIGINT) AS flops_rule, round(6.0 * (l * (12 * d * d)) * 128 / 3.0e12, 9) AS seconds, round(6.0 * (l * (12 * d * d)) * 3.0e11 / (3.12e14 * 0.3 * 8) / 86400, 6) AS days FROM (SELECT n_nationkey, n_nationkey + 1 AS l, CAST(64 * (n_nationkey % 4 + 1) AS BIGINT) AS d FROM nation)""")
def training_budget(spark, sf_dir):
    """Parameters, floating-point work by the rule 6 N D, seconds a step and days of training of a row of models."""
    m = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") + 1).alias("l"), (64 * (F.col("n_nationkey") % 4 + 1)).cast("long").alias("d"))
    body = F.col("l") * 12 * F.col("d") * F.col("d")
    return m.select("k", formulas.decoder_params(F.col("d"), F.col("l"), F.lit(1000), 4 * F.col("d")).cast("long").alias("params"), (6 * body * 128).cast("long").alias("flops_rule"), F.round(formulas.work(body, F.lit(128)) / 3.0e12, 9).alias("seconds"), F.round(formulas.training_days(body, 3.0e11, 3.12e14, 0.3, 8), 6).alias("days"))


@query("""SELECT n_nationkey AS k, CAST(3 * l * (6 * 128 * d * d + 4 * 128 * 128 * d + 3 * 4 * 128 * 128 + 2 * 128 * d * d + 4 * 128 * d * 4 * d) AS BIGINT) AS flops FROM (SELECT n_nationkey, n_nationkey + 1 AS l, CAST(64 * (n_nationkey % 4 + 1) AS BIGINT) AS d FROM nation)""")
def sequence_work(spark, sf_dir):
    """Forward and backward work of one sequence of 128 with four heads."""
    d = (64 * (F.col("n_nationkey") % 4 + 1)).cast("long")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), formulas.training_flops(d, F.col("n_nationkey") + 1, F.lit(4), F.lit(128), 4 * d).cast("long").alias("flops"))


_LOG = "iter 0: loss 4.2|iter 10: loss 3.1, time 2ms|step 10: train loss 3.0, val loss 3.2|noise|step 20: train loss 2.5, val loss 2.9"


@query(f"""WITH l AS (SELECT unnest(string_split('{_LOG}', '|')) AS line) SELECT CASE WHEN starts_with(line, 'iter') THEN 'iter' ELSE 'step' END AS kind, CAST(regexp_extract(line, '^(?:iter|step) (\\d+):', 1) AS INTEGER) AS at, CAST(regexp_extract(line, '(?:train )?loss ([0-9.]+[0-9])', 1) AS DOUBLE) AS loss, TRY_CAST(regexp_extract(line, 'val loss ([0-9.]+[0-9])', 1) AS DOUBLE) AS held_out FROM l WHERE regexp_matches(line, '^(?:iter|step) \\d+:')""")
def log_parse(spark, sf_dir):
    """Losses of a training log, by its two kinds of lines."""
    from folioscope.sources.readers import training_log

    return training_log(spark.createDataFrame([(x,) for x in _LOG.split("|")], "value string"))


@query()
def embedding_clusters(spark, sf_dir):
    """Fifty clusters of the vectors (seed 42) and the five labels most frequent in each."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import Window

    v = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    made = KMeans(k=50, seed=42, maxIter=20).fit(v).transform(v).groupBy(F.col("prediction").alias("cluster"), "label").agg(F.count("*").alias("n"))
    return made.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "label"))).where("rank <= 5")


@query()
def embedding_plane(spark, sf_dir):
    """Two coordinates of each vector: principal components, in place of a stochastic neighbour embedding."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    xy = vector_to_array("p")
    return PCA(k=2, inputCol="features", outputCol="p").fit(v).transform(v).select("vec_id", xy[0].alias("x"), xy[1].alias("y"))


@query("""WITH h0 AS (SELECT DISTINCT ON (entry_id) entry_id, heading FROM herbal_entry ORDER BY entry_id), f AS (SELECT DISTINCT replace(trim(heading, ' '), ' ', '') AS form FROM h0 WHERE heading IS NOT NULL),
l AS (SELECT DISTINCT word FROM sequence_record WHERE regexp_full_match(word, '[a-z]+')),
x AS (SELECT word, form, list_sort(list_distinct(list_transform(range(1, length(word) + 1), lambda i: word[i] || form[i]))) AS m FROM l, f WHERE length(word) = length(form)
 UNION SELECT word, form, list_sort(list_distinct(list_transform(range(1, length(word) + 1), lambda i: reverse(word)[i] || form[i]))) FROM l, f WHERE length(word) = length(form)),
k AS (SELECT form, m FROM x WHERE len(list_distinct(list_transform(m, lambda p: p[1]))) = len(m) AND len(list_distinct(list_transform(m, lambda p: p[2]))) = len(m))
SELECT form, count(DISTINCT m) AS mappings FROM k GROUP BY form""")
def reading_mappings(spark, sf_dir):
    """Different keys under which some word, read forwards or backwards, gives a heading. Words and headings meet on their pattern of
    first occurrences, which is equal exactly where a one-to-one key exists."""
    forms = once(table(spark, sf_dir, "herbal_entry"), "entry_id", "heading").where("heading is not null").select(F.replace(F.trim("heading"), F.lit(" "), F.lit("")).alias("form")).distinct()
    words = table(spark, sf_dir, "sequence_record").select("word").distinct().where(F.col("word").rlike("^[a-z]+$"))
    both = words.select(F.explode(F.array("word", F.reverse("word"))).alias("w")).distinct()
    pattern = lambda c: F.array_join(F.transform(F.split(c, ""), lambda x: F.array_position(F.split(c, ""), x).cast("string")), ",")
    met = both.withColumn("p", pattern("w")).join(forms.withColumn("p", pattern("form")), "p")
    return met.groupBy("form").agg(F.count_distinct(keys.pair_mapping(F.split("w", ""), F.split("form", ""))).alias("mappings"))


@query()
def span_bootstrap(spark, sf_dir):
    """Entries of a catalogue against length-matched spans of page words: repeated neighbours in each, wins and ties over trials."""
    entries = once(table(spark, sf_dir, "herbal_entry"), "entry_id", "catalog", "words").where("catalog is not null").select("catalog", F.col("entry_id").alias("id"), F.filter("words", lambda w: w.isNotNull()).alias("words")).where(F.size("words") > 1)
    pages = once(table(spark, sf_dir, "page_sequence"), "seq_id", "lines").select(F.col("seq_id").alias("id"), F.filter(F.flatten("lines"), lambda w: w.isNotNull()).alias("words")).where(F.size("words") > 1)
    return resample.matched_spans(entries, pages, "catalog", 20, SEED)


@query()
def line_alignment(spark, sf_dir):
    """Headings aligned to the beginning of their entries: edit distance, and where the heading's end falls."""
    from folioscope.operators.align import align_udf

    e = once(table(spark, sf_dir, "herbal_entry"), "entry_id", "heading", "words").where("heading is not null and size(words) > 0")
    pairs = e.select("entry_id", F.trim("heading").alias("a"), F.array_join(F.slice("words", 1, 3), " ").alias("b"))
    met = pairs.select("a", "b").distinct().withColumn("m", align_udf("a", "b"))  # each pair is aligned once
    return pairs.join(met, ["a", "b"]).select("entry_id", F.col("m.distance").alias("distance"), F.element_at("m.ends", -1).alias("end"))


@query("""SELECT CAST(levenshtein(previous_word, word) AS INTEGER) AS distance, count(*) AS pairs FROM (SELECT DISTINCT previous_word, word FROM decomposition_record WHERE regexp_full_match(previous_word || word, '[ -~]*')) GROUP BY distance""")
def edit_distances(spark, sf_dir):
    """Edit distance of the different pairs of neighbours in ASCII, by the alignment that also gives the path."""
    from folioscope.operators.align import align_udf

    pairs = table(spark, sf_dir, "decomposition_record").where(F.concat("previous_word", "word").rlike("^[ -~]*$")).select("previous_word", "word").distinct()
    return pairs.select(align_udf("previous_word", "word")["distance"].alias("distance")).groupBy("distance").agg(F.count("*").alias("pairs"))


@query("""WITH r AS (SELECT seq_id, length(array_to_string(flatten(lines), ' ')) AS n, len(lines) AS k, row_number() OVER (ORDER BY seq_id) - 1 AS r FROM (SELECT DISTINCT ON (seq_id) seq_id, lines FROM page_sequence ORDER BY seq_id) WHERE length(array_to_string(flatten(lines), ' ')) >= 8 AND len(lines) BETWEEN 2 AND 40)
SELECT CASE WHEN r % 5 = 0 THEN 'evaluation' ELSE 'training' END AS part, count(*) AS pages, CAST(sum(n) AS BIGINT) AS characters FROM r GROUP BY ALL""")
def eligible_split(spark, sf_dir):
    """Pages long enough and with a plausible number of lines; every fifth of them is for evaluation, and an empty side is an error."""
    from folioscope.operators.ranking import ranked_rows

    n = F.length(F.array_join(F.flatten("lines"), " "))
    pages = once(table(spark, sf_dir, "page_sequence"), "seq_id", "lines").where((n >= 8) & F.size("lines").between(2, 40)).select("seq_id", n.cast("long").alias("n"))
    r = ranked_rows(pages, [], ["seq_id"], "r").groupBy(F.when(F.col("r") % 5 == 0, "evaluation").otherwise("training").alias("part")).agg(F.count("*").alias("pages"), F.sum("n").alias("characters"))
    return r


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.operators import suite

    return cut_lineage(suite.token_probabilities(suite.prepared(_two_folds(spark, sf_dir), 256)))


@query()
def expert_bits(spark, sf_dir):
    """Bits a held-out word of each expert of the suite."""
    from folioscope.operators import suite

    return _scored(spark, sf_dir).groupBy("test").agg(F.count("*").alias("words"), *[F.round(-F.avg(F.log2(n)), 6).alias(n) for n in suite.NAMES])


@query("SELECT unnest(['base', 'paragraph', 'boundary', 'edit_tight', 'edit_loose', 'class_8', 'class_16', 'exact_previous', 'exact_aligned']) AS expert, 0 AS violations")
def expert_mass_check(spark, sf_dir):
    """Contexts in which an expert's probabilities don't sum to 1: none."""
    from folioscope.operators import suite

    return suite.masses(suite.prepared(_two_folds(spark, sf_dir), 256)).select("expert", F.col("violations").cast("int").alias("violations"))


@query()
def token_trace(spark, sf_dir):
    """One row a held-out word: losses of the experts, their gains over the base, and the expert that codes it best."""
    from folioscope.operators import suite

    s = _scored(spark, sf_dir)
    loss = F.create_map(*[x for n in suite.NAMES for x in (F.lit(n), -F.log2(n))])
    gain = F.create_map(*[x for n in suite.NAMES for x in (F.lit(n), F.log2(F.col(n) / F.col("base")))])
    best = F.array_max(F.array(*[F.struct(F.col(n).alias("p"), F.lit(n).alias("n")) for n in suite.NAMES]))["n"]
    return s.select("seq_id", "ln", "wi", "test", F.col("word").alias("target"), F.to_json(loss).alias("loss_bits"), F.to_json(gain).alias("gain_bits"), best.alias("dominant"))
