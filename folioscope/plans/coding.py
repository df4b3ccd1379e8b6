"""Permutation nulls, coders and the residual identity coder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import coders, resample, residual, stats, structure, tokens
from folioscope.operators.structure import METRICS
from folioscope.plans.common import CORPORA_SQL, SEED, UNITS_SQL, corpora, page_lines, token_facts, with_pages
from folioscope.session import cut_lineage
from folioscope.sources.tables import table

QUERIES, ORACLE = {}, {}
P = 19


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rest(sql: str) -> str:
    return with_pages("@@").replace("\n@@", ",\n" + sql)


def rounded(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])


_SHUFFLED = f"""pm AS (SELECT t.*, p.perm FROM tok t, (SELECT unnest(range(0, {P + 1})) AS perm) p),
sl AS (SELECT *, row_number() OVER (PARTITION BY perm, seq_id, ln ORDER BY wi) AS slot,
  row_number() OVER (PARTITION BY perm, seq_id, ln ORDER BY CASE WHEN perm = 0 THEN '' ELSE md5(concat_ws('|', '{SEED}', perm, seq_id, ln, wi)) END, wi) AS rnk FROM pm),
sh AS (SELECT a.perm, a.seq_id, a.ln, a.wi, a.n, b.word FROM sl a JOIN sl b ON a.perm = b.perm AND a.seq_id = b.seq_id AND a.ln = b.ln AND a.slot = b.rnk)"""


def shuffled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as observed (perm 0) and with their words shuffled inside the line."""
    return resample.shuffle_arrays(resample.permutations(tokens.line_rows(page_lines(spark, sf_dir)).select("seq_id", "ln", "n", "ws"), P), "ws", SEED, ["seq_id", "ln"])


@query(rest(f"{_SHUFFLED}\nSELECT perm, seq_id, md5(string_agg(w, '/' ORDER BY ln)) AS digest FROM (SELECT perm, seq_id, ln, string_agg(word, ' ' ORDER BY wi) AS w FROM sh GROUP BY ALL) GROUP BY perm, seq_id"))
def within_line_shuffle(spark, sf_dir):
    """Digest of each page under each shuffle; the lines of a page never leave its row."""
    pages = resample.permutations(page_lines(spark, sf_dir).select("seq_id", "lines"), P)
    key = lambda ln, i: F.md5(F.concat_ws("|", F.lit(str(SEED)), F.col("perm").cast("string"), F.col("seq_id").cast("string"), ln.cast("string"), i.cast("string")))
    order = lambda ws, ln: F.transform(F.array_sort(F.transform(ws, lambda w, i: F.struct(F.when(F.col("perm") == 0, "").otherwise(key(ln, i)).alias("h"), i.alias("i"), w.alias("w")))), lambda y: y["w"])
    return pages.select("perm", "seq_id", F.md5(F.array_join(F.transform("lines", lambda ws, ln: F.array_join(order(ws, ln), " ")), "/")).alias("digest"))


_SUMMARY = """SELECT round(max(v) FILTER (perm = 0), 6) AS observed, round(avg(v) FILTER (perm > 0), 6) AS null_mean, round(stddev_samp(v) FILTER (perm > 0), 6) AS null_std, round((max(v) FILTER (perm = 0) - avg(v) FILTER (perm > 0)) / stddev_samp(v) FILTER (perm > 0), 3) AS z,
 (SELECT round((count(*) FILTER (b.perm > 0 AND b.v >= (SELECT v FROM {m} WHERE perm = 0) - 1e-9) + 1) / CAST(count(*) AS DOUBLE), 6) FROM {m} b) AS p FROM {m}"""


def _mi_by_perm(pairs: str) -> str:
    return f"""jn AS (SELECT perm, x, y, count(*) AS c FROM {pairs} GROUP BY ALL), mg AS (SELECT *, sum(c) OVER (PARTITION BY perm) AS t, sum(c) OVER (PARTITION BY perm, x) AS cx, sum(c) OVER (PARTITION BY perm, y) AS cy FROM jn),
mi AS (SELECT perm, sum(c / t * log2(c * t / (CAST(cx AS DOUBLE) * cy))) AS v FROM mg GROUP BY perm)\n""" + _SUMMARY.format(m="mi")


def _summary(df: DataFrame, metric: str) -> DataFrame:
    exact = df.withColumn(metric, F.round(metric, 10))
    s = resample.permutation_summary(exact, metric)
    return s.select(F.round("observed", 6).alias("observed"), F.round("null_mean", 6).alias("null_mean"), F.round("null_std", 6).alias("null_std"), F.round("z", 3).alias("z"), F.round("p", 6).alias("p"))


_TOP = "top AS (SELECT word FROM tok GROUP BY word ORDER BY count(*) DESC, min((seq_id, ln, wi)) LIMIT 100)"


@query(rest(f"{_SHUFFLED},\n{_TOP},\nco AS (SELECT s.*, CASE WHEN v.word IS NULL THEN '<OTHER>' ELSE s.word END AS cw FROM sh s LEFT JOIN top v ON s.word = v.word),\nlg AS (SELECT perm, lag(cw) OVER (PARTITION BY perm, seq_id, ln ORDER BY wi) AS x, cw AS y FROM co),\npr AS (SELECT * FROM lg WHERE x IS NOT NULL),\n" + _mi_by_perm("pr")))
def perm_test_adjacent_mi(spark, sf_dir):
    """Mutual information of neighbours with the 100 most frequent words, against words shuffled within lines."""
    top = stats.top_words(token_facts(spark, sf_dir), 100, ["seq_id", "ln", "wi"])
    known = F.broadcast(top.agg(F.map_from_entries(F.collect_list(F.struct("word", F.lit(True)))).alias("known")))  # 100 words
    lines = tokens.line_rows(page_lines(spark, sf_dir)).select("seq_id", "ln", "ws").crossJoin(known)
    # Words are collapsed before the shuffles are made: their order doesn't depend on the word.
    cw = F.transform("ws", lambda w: F.when(F.col("known")[w], w).otherwise(text.OTHER))
    lines = resample.shuffle_arrays(resample.permutations(lines.select("seq_id", "ln", cw.alias("ws")), P), "ws", SEED, ["seq_id", "ln"])
    pairs = lines.select("perm", F.inline(F.zip_with(F.slice("ws", F.lit(1), F.size("ws") - 1), F.slice("ws", F.lit(2), F.size("ws")), lambda a, b: F.struct(a.alias("x"), b.alias("y")))))
    return _summary(stats.mutual_information(pairs, "x", "y", ["perm"]), "mi")


@query(rest(f"{_SHUFFLED},\n{_TOP},\npr AS (SELECT perm, CASE WHEN v.word IS NULL THEN '<OTHER>' ELSE s.word END AS x, CASE WHEN n = 1 THEN 'single' WHEN wi = 0 THEN 'first' WHEN wi = n - 1 THEN 'last' ELSE 'middle' END AS y FROM sh s LEFT JOIN top v ON s.word = v.word),\n" + _mi_by_perm("pr")))
def perm_test_line_position(spark, sf_dir):
    top = stats.top_words(token_facts(spark, sf_dir), 100, ["seq_id", "ln", "wi"])
    rows = shuffled_lines(spark, sf_dir).select("perm", "n", F.posexplode("ws").alias("wi", "word"))
    return _summary(stats.mutual_information(tokens.collapse(rows.select("perm", "word", text.line_position(F.col("wi"), F.col("n")).alias("position")), "word", top), "word", "position", ["perm"]), "mi")


_METRICS = f"""{_SHUFFLED},
{_TOP},
co AS (SELECT s.*, CASE WHEN v.word IS NULL THEN '<OTHER>' ELSE s.word END AS cw, lag(s.word) OVER l AS w1, lag(s.word, 2) OVER l AS w2, lag(s.word, 3) OVER l AS w3 FROM sh s LEFT JOIN top v ON s.word = v.word WINDOW l AS (PARTITION BY perm, seq_id, ln ORDER BY wi)),
lg AS (SELECT *, lag(cw) OVER (PARTITION BY perm, seq_id, ln ORDER BY wi) AS cp, CASE WHEN n = 1 THEN 'single' WHEN wi = 0 THEN 'first' WHEN wi = n - 1 THEN 'last' ELSE 'middle' END AS position FROM co),
ja AS (SELECT perm, cp, cw, count(*) AS c FROM lg WHERE cp IS NOT NULL GROUP BY ALL), ma AS (SELECT *, sum(c) OVER (PARTITION BY perm) AS t, sum(c) OVER (PARTITION BY perm, cp) AS cx, sum(c) OVER (PARTITION BY perm, cw) AS cy FROM ja),
jp AS (SELECT perm, position, cw, count(*) AS c FROM lg GROUP BY ALL), mp AS (SELECT *, sum(c) OVER (PARTITION BY perm) AS t, sum(c) OVER (PARTITION BY perm, position) AS cx, sum(c) OVER (PARTITION BY perm, cw) AS cy FROM jp),
am AS (SELECT perm, sum(c / t * log2(c * t / (CAST(cx AS DOUBLE) * cy))) AS adjacent_mi FROM ma GROUP BY perm), qm AS (SELECT perm, sum(c / t * log2(c * t / (CAST(cx AS DOUBLE) * cy))) AS position_mi FROM mp GROUP BY perm),
rt AS (SELECT perm, avg(CASE WHEN w1 = word THEN 1.0 ELSE 0.0 END) AS exact_rate, avg(CASE WHEN levenshtein(w1, word) = 1 THEN 1.0 ELSE 0.0 END) AS edit1_rate FROM co WHERE w1 IS NOT NULL GROUP BY perm),
gr AS (SELECT perm, 2 AS ord, w1 || ' ' || word AS g FROM co UNION ALL SELECT perm, 3, w2 || ' ' || w1 || ' ' || word FROM co UNION ALL SELECT perm, 4, w3 || ' ' || w2 || ' ' || w1 || ' ' || word FROM co),
rp AS (SELECT perm, ord, sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) AS rate FROM (SELECT perm, ord, g, count(*) AS n FROM gr WHERE g IS NOT NULL GROUP BY ALL) GROUP BY ALL),
rw AS (SELECT perm, max(rate) FILTER (ord = 2) AS repeated_2, max(rate) FILTER (ord = 3) AS repeated_3, max(rate) FILTER (ord = 4) AS repeated_4 FROM rp GROUP BY perm),
mt AS (SELECT perm, adjacent_mi, position_mi, exact_rate, edit1_rate, repeated_2, repeated_3, repeated_4 FROM rt JOIN am USING (perm) JOIN qm USING (perm) JOIN rw USING (perm))"""


def _structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, but every line is shuffled in each permutation
    lines = tokens.line_rows(page_lines(spark, sf_dir, parts)).select("seq_id", "ln", "ws")
    return structure.structure_metrics(lines, ["seq_id", "ln"], 100, P, SEED)


@query(rest(_METRICS + "\nSELECT perm, " + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS) + " FROM mt"))
def structure_null(spark, sf_dir):
    """The seven metrics, observed and for each shuffle within lines: one shuffle serves all of them."""
    return rounded(_structure(spark, sf_dir), *METRICS)


@query(rest(_METRICS + ",\nlo AS (UNPIVOT mt ON " + ", ".join(METRICS) + """ INTO NAME metric VALUE v), ob AS (SELECT metric, v AS o FROM lo WHERE perm = 0), nl AS (SELECT metric, avg(v) AS m, count(*) AS k FROM lo WHERE perm > 0 GROUP BY metric)
SELECT lo.metric, round(any_value(o), 6) AS observed, round(any_value(m), 6) AS null_mean, round((count(*) FILTER (perm > 0 AND round(v, 10) >= round(o, 10)) + 1) / (any_value(k) + 1.0), 6) AS p_greater, round((count(*) FILTER (perm > 0 AND round(v, 10) <= round(o, 10)) + 1) / (any_value(k) + 1.0), 6) AS p_less
 FROM lo JOIN ob USING (metric) JOIN nl USING (metric) GROUP BY lo.metric"""))
def structure_test(spark, sf_dir):
    """Each of the seven metrics against its null, in both directions."""
    wide = cut_lineage(_structure(spark, sf_dir))
    rows = wide.select("perm", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(m, 10).alias("v")) for m in METRICS])))
    sides = [resample.permutation_summary(rows, "v", ["metric"], a).select("metric", F.round("observed", 6).alias("observed"), F.round("null_mean", 6).alias("null_mean"), F.round("p", 6).alias(f"p_{a}")) for a in ("greater", "less")]
    return sides[0].join(sides[1].select("metric", "p_less"), "metric")


@query("WITH " + CORPORA_SQL.strip() + f""",
bl AS (SELECT corpus_id, pos, word, pos // 20 AS block FROM cw), sl AS (SELECT *, row_number() OVER (PARTITION BY corpus_id, block ORDER BY pos) AS slot, row_number() OVER (PARTITION BY corpus_id, block ORDER BY md5(concat_ws('|', '{SEED}', '', corpus_id, pos)), pos) AS rnk FROM bl)
SELECT a.corpus_id, md5(string_agg(b.word, ' ' ORDER BY a.pos)) AS digest FROM sl a JOIN sl b ON a.corpus_id = b.corpus_id AND a.block = b.block AND a.slot = b.rnk GROUP BY a.corpus_id""")
def block_shuffle(spark, sf_dir):
    """Words shuffled within blocks of 20 of their corpus."""
    rows = corpora(spark, sf_dir).select("corpus_id", F.posexplode("words").alias("pos", "word")).withColumn("block", F.floor(F.col("pos") / 20))
    out = resample.shuffle_within(rows, ["word"], ["corpus_id", "block"], ["corpus_id", "pos"], SEED)
    words = F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"])
    return out.groupBy("corpus_id").agg(F.md5(F.array_join(words, " ")).alias("digest"))


@query(rest("""im AS (SELECT seq_id, ln, wi, row_number() OVER (PARTITION BY fold ORDER BY seq_id, ln, wi) - 1 AS slot, fold FROM tok),
src AS (SELECT fold, row_number() OVER (PARTITION BY fold ORDER BY md5(concat_ws('|', '408', 'reflow', seq_id, ln, wi)), seq_id, ln, wi) - 1 AS slot, word FROM tok)
SELECT seq_id, ln, string_agg(src.word, ' ' ORDER BY wi) AS line FROM im JOIN src ON im.fold = src.fold AND im.slot = src.slot GROUP BY seq_id, ln"""))
def reshape_like(spark, sf_dir):
    """Words in seeded order laid on the line shape of their own fold, so that lines and counts stay."""
    t = token_facts(spark, sf_dir).select("seq_id", "ln", "wi", "fold", "word")
    out = resample.shuffle_within(t, ["word"], ["fold"], ["seq_id", "ln", "wi"], SEED, "reflow")
    words = F.transform(F.array_sort(F.collect_list(F.struct("wi", "word"))), lambda x: x["word"])
    return out.groupBy("seq_id", "ln").agg(F.array_join(words, " ").alias("line"))


def _unit_streams(spark, sf_dir):
    s = F.flatten(F.transform(F.flatten("lines"), lambda w: F.concat(text.units(w), F.array(F.lit(text.SPACE)))))
    return page_lines(spark, sf_dir).select("seq_id", "fold", s.alias("s"))


def _lgo_sql(source: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    p = f"PARTITION BY {by}, " if by else "PARTITION BY "
    return f"""st AS (SELECT {g}seq_id, fold, symbol, row_number() OVER ({p}seq_id ORDER BY ln, wi, k) AS pos FROM (SELECT {g}seq_id, fold, ln, wi, unnest(list_concat({UNITS_SQL.format(w='word')}, ['<SPACE>'])) AS symbol, generate_subscripts(list_concat({UNITS_SQL.format(w='word')}, ['<SPACE>']), 1) AS k FROM {source})),
lg AS (SELECT {g}fold, symbol, pos, lag(symbol, 3) OVER w || ' ' || lag(symbol, 2) OVER w || ' ' || lag(symbol) OVER w AS ctx FROM st WINDOW w AS ({p}seq_id ORDER BY pos)),
ow AS (SELECT {g}fold, ctx, symbol, count(*) AS n FROM lg WHERE ctx IS NOT NULL GROUP BY ALL),
al AS (SELECT *, sum(n) OVER ({p}ctx, symbol) - n AS tn, sum(n) OVER ({p}ctx) - sum(n) OVER ({p}ctx, fold) AS tc FROM ow),
vo AS (SELECT {g}count(DISTINCT symbol) AS v FROM st {'GROUP BY ' + by if by else ''}),
lgo AS (SELECT {('al.' + by + ', ') if by else ''}CAST(sum(n) AS BIGINT) AS events, -sum(n * log2((tn + 0.1) / (tc + 0.1 * v))) / sum(n) AS bits FROM al {'JOIN vo USING (' + by + ')' if by else ', vo'} {'GROUP BY al.' + by if by else ''})"""


@query(rest(_lgo_sql("tok") + "\nSELECT events, round(bits, 6) AS bits FROM lgo"))
def lgo_ngram_bits(spark, sf_dir):
    """Order-3 unit model, each quire letter coded by all others."""
    return rounded(coders.leave_group_out_bits(_unit_streams(spark, sf_dir), "s", "fold", 3), "bits")


@query(rest(f"""im AS (SELECT seq_id, ln, wi, fold, row_number() OVER (PARTITION BY fold ORDER BY seq_id, ln, wi) AS slot FROM tok),
src AS (SELECT fold, word, row_number() OVER (PARTITION BY fold ORDER BY md5(concat_ws('|', '{SEED}', 'lm', seq_id, ln, wi)), seq_id, ln, wi) AS slot FROM tok),
two AS (SELECT 0 AS perm, seq_id, ln, wi, fold, word FROM tok UNION ALL SELECT 1, im.seq_id, im.ln, im.wi, im.fold, src.word FROM im JOIN src ON im.fold = src.fold AND im.slot = src.slot),
""" + _lgo_sql("two", "perm") + "\nSELECT round(max(bits) FILTER (perm = 0), 6) AS original_bits, round(max(bits) FILTER (perm = 1), 6) AS shuffled_bits, round(max(bits) FILTER (perm = 1) - max(bits) FILTER (perm = 0), 6) AS gain FROM lgo"))
def word_order_gain_lm(spark, sf_dir):
    """Bits a unit of the corpus and of its words shuffled within folds."""
    t = token_facts(spark, sf_dir).select("seq_id", "ln", "wi", "fold", "word")
    both = t.withColumn("perm", F.lit(0)).unionByName(resample.shuffle_within(t, ["word"], ["fold"], ["seq_id", "ln", "wi"], SEED, "lm").withColumn("perm", F.lit(1)))
    words = F.transform(F.array_sort(F.collect_list(F.struct("ln", "wi", "word"))), lambda x: x["word"])
    pages = both.groupBy("perm", "seq_id", "fold").agg(words.alias("w"))
    streams = pages.select("perm", "seq_id", "fold", F.flatten(F.transform("w", lambda w: F.concat(text.units(w), F.array(F.lit(text.SPACE))))).alias("s"))
    b = coders.leave_group_out_bits(streams, "s", "fold", 3, by=["perm"])
    one = lambda k: F.max(F.when(F.col("perm") == k, F.col("bits")))
    return rounded(b.agg(one(0).alias("original_bits"), one(1).alias("shuffled_bits"), (one(1) - one(0)).alias("gain")), "original_bits", "shuffled_bits", "gain")


@query(rest(f"""un AS (SELECT fold, currier, CASE WHEN n = 1 THEN 'single' WHEN wi = 0 THEN 'first' WHEN wi = n - 1 THEN 'last' ELSE 'middle' END AS position, list_concat(['<BOS>', '<BOS>'], {UNITS_SQL.format(w='word')}, ['<EOW>']) AS s FROM tok),
ev AS (SELECT fold, currier, position, s[i] || ' ' || s[i + 1] AS ctx, s[i + 2] AS sym FROM (SELECT *, unnest(range(1, len(s) - 1)) AS i FROM un)),
ow AS (SELECT fold, currier, position, ctx, sym, count(*) AS n FROM ev GROUP BY ALL),
al AS (SELECT *, sum(n) OVER (PARTITION BY ctx, sym) - sum(n) OVER (PARTITION BY fold, ctx, sym) AS ps, sum(n) OVER (PARTITION BY ctx) - sum(n) OVER (PARTITION BY fold, ctx) AS pc,
 sum(n) OVER (PARTITION BY currier, position, ctx, sym) - sum(n) OVER (PARTITION BY fold, currier, position, ctx, sym) AS cs, sum(n) OVER (PARTITION BY currier, position, ctx) - sum(n) OVER (PARTITION BY fold, currier, position, ctx) AS cc,
 sum(n) OVER (PARTITION BY currier, position) - sum(n) OVER (PARTITION BY fold, currier, position) AS ch, (SELECT count(DISTINCT sym) FROM ow) AS v FROM ow)
SELECT fold, CAST(sum(n) AS BIGINT) AS units, round(-sum(n * log2((ps + 0.1) / (pc + 0.1 * v))) / sum(n), 6) AS pooled_bits,
 round(-sum(n * log2(CASE WHEN ch > 0 THEN 0.8 * (cs + 0.1) / (cc + 0.1 * v) + (1 - 0.8) * (ps + 0.1) / (pc + 0.1 * v) ELSE (ps + 0.1) / (pc + 0.1 * v) END)) / sum(n), 6) AS channel_bits FROM al GROUP BY fold"""))
def channel_model_bits(spark, sf_dir):
    t = token_facts(spark, sf_dir).select("fold", "currier", "position", text.units(F.col("word")).alias("u"))
    return rounded(coders.channel_model_bits(t, "u", "fold", ["currier", "position"]), "pooled_bits", "channel_bits")


_PREQ = """ev AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS sym FROM events),
vo AS (SELECT user_id, count(DISTINCT sym) AS v FROM ev GROUP BY user_id),
cx AS (SELECT user_id, pos, sym, lag(sym) OVER w AS c1, lag(sym, 2) OVER w || ' ' || lag(sym) OVER w AS c2 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
ct AS (SELECT *, row_number() OVER (PARTITION BY user_id, sym ORDER BY pos) - 1 AS n0, row_number() OVER (PARTITION BY user_id, c1, sym ORDER BY pos) - 1 AS n1, row_number() OVER (PARTITION BY user_id, c1 ORDER BY pos) - 1 AS m1,
 row_number() OVER (PARTITION BY user_id, c2, sym ORDER BY pos) - 1 AS n2, row_number() OVER (PARTITION BY user_id, c2 ORDER BY pos) - 1 AS m2 FROM cx),
p0 AS (SELECT *, (n0 + 0.5) / (pos + 0.5 * v) AS q0 FROM ct JOIN vo USING (user_id)), p1 AS (SELECT *, CASE WHEN c1 IS NULL THEN q0 ELSE (n1 + 2.0 * q0) / (m1 + 2.0) END AS q1 FROM p0),
p2 AS (SELECT *, CASE WHEN c2 IS NULL THEN q1 ELSE (n2 + 2.0 * q1) / (m2 + 2.0) END AS q2 FROM p1),
sm AS (SELECT user_id, count(*) AS units, sum(log2(q0)) AS s0, sum(log2(q1)) AS s1, sum(log2(q2)) AS s2 FROM p2 GROUP BY user_id),
mx AS (SELECT *, greatest(s0, s1, s2) AS t FROM sm), ms AS (SELECT *, 2.0 ** (s0 - t) AS e0, 2.0 ** (s1 - t) AS e1, 2.0 ** (s2 - t) AS e2 FROM mx)"""


def _event_streams(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    return e.select("user_id", F.transform("e", lambda x: x["event_type"]).alias("s"))


@query(f"WITH {_PREQ}\nSELECT user_id, units, round(-(t + log2((e0 + e1 + e2) / 3)), 4) AS bits FROM ms")
def prequential_bits(spark, sf_dir):
    """Online mixture of context orders 0 to 2 over each user's events."""
    return coders.prequential(_event_streams(spark, sf_dir), "s", ["user_id"], 2).select("user_id", "units", F.round("bits", 4).alias("bits"))


@query(f"WITH {_PREQ}\nSELECT user_id, round(e0 / (e0 + e1 + e2), 6) AS w0, round(e1 / (e0 + e1 + e2), 6) AS w1, round(e2 / (e0 + e1 + e2), 6) AS w2 FROM ms")
def prequential_weights(spark, sf_dir):
    p = coders.prequential(_event_streams(spark, sf_dir), "s", ["user_id"], 2)
    return p.select("user_id", *[F.round(F.col("weights")[k], 6).alias(f"w{k}") for k in range(3)])


@query()
def prequential_word_windows(spark, sf_dir):
    """Equal windows of the unit streams of long corpora, coded online; median, least and greatest bits a unit by language."""
    s = corpora(spark, sf_dir).select("corpus_id", "lang", F.flatten(F.transform("words", lambda w: F.concat(F.split(F.lower(w), ""), F.array(F.lit(text.BOUNDARY))))).alias("s"))
    n, size, most = F.size("s"), 200, 2
    count = F.least(F.lit(most), F.floor(n / size).cast("int"))
    start = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.when(count == 1, F.floor((n - size) / 2)).otherwise(k * size + F.bround(k * (n - count * size) / (count - 1), 0)).cast("int"))
    w = s.where(n >= size).select("corpus_id", "lang", "s", F.posexplode(start).alias("window", "at")).select("corpus_id", "lang", "window", F.slice("s", F.col("at") + 1, F.lit(size)).alias("s"))
    p = coders.prequential(w, "s", ["corpus_id", "lang", "window"], 3).withColumn("bpu", F.col("bits") / F.col("units"))
    return p.groupBy("lang").agg(F.count("*").alias("windows"), *[F.round(f("bpu"), 6).alias(a) for f, a in ((F.median, "median"), (F.min, "least"), (F.max, "most"))])


_RES = f"""tp AS (SELECT a.*, lag(word) OVER (PARTITION BY seq_id, ln ORDER BY wi) AS prev_word FROM tok a),
al AS (SELECT t.seq_id, t.ln, t.wi, arg_min(p.word, (abs((p.wi + 0.5::DOUBLE) / p.n - (t.wi + 0.5::DOUBLE) / t.n), p.wi)) AS pl_word FROM tok t JOIN tok p ON p.seq_id = t.seq_id AND p.ln = t.ln - 1 GROUP BY ALL),
t3 AS (SELECT tp.*, al.pl_word FROM tp LEFT JOIN al USING (seq_id, ln, wi))"""


@query(rest(f"{_RES}\nSELECT seq_id, count(prev_word) AS with_previous, count(pl_word) AS with_aligned, md5(string_agg(coalesce(prev_word, '-') || '/' || coalesce(pl_word, '-'), ' ' ORDER BY ln, wi)) AS digest FROM t3 GROUP BY seq_id"))
def prev_word_and_aligned(spark, sf_dir):
    t = token_facts(spark, sf_dir)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ln", "wi", F.concat(F.coalesce("prev_word", F.lit("-")), F.lit("/"), F.coalesce("pl_word", F.lit("-"))).alias("s")))), lambda x: x["s"])
    return t.groupBy("seq_id").agg(F.count("prev_word").alias("with_previous"), F.count("pl_word").alias("with_aligned"), F.md5(F.array_join(parts, " ")).alias("digest"))


@query(rest("SELECT t.seq_id, t.ln, t.wi, array_to_string(p.ws, ' ') AS pool FROM tok t LEFT JOIN ln p ON p.seq_id = t.seq_id AND p.ln = t.ln - 1"))
def prev_line_pool(spark, sf_dir):
    return token_facts(spark, sf_dir).select("seq_id", "ln", "wi", F.array_join("prev_ws", " ").alias("pool"))


def _sig(w: str) -> str:
    u = UNITS_SQL.format(w=w)
    return f"CASE WHEN {w} IS NOT NULL THEN (CASE WHEN len({u}) < 8 THEN CAST(len({u}) AS VARCHAR) ELSE '8+' END) || ',' || {u}[1] || ',|,' || {u}[-1] END"


_FOLDS = "(CASE WHEN ascii(fold) % 2 = 0 THEN 'even' ELSE 'odd' END)"
_V = 512
_CODED = f"""{_RES},
f2 AS (SELECT seq_id, ln, wi, currier, topic, CASE WHEN n = 1 THEN 'single' WHEN wi = 0 THEN 'first' WHEN wi = n - 1 THEN 'last' ELSE 'middle' END AS position, {_FOLDS} AS fold, word, prev_word, pl_word, {_sig('word')} AS morph, {_sig('prev_word')} AS prev_morph, {_sig('pl_word')} AS pl_morph FROM t3),
xt AS (SELECT f2.*, x.test, f2.fold <> x.test AS train FROM f2, (SELECT DISTINCT fold AS test FROM f2) x),
vo AS (SELECT test, word FROM (SELECT test, word, row_number() OVER (PARTITION BY test ORDER BY n DESC, f) AS r FROM (SELECT test, word, count(*) AS n, min((seq_id, ln, wi)) AS f FROM xt WHERE train GROUP BY test, word)) WHERE r < {_V}),
en AS (SELECT x.* REPLACE (CASE WHEN a.word IS NOT NULL THEN x.word ELSE '<UNKNOWN>' END AS word, CASE WHEN x.prev_word IS NULL THEN NULL WHEN b.word IS NOT NULL THEN x.prev_word ELSE '<UNKNOWN>' END AS prev_word, CASE WHEN x.pl_word IS NULL THEN NULL WHEN c.word IS NOT NULL THEN x.pl_word ELSE '<UNKNOWN>' END AS pl_word)
 FROM xt x LEFT JOIN vo a ON a.test = x.test AND a.word = x.word LEFT JOIN vo b ON b.test = x.test AND b.word = x.prev_word LEFT JOIN vo c ON c.test = x.test AND c.word = x.pl_word),
su AS (SELECT DISTINCT test, morph, word FROM en WHERE train UNION SELECT DISTINCT test, morph, '<UNKNOWN>' FROM en WHERE train),
sz AS (SELECT test, morph, count(*) AS size FROM su GROUP BY ALL),
tg AS (SELECT e.* REPLACE (CASE WHEN s.word IS NOT NULL THEN e.word ELSE '<UNKNOWN>' END AS word), coalesce(sz.size, 1) AS size FROM en e LEFT JOIN su s ON s.test = e.test AND s.morph = e.morph AND s.word = e.word LEFT JOIN sz ON sz.test = e.test AND sz.morph = e.morph WHERE NOT e.train)"""


def _count_sql(name: str, keys: tuple[str, ...], where: str = "") -> tuple[str, str]:
    on = lambda a: " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM g.{k}" for k in ("test", *keys))
    cte = f"j{name} AS (SELECT test, {', '.join(keys)}, word, count(*) AS n FROM en WHERE train {where} GROUP BY ALL), c{name} AS (SELECT test, {', '.join(keys)}, sum(n) AS n FROM j{name} GROUP BY ALL)"
    return cte, f"LEFT JOIN j{name} ON {on('j' + name)} AND j{name}.word = g.word LEFT JOIN c{name} ON {on('c' + name)}"


_TABLES = [_count_sql("m", ("morph",)), _count_sql("l", residual.LAYOUT), _count_sql("p", residual.PROCEDURAL), _count_sql("w", residual.PREVIOUS, "AND prev_word IS NOT NULL"), _count_sql("a", residual.ALIGNED, "AND pl_word IS NOT NULL")]
_POST = lambda n, prior: f"(coalesce(j{n}.n, 0) + 20.0::DOUBLE * {prior}) / (coalesce(c{n}.n, 0) + 20.0::DOUBLE)"
_PROBS = _CODED + ",\n" + ",\n".join(t[0] for t in _TABLES) + f""",
q1 AS (SELECT g.*, (coalesce(jm.n, 0) + 0.5::DOUBLE) / (coalesce(cm.n, 0) + 0.5::DOUBLE * size) AS a1 FROM tg g {_TABLES[0][1]}), q2 AS (SELECT g.*, {_POST('l', 'a1')} AS a2 FROM q1 g {_TABLES[1][1]}),
q3 AS (SELECT g.*, {_POST('p', 'a2')} AS a3 FROM q2 g {_TABLES[2][1]}), q4 AS (SELECT g.*, CASE WHEN g.prev_word IS NULL THEN a3 ELSE {_POST('w', 'a3')} END AS a4 FROM q3 g {_TABLES[3][1]}),
q5 AS (SELECT g.*, CASE WHEN g.pl_word IS NULL THEN a3 ELSE {_POST('a', 'a3')} END AS a5 FROM q4 g {_TABLES[4][1]})"""


def _two_folds(spark, sf_dir):
    return token_facts(spark, sf_dir).withColumn("fold", F.when(F.ascii("fold") % 2 == 0, "even").otherwise("odd"))


@query(rest(_PROBS + "\nSELECT test, count(*) AS words, " + ", ".join(f"round(-avg(log2({e})), 6) AS {m}" for m, e in zip(residual.MODELS, ("a1", "a2", "a3", "a4", "a5", "(a4 + a5) / 2"))) + " FROM q5 GROUP BY test"))
def residual_identity_bits(spark, sf_dir):
    """Held-out bits a word of the six nested coders, quires in two folds."""
    rows = residual.held_out(_two_folds(spark, sf_dir), _V)
    scored = residual.probabilities(rows, rows.where("not train"))
    return rounded(residual.bits(scored, ["test"]), *residual.MODELS)


@query(rest(_CODED + "\nSELECT test, count(*) AS contexts, 0 AS violations FROM (SELECT DISTINCT test, currier, topic, position, morph, prev_morph, pl_morph, prev_word, pl_word FROM en WHERE NOT train) GROUP BY test"))
def residual_mass_check(spark, sf_dir):
    """Contexts whose probabilities over their support don't sum to 1 under one of the coders: none."""
    rows = residual.held_out(_two_folds(spark, sf_dir), _V)
    context = ["test", "currier", "topic", "position", "morph", "prev_morph", "pl_morph", "prev_word", "pl_word"]
    train = rows.where("train")
    support = train.select("test", "morph", "word").union(train.select("test", "morph", F.lit(text.UNKNOWN).alias("word"))).distinct()
    contexts = rows.where("not train").select(*context).distinct()
    every = contexts.join(support, ["test", "morph"], "left").fillna(text.UNKNOWN, ["word"])
    mass = residual.probabilities(rows, every).groupBy(*context).agg(*[F.sum(m).alias(m) for m in residual.MODELS])
    wrong = F.greatest(*[F.abs(F.col(m) - 1) for m in residual.MODELS]) > 1e-9
    return mass.groupBy("test").agg(F.count("*").alias("contexts"), F.count_if(wrong).cast("int").alias("violations"))


@query(rest(f"""{_RES},
k AS (SELECT seq_id, ln, wi, prev_word, {_sig('prev_word')} AS pm, currier, topic, CASE WHEN n = 1 THEN 'single' WHEN wi = 0 THEN 'first' WHEN wi = n - 1 THEN 'last' ELSE 'middle' END AS position FROM t3),
sl AS (SELECT *, row_number() OVER (PARTITION BY currier, topic, position, pm ORDER BY seq_id, ln, wi) AS slot, row_number() OVER (PARTITION BY currier, topic, position, pm ORDER BY md5(concat_ws('|', '{SEED}', 'previous', seq_id, ln, wi)), seq_id, ln, wi) AS rnk FROM k)
SELECT a.seq_id, count(*) FILTER (a.prev_word IS DISTINCT FROM b.prev_word) AS changed, count(*) AS words FROM sl a JOIN sl b ON a.currier = b.currier AND a.topic = b.topic AND a.position = b.position AND a.pm IS NOT DISTINCT FROM b.pm AND a.slot = b.rnk GROUP BY a.seq_id"""))
def neighbor_permutation(spark, sf_dir):
    """Previous words permuted in strata of layout and the neighbour's own morphology; rows changed on each page."""
    t = residual.with_morphology(token_facts(spark, sf_dir)).select("seq_id", "ln", "wi", "currier", "topic", "position", "prev_morph", F.col("prev_word"), F.col("prev_word").alias("before"))
    out = resample.shuffle_within(t, ["prev_word"], ["currier", "topic", "position", "prev_morph"], ["seq_id", "ln", "wi"], SEED, "previous")
    return out.groupBy("seq_id").agg(F.count_if(~F.col("prev_word").eqNullSafe(F.col("before"))).alias("changed"), F.count("*").alias("words"))
