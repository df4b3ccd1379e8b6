"""Accounting, tokenisation, entropy, mutual information and n-gram queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import stats, tokens
from folioscope.plans.common import CORPORA_SQL, UNITS_SQL, corpora, mi_sql, page_lines, token_facts, with_pages
from folioscope.sources.tables import once, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c, name):
    return F.round(c, 6).alias(name)


@query(with_pages("""SELECT topic, currier, count(DISTINCT seq_id) AS pages, count(DISTINCT (seq_id, ln)) AS lines, count(*) AS tokens, count(DISTINCT word) AS types, count(*) FILTER (regexp_full_match(word, '[a-z]+')) AS certain,
 round(avg(length(word)), 6) AS mean_length, round(avg(CASE WHEN length(word) = 1 THEN 1.0 ELSE 0.0 END), 6) AS one_letter FROM tok GROUP BY topic, currier"""))
def corpus_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = token_facts(spark, sf_dir)
    lines = page_lines(spark, sf_dir).groupBy("topic", "currier").agg(F.count("*").alias("pages"), F.sum(F.size("lines")).alias("lines"))
    words = t.groupBy("topic", "currier").agg(F.count("*").alias("tokens"), F.count_distinct("word").alias("types"), F.count_if(F.col("word").rlike("^[a-z]+$")).alias("certain"), r6(F.avg(F.length("word")), "mean_length"), r6(F.avg((F.length("word") == 1).cast("int")), "one_letter"))
    return lines.join(words, ["topic", "currier"])


@query(with_pages("""SELECT coalesce(currier, 'all') AS currier, coalesce(topic, 'all') AS topic, tokens, types FROM (
 SELECT currier, topic, count(*) AS tokens, count(DISTINCT word) AS types FROM tok GROUP BY GROUPING SETS ((), (currier), (currier, topic)))"""))
def multi_granularity_groups(spark, sf_dir):
    t = token_facts(spark, sf_dir).groupBy("currier", "topic", "word").agg(F.count("*").alias("n"))
    sets = t.groupingSets([[], ["currier"], ["currier", "topic"]], "currier", "topic").agg(F.sum("n").alias("tokens"), F.count_distinct("word").alias("types"))
    return sets.select(F.coalesce("currier", F.lit("all")).alias("currier"), F.coalesce("topic", F.lit("all")).alias("topic"), "tokens", "types")


@query(with_pages("SELECT currier, count(*) AS tokens FROM tok GROUP BY ROLLUP (currier)"))
def words_by_stratum_rollup(spark, sf_dir):
    return token_facts(spark, sf_dir).rollup("currier").agg(F.count("*").alias("tokens"))


@query("""WITH l0 AS (SELECT DISTINCT ON (locus_no) locus_no, locus_type, raw_text FROM locus ORDER BY locus_no)
SELECT locus_type, count(*) AS loci, CAST(sum((length(raw_text) - length(replace(raw_text, '<->', ''))) / 3) AS BIGINT) AS gaps, CAST(sum(length(raw_text) - length(replace(raw_text, ',', ''))) AS BIGINT) AS commas,
 CAST(sum(length(regexp_replace(raw_text, '<.*?>', '', 'g'))) AS BIGINT) AS legacy_chars FROM l0 WHERE raw_text IS NOT NULL GROUP BY locus_type""")
def mark_counts_and_legacy_clean(spark, sf_dir):
    loci = once(table(spark, sf_dir, "locus"), "locus_no", "locus_type", "raw_text").where("raw_text is not null")
    return loci.groupBy("locus_type").agg(F.count("*").alias("loci"), F.sum(text.mark_count(F.col("raw_text"), "<->")).alias("gaps"), F.sum(text.mark_count(F.col("raw_text"), ",")).alias("commas"), F.sum(F.length(text.legacy_clean(F.col("raw_text")))).cast("long").alias("legacy_chars"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '\\p{L}+', 0)) AS word, generate_subscripts(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '\\p{L}+', 0), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS words, count(DISTINCT word) AS types, min(word) AS first_word FROM w WHERE pos < 1000 GROUP BY doc_id""")
def plain_words(spark, sf_dir):
    words = F.slice(text.plain_words(F.col("text")), 1, 1000)
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).where(F.size("w") > 0).select("doc_id", F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("types"), F.array_min("w").alias("first_word"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '\\p{L}[\\p{L}\\p{M}]*', 0)) AS word, generate_subscripts(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '\\p{L}[\\p{L}\\p{M}]*', 0), 1) AS pos FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(word) - 1 AS before FROM w)
SELECT doc_id, count(*) AS words, CAST(sum(length(word) + 1) AS BIGINT) AS units FROM c WHERE before < 500 GROUP BY doc_id""")
def unit_budget_words(spark, sf_dir):
    """Words until a budget of 500 units is crossed; the running size is kept inside the array."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.letter_mark_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("units"))
    step = lambda s, w: F.when(s["units"] < 500, F.struct((s["words"] + 1).alias("words"), (s["units"] + F.length(w) + 1).alias("units"))).otherwise(s)
    return docs.select("doc_id", F.aggregate("w", start, step).alias("s")).select("doc_id", "s.words", "s.units")


@query("""SELECT doc_id, len(regexp_extract_all(lower(text), '\\p{L}+(?:[''’]\\p{L}+)?', 0)) AS control_words, length(array_to_string(list_transform(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '\\p{L}[\\p{L}\\p{M}]*', 0), lambda w: regexp_replace(w, '\\p{M}', '', 'g')), '')) AS letters FROM documents WHERE text IS NOT NULL""")
def control_and_unmarked_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(text.control_words(F.col("text"))).cast("long").alias("control_words"), F.length(F.array_join(text.unmarked_words(F.col("text")), "")).cast("long").alias("letters"))


@query("""WITH ch AS (SELECT unnest(string_split(text, '')) AS c FROM documents WHERE text IS NOT NULL AND text <> '')
SELECT c, count(*) AS n, dense_rank() OVER (ORDER BY c) - 1 AS id FROM ch GROUP BY c""")
def char_vocab(spark, sf_dir):
    """Distinct characters with their codes; the vocabulary is bounded by the alphabet, so one window is fine."""
    chars = table(spark, sf_dir, "documents").where("text <> ''").select(F.explode(F.split("text", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    return chars.select("c", "n", (F.dense_rank().over(Window.orderBy("c")) - 1).cast("long").alias("id"))


@query("""SELECT doc_id, length(text) AS chars, length(substring(text, 1, CAST(floor(length(text) * 0.9) AS INTEGER))) AS train, length(text) - CAST(floor(length(text) * 0.9) AS INTEGER) AS held_out, md5(substring(text, CAST(floor(length(text) * 0.9) AS INTEGER) + 1)) AS held_out_md5 FROM documents WHERE text IS NOT NULL""")
def char_split_90_10(spark, sf_dir):
    cut = F.floor(F.length("text") * F.lit(0.9).cast("double")).cast("int")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length("text").cast("long").alias("chars"), cut.cast("long").alias("train"), (F.length("text") - cut).cast("int").alias("held_out"), F.md5(F.substring("text", cut + 1, F.length("text"))).alias("held_out_md5"))


@query("""WITH ch AS (SELECT source, ascii(unnest(string_split(text, ''))) AS code FROM documents WHERE text IS NOT NULL AND text <> '' AND source IS NOT NULL),
n AS (SELECT source, code, count(*) AS n FROM ch WHERE code < 128 GROUP BY ALL)
SELECT source, code, n, round(n / sum(n) OVER (PARTITION BY source), 8) AS share FROM n""")
def ascii_histogram(spark, sf_dir):
    codes = table(spark, sf_dir, "documents").where("text <> '' and source is not null").select("source", F.explode(F.split("text", "")).alias("c")).select("source", F.ascii("c").alias("code")).where("code < 128")
    n = codes.groupBy("source", "code").agg(F.count("*").alias("n"))
    return n.join(n.groupBy("source").agg(F.sum("n").alias("all")), "source").select("source", "code", "n", F.round(F.col("n") / F.col("all"), 8).alias("share"))


@query(with_pages(f"""SELECT unit, count(*) AS n FROM (SELECT unnest({UNITS_SQL.format(w='word')}) AS unit FROM tok) GROUP BY unit"""))
def eva_units(spark, sf_dir):
    return token_facts(spark, sf_dir).select(F.explode(text.units(F.col("word"))).alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))


@query(with_pages("""SELECT pattern, count(*) AS types FROM (SELECT array_to_string(list_sort(list_transform(list_distinct(string_split(word, '')), lambda s: len(list_filter(string_split(word, ''), lambda x: x = s))), 'DESC'), ',') AS pattern FROM (SELECT DISTINCT word FROM tok)) GROUP BY pattern"""))
def decomposition_patterns(spark, sf_dir):
    w = token_facts(spark, sf_dir).select("word").distinct()
    return w.select(text.unit_pattern(text.units(F.col("word"), False)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("types"))


@query(with_pages(f"""SELECT key, count(*) AS tokens, count(DISTINCT word) AS types FROM (SELECT word, array_to_string(list_sort({UNITS_SQL.format(w='word')}), chr(31)) AS key FROM tok) GROUP BY key HAVING count(DISTINCT word) > 1"""))
def anagram_keys(spark, sf_dir):
    n = token_facts(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"))
    return n.groupBy(text.anagram_key(text.units(F.col("word"))).alias("key")).agg(F.sum("n").alias("tokens"), F.count("*").alias("types")).where("types > 1")


@query(with_pages(f"""SELECT signature, count(*) AS tokens, count(DISTINCT word) AS types FROM (
 SELECT word, array_to_string(list_concat([CASE WHEN len(u) < 8 THEN CAST(len(u) AS VARCHAR) ELSE '8+' END], u[1:2], ['|'], u[greatest(len(u) - 1, 1):]), ' ') AS signature FROM (SELECT word, {UNITS_SQL.format(w='word')} AS u FROM tok)) GROUP BY signature"""))
def morphology_signatures(spark, sf_dir):
    n = token_facts(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"))
    return n.groupBy(F.array_join(text.signature(text.units(F.col("word")), 2), " ").alias("signature")).agg(F.sum("n").alias("tokens"), F.count("*").alias("types"))


@query(with_pages("SELECT currier, position, count(*) AS n FROM tokn GROUP BY ALL"))
def line_positions(spark, sf_dir):
    return token_facts(spark, sf_dir).groupBy("currier", "position").agg(F.count("*").alias("n"))


@query("""WITH l0 AS (SELECT DISTINCT ON (locus_no) locus_no, page, coalesce(transcriber, '') AS hand, paragraph_start, paragraph_end FROM locus WHERE certain_tokens <> '' ORDER BY locus_no),
i AS (SELECT *, sum(CASE WHEN paragraph_start OR prev_end THEN 1 ELSE 0 END) OVER (PARTITION BY page, hand ORDER BY locus_no) AS island FROM (SELECT *, coalesce(lag(paragraph_end) OVER (PARTITION BY page, hand ORDER BY locus_no), false) AS prev_end FROM l0))
SELECT locus_no, page, k AS paragraph_line, (CASE WHEN k < 3 THEN CAST(k AS VARCHAR) ELSE '3+' END) || ':' || (CASE WHEN paragraph_end THEN 'end' ELSE 'open' END) AS state FROM (SELECT *, row_number() OVER (PARTITION BY page, hand, island ORDER BY locus_no) - 1 AS k FROM i)""")
def paragraph_structure(spark, sf_dir):
    """Running line of a paragraph, for each hand: a counter that starts again at a start mark or after an end mark, as islands.
    Lines without certain words don't count."""
    from pyspark.sql import Window

    loci = once(table(spark, sf_dir, "locus").where("certain_tokens <> ''"), "locus_no", "page", "transcriber", "paragraph_start", "paragraph_end").withColumn("hand", F.coalesce("transcriber", F.lit("")))
    w = Window.partitionBy("page", "hand").orderBy("locus_no")
    begin = F.col("paragraph_start") | F.coalesce(F.lag("paragraph_end").over(w), F.lit(False))
    i = loci.withColumn("island", F.sum(begin.cast("int")).over(w))
    k = F.row_number().over(Window.partitionBy("page", "hand", "island").orderBy("locus_no")) - 1
    return i.withColumn("k", k).select("locus_no", "page", F.col("k").cast("long").alias("paragraph_line"), text.paragraph_state(F.col("k"), F.col("paragraph_end")).alias("state"))


@query(with_pages("""SELECT ord, ngram, n FROM (SELECT ord, substring(word, i + 1, ord) AS ngram, count(*) AS n FROM (SELECT word, o.ord, unnest(range(0, length(word) - o.ord + 1)) AS i FROM tok, (SELECT unnest(range(1, 6)) AS ord) o WHERE length(word) >= o.ord) GROUP BY ALL) WHERE n > 2"""))
def char_ngrams(spark, sf_dir):
    n = token_facts(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(k).cast("long").alias("ord"), text.char_ngrams(F.col("word"), k).alias("g")) for k in range(1, 6)])
    return n.select("n", F.inline(each)).select("ord", F.explode("g").alias("ngram"), "n").groupBy("ord", "ngram").agg(F.sum("n").alias("n")).where("n > 2")


@query(with_pages("""SELECT ord, ngram, count(*) AS n FROM (SELECT o.ord, CASE o.ord WHEN 1 THEN word WHEN 2 THEN word || ' ' || a WHEN 3 THEN word || ' ' || a || ' ' || b WHEN 4 THEN word || ' ' || a || ' ' || b || ' ' || c ELSE word || ' ' || a || ' ' || b || ' ' || c || ' ' || d END AS ngram FROM (SELECT word, lead(word) OVER w AS a, lead(word, 2) OVER w AS b, lead(word, 3) OVER w AS c, lead(word, 4) OVER w AS d FROM tok WINDOW w AS (PARTITION BY seq_id ORDER BY ln, wi)), (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS ord) o) WHERE ngram IS NOT NULL GROUP BY ALL HAVING count(*) > 2"""))
def word_ngrams(spark, sf_dir):
    """Word n-grams of orders 1 to 5 over the words of a page read on across line ends."""
    flat = page_lines(spark, sf_dir).select(F.flatten("lines").alias("w"))
    return stats.ngram_rows(flat, "w", (1, 2, 3, 4, 5)).groupBy("ord", "ngram").agg(F.count("*").alias("n")).where("n > 2")


@query(with_pages("""SELECT a.g AS first, b.g AS second, CAST(sum(a.n) AS BIGINT) AS n FROM (SELECT word, n, unnest(list_distinct(list_transform(range(0, length(word) - 1), lambda i: substring(word, i + 1, 2)))) AS g FROM (SELECT word, count(*) AS n FROM tok GROUP BY word) WHERE length(word) > 1) a
 JOIN (SELECT word, unnest(list_distinct(list_transform(range(0, length(word) - 1), lambda i: substring(word, i + 1, 2)))) AS g FROM (SELECT DISTINCT word FROM tok) WHERE length(word) > 1) b ON a.word = b.word AND a.g < b.g GROUP BY ALL HAVING sum(a.n) > 5"""))
def ngram_cooccurrence(spark, sf_dir):
    """Pairs of different two-letter runs of one word; pairs are made inside the word's own array, once a distinct word."""
    n = token_facts(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"))
    g = n.select("n", F.array_distinct(text.char_ngrams(F.col("word"), 2)).alias("g"))
    first = g.select("n", "g", F.explode("g").alias("first"))
    return first.select("n", "first", F.explode(F.filter("g", lambda x: x > F.col("first"))).alias("second")).groupBy("first", "second").agg(F.sum("n").alias("n")).where("n > 5")


@query(with_pages("""SELECT currier, word, n, rank FROM (SELECT currier, word, n, row_number() OVER (PARTITION BY currier ORDER BY n DESC, f) AS rank FROM (SELECT currier, word, count(*) AS n, min((seq_id, ln, wi)) AS f FROM tok GROUP BY currier, word)) WHERE rank <= 10"""))
def top_words_first_seen_ties(spark, sf_dir):
    return stats.top_words(token_facts(spark, sf_dir), 10, ["seq_id", "ln", "wi"], by=["currier"]).select("currier", "word", "n", F.col("rank").cast("long").alias("rank"))


@query(with_pages("SELECT currier, CAST(sum(n) AS BIGINT) AS total, count(*) AS types, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM (SELECT currier, word, count(*) AS n, sum(count(*)) OVER (PARTITION BY currier) AS t FROM tok GROUP BY currier, word) GROUP BY currier"))
def word_entropy(spark, sf_dir):
    return stats.entropy(token_facts(spark, sf_dir), "word", ["currier"]).select("currier", "total", "types", r6(F.col("entropy"), "entropy"))


_STREAM = f"""st AS (SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY ln, wi, k) AS pos, symbol FROM (SELECT seq_id, ln, wi, unnest(list_concat({UNITS_SQL.format(w='word')}, ['<SPACE>'])) AS symbol, generate_subscripts(list_concat({UNITS_SQL.format(w='word')}, ['<SPACE>']), 1) AS k FROM tok)),
lg AS (SELECT pos, symbol, lag(symbol) OVER w AS a, lag(symbol, 2) OVER w AS b, lag(symbol, 3) OVER w AS c FROM st WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
cx AS (SELECT o.k AS k, symbol, pos, CASE o.k WHEN 0 THEN '' WHEN 1 THEN a WHEN 2 THEN b || ' ' || a ELSE c || ' ' || b || ' ' || a END AS ctx FROM lg, (SELECT unnest([0, 1, 2, 3]) AS k) o)"""


@query(with_pages(f"""SELECT k, CAST(sum(n) AS BIGINT) AS events, round(-sum(n / t * log2(n / c)), 6) AS entropy FROM (SELECT k, ctx, symbol, n, sum(n) OVER (PARTITION BY k) AS t, sum(n) OVER (PARTITION BY k, ctx) AS c FROM (
 SELECT k, CASE WHEN k = 0 THEN '' ELSE ctx END AS ctx, symbol, count(*) AS n FROM (SELECT * FROM cx WHERE pos > k) GROUP BY ALL)) GROUP BY k""").replace("\nSELECT k, CAST", f",\n{_STREAM}\nSELECT k, CAST", 1))
def conditional_entropy_k0_k3(spark, sf_dir):
    """Entropy of a unit given the k units before it, contexts within a page."""
    stream = F.flatten(F.transform(F.flatten("lines"), lambda w: F.concat(text.units(w), F.array(F.lit(text.SPACE)))))
    pages = page_lines(spark, sf_dir).select(stream.alias("s"))
    rows = pages.select("s", F.posexplode("s").alias("pos", "symbol"))
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.array_join(F.slice("s", F.greatest(F.col("pos") - k + 1, F.lit(1)), F.least(F.lit(k), F.col("pos"))), " ").alias("ctx")) for k in range(4)])
    events = rows.select("pos", "symbol", F.inline(each)).where("pos >= k")
    return stats.conditional_entropy(events, ["ctx"], "symbol", ["k"]).select("k", "events", r6(F.col("entropy"), "entropy"))


@query(with_pages("SELECT * FROM r").replace("\nSELECT * FROM r", ",\nprs AS (SELECT currier, prev_word AS x, word AS y FROM tokn WHERE prev_word IS NOT NULL),\n" + mi_sql("prs", "currier")))
def adjacent_word_mi_full(spark, sf_dir):
    t = token_facts(spark, sf_dir).where("prev_word is not null")
    return stats.mutual_information(t, "prev_word", "word", ["currier"]).select("currier", "pairs", r6(F.col("mi"), "mi"))


_TOP100 = """top AS (SELECT word FROM tok GROUP BY word ORDER BY count(*) DESC, min((seq_id, ln, wi)) LIMIT 100),
cl AS (SELECT t.*, CASE WHEN v.word IS NULL THEN '<OTHER>' ELSE t.word END AS cword FROM tok t LEFT JOIN top v ON t.word = v.word)"""


@query(with_pages("X").replace("\nX", f",\n{_TOP100},\nprs AS (SELECT lag(cword) OVER (PARTITION BY seq_id, ln ORDER BY wi) AS x, cword AS y FROM cl),\nprz AS (SELECT * FROM prs WHERE x IS NOT NULL),\n" + mi_sql("prz")))
def adjacent_word_mi(spark, sf_dir):
    """With the 100 most frequent words and one sentinel for the others."""
    t = token_facts(spark, sf_dir)
    top = stats.top_words(t, 100, ["seq_id", "ln", "wi"])
    pairs = tokens.collapse(tokens.collapse(t.where("prev_word is not null").select("prev_word", "word"), "word", top), "prev_word", top)
    return stats.mutual_information(pairs, "prev_word", "word").select("pairs", r6(F.col("mi"), "mi"))


@query(with_pages("X").replace("\nX", f",\n{_TOP100},\nprs AS (SELECT cword AS x, CASE WHEN n = 1 THEN 'single' WHEN wi = 0 THEN 'first' WHEN wi = n - 1 THEN 'last' ELSE 'middle' END AS y FROM cl),\n" + mi_sql("prs")))
def line_position_mi(spark, sf_dir):
    t = token_facts(spark, sf_dir)
    return stats.mutual_information(tokens.collapse(t.select("word", "position"), "word", stats.top_words(t, 100, ["seq_id", "ln", "wi"])), "word", "position").select("pairs", r6(F.col("mi"), "mi"))


@query(with_pages("X").replace("\nX", ",\ntop AS (SELECT word FROM tok WHERE topic NOT IN ('?', '@') GROUP BY word ORDER BY count(*) DESC, min((seq_id, ln, wi)) LIMIT 200),\nprs AS (SELECT CASE WHEN v.word IS NULL THEN '<OTHER>' ELSE t.word END AS x, topic AS y FROM tok t LEFT JOIN top v ON t.word = v.word WHERE topic NOT IN ('?', '@')),\n" + mi_sql("prs")))
def metadata_mi_topic(spark, sf_dir):
    t = token_facts(spark, sf_dir).where(~F.col("topic").isin("?", "@"))
    return stats.mutual_information(tokens.collapse(t.select("word", "topic"), "word", stats.top_words(t, 200, ["seq_id", "ln", "wi"])), "word", "topic").select("pairs", r6(F.col("mi"), "mi"))


@query("WITH prs AS (SELECT l_returnflag || l_linestatus AS x, o_orderpriority AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey),\n" + mi_sql("prs", digits=8))
def lineitem_flag_mi(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("flags"))
    # Flags of an order are counted before the join, so the join moves one row an order and flag.
    counts = li.groupBy("l_orderkey", "flags").agg(F.count("*").alias("n"))
    joined = counts.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("flags", "o_orderpriority").agg(F.sum("n").alias("n"))
    log_sum = lambda *k: joined.groupBy(*k).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.log2("n")).alias("s"), F.sum("n").alias("t"))
    xy, x, y = log_sum("flags", "o_orderpriority"), log_sum("flags"), log_sum("o_orderpriority")
    one = xy.crossJoin(x.select(F.col("s").alias("sx"))).crossJoin(y.select(F.col("s").alias("sy")))
    return one.select(F.col("t").alias("pairs"), F.round((F.col("s") - F.col("sx") - F.col("sy")) / F.col("t") + F.log2("t"), 8).alias("mi"))


@query(with_pages("SELECT currier, count(*) AS pairs, round(avg(CASE WHEN prev_word = word THEN 1.0 ELSE 0.0 END), 6) AS exact_rate, round(avg(CASE WHEN levenshtein(prev_word, word) = 1 THEN 1.0 ELSE 0.0 END), 6) AS edit1_rate FROM tokn WHERE prev_word IS NOT NULL GROUP BY currier"))
def adjacency_rates(spark, sf_dir):
    return stats.adjacency_rates(token_facts(spark, sf_dir), ["currier"]).select("currier", "pairs", r6(F.col("exact_rate"), "exact_rate"), r6(F.col("edit1_rate"), "edit1_rate"))


_NG = """ng AS (SELECT currier, seq_id, ln, wi, 2 AS ord, word || ' ' || lead(word) OVER w AS g FROM tok WINDOW w AS (PARTITION BY seq_id, ln ORDER BY wi) UNION ALL SELECT currier, seq_id, ln, wi, 3, word || ' ' || lead(word) OVER w || ' ' || lead(word, 2) OVER w FROM tok WINDOW w AS (PARTITION BY seq_id, ln ORDER BY wi)
 UNION ALL SELECT currier, seq_id, ln, wi, 4, word || ' ' || lead(word) OVER w || ' ' || lead(word, 2) OVER w || ' ' || lead(word, 3) OVER w FROM tok WINDOW w AS (PARTITION BY seq_id, ln ORDER BY wi))"""


@query(with_pages("X").replace("\nX", f",\n{_NG}\nSELECT currier, ord, CAST(sum(n) AS BIGINT) AS instances, round(sum(CASE WHEN n >= 2 THEN n ELSE 0 END) / sum(n), 6) AS rate FROM (SELECT currier, ord, g, count(*) AS n FROM ng WHERE g IS NOT NULL GROUP BY ALL) GROUP BY ALL"))
def repeated_ngram_rates(spark, sf_dir):
    return stats.repeated_ngram_rates(tokens.line_rows(page_lines(spark, sf_dir)), "ws", (2, 3, 4), ["currier"]).select("currier", "ord", "instances", r6(F.col("rate"), "rate"))


@query(with_pages("X").replace("\nX", f",\n{_NG}\nSELECT ord, g AS ngram, n, rank FROM (SELECT ord, g, n, row_number() OVER (PARTITION BY ord ORDER BY n DESC, f) AS rank FROM (SELECT ord, g, count(*) AS n, min((seq_id, ln, wi)) AS f FROM ng WHERE g IS NOT NULL GROUP BY ord, g)) WHERE rank <= 10"))
def top_ngrams(spark, sf_dir):
    from pyspark.sql import Window

    each = F.array(*[F.struct(F.lit(k).alias("ord"), stats.ngrams(F.col("ws"), k).alias("g")) for k in (2, 3, 4)])
    rows = tokens.line_rows(page_lines(spark, sf_dir)).select("seq_id", "ln", F.inline(each)).select("seq_id", "ln", "ord", F.posexplode("g").alias("wi", "ngram"))
    counts = rows.groupBy("ord", "ngram").agg(F.count("*").alias("n"), F.min(F.struct("seq_id", "ln", "wi")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("ord").orderBy(F.desc("n"), "first"))
    counts = counts.withColumn("rank", rank).drop("first")
    rank = F.col("rank")
    return counts.withColumn("rank", rank.cast("long")).where("rank <= 10")


@query("""WITH h0 AS (SELECT DISTINCT ON (entry_id) entry_id, catalog, words FROM herbal_entry ORDER BY entry_id),
w AS (SELECT entry_id, catalog, unnest(words) AS word FROM h0), c AS (SELECT catalog, word, count(*) AS n FROM w GROUP BY ALL)
SELECT c.catalog, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS types, count(*) FILTER (n = 1) AS hapax, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy, arg_max(word, (n, word)) AS top_word, round(max(n) / sum(n), 6) AS top_share, any_value(s.sequences) AS sequences
 FROM c JOIN (SELECT catalog, count(DISTINCT entry_id) AS sequences FROM w GROUP BY catalog) s ON s.catalog = c.catalog GROUP BY c.catalog""")
def sequence_summary(spark, sf_dir):
    words = once(table(spark, sf_dir, "herbal_entry"), "entry_id", "catalog", "words").select("entry_id", "catalog", F.explode("words").alias("word")).where("word is not null and catalog is not null")
    return stats.sequence_summary(words, ["entry_id"], ["catalog"]).select("catalog", "tokens", "types", "hapax", r6(F.col("entropy"), "entropy"), "top_word", r6(F.col("top_share"), "top_share"), "sequences")


@query(with_pages("""SELECT seq_id, ln, wi, word, CAST(floor(((row_number() OVER (PARTITION BY fold ORDER BY seq_id, ln, wi)) * 10 - 1) / count(*) OVER (PARTITION BY fold)) AS BIGINT) AS grp FROM tok"""))
def quantile_groups(spark, sf_dir):
    """Ten contiguous groups of the words of each fold."""
    from folioscope.operators.ranking import ranked_rows
    from folioscope.operators.resample import quantile_group

    t = ranked_rows(token_facts(spark, sf_dir).select("fold", "seq_id", "ln", "wi", "word"), ["fold"], ["seq_id", "ln", "wi"], "r", "all")
    return t.select("seq_id", "ln", "wi", "word", quantile_group(F.col("r"), F.col("all"), 10).cast("long").alias("grp"))


@query("WITH " + CORPORA_SQL.strip() + """
SELECT lang, count(*) AS label_tokens, count(*) FILTER (p.word IS NOT NULL) AS attested, count(DISTINCT c.word) AS types, count(DISTINCT p.word) AS attested_types FROM cw c LEFT JOIN (SELECT DISTINCT unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '\\p{L}+', 0)) AS word FROM documents WHERE text IS NOT NULL) p ON lower(c.word) = p.word GROUP BY lang""")
def lexicon_hit_rate(spark, sf_dir):
    """How many corpus words stand in the lexicon of the documents: a semi-join kept as a flag, on distinct words."""
    words = corpora(spark, sf_dir).select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    lexicon = table(spark, sf_dir, "documents").select(F.explode(text.plain_words(F.col("text"))).alias("p")).distinct()
    j = words.join(lexicon, F.lower("word") == F.col("p"), "left")
    return j.groupBy("lang").agg(F.sum("n").alias("label_tokens"), F.sum(F.when(F.col("p").isNotNull(), F.col("n")).otherwise(0)).alias("attested"), F.count_distinct("word").alias("types"), F.count_distinct("p").alias("attested_types"))


@query("""WITH e AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
prs AS (SELECT prev AS x, event_type AS y FROM e WHERE prev IS NOT NULL),
""" + mi_sql("prs", digits=8))
def event_transition_mi(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("prev", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return stats.mutual_information(e.where("prev is not null"), "prev", "event_type").select("pairs", F.round("mi", 8).alias("mi"))


@query("""WITH c AS (SELECT DISTINCT ON (corpus_id) corpus_id, family, source FROM corpus ORDER BY corpus_id)
SELECT coalesce(nullif(split_part(family, ':', 2), ''), 'unknown') AS branch, sha256(string_agg(CAST(corpus_id AS VARCHAR) || coalesce(source, ''), '|' ORDER BY corpus_id)) AS digest, count(*) AS corpora FROM c GROUP BY ALL""")
def provenance_digest(spark, sf_dir):
    c = once(table(spark, sf_dir, "corpus"), "corpus_id", "family", "source")
    branch = F.coalesce(F.nullif(F.get(F.split("family", ":"), F.lit(1)), F.lit("")), F.lit("unknown"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("corpus_id", F.coalesce("source", F.lit("")).alias("s")))), lambda x: F.concat(x["corpus_id"].cast("string"), x["s"]))
    return c.groupBy(branch.alias("branch")).agg(F.sha2(F.array_join(parts, "|"), 256).alias("digest"), F.count("*").alias("corpora"))
