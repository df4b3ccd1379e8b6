"""Queries of the training-data operators and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import frequency, language, mixing, mojibake, packing, spans, splits, tokens
from folioscope.operators.ranking import ranked_rows
from folioscope.sources.tables import once, table

SPLIT_SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = once(table(spark, sf_dir, "herbal_entry"), "entry_id", "words").select(F.lit("herbal_entry").alias("kind"), F.col("entry_id").alias("id"), "words")
    pages = once(table(spark, sf_dir, "page_sequence"), "seq_id", "lines").select(F.lit("page_sequence").alias("kind"), F.col("seq_id").alias("id"), F.flatten("lines").alias("words"))
    return spans.shared_span_words(entries.unionByName(pages), 12).toDF("record_kind", "record_id", "shared_words")


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pages = once(table(spark, sf_dir, "page_sequence"), "seq_id", "name", "quire", "lines")
    words = table(spark, sf_dir, "decomposition_record").select("rec_id", "page", "quire")
    return pages, words, splits.connected_components(splits.quire_page_edges(pages, words))


def _keyed(df: DataFrame, page: str, components: DataFrame) -> DataFrame:
    node = F.coalesce(splits.page_node(df[page]), splits.quire_node(df["quire"]))
    return df.withColumn("node", node).join(components, "node", "left").withColumn("group_key", F.coalesce(F.substr("component", F.lit(2)), F.lit("")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, _, components = _groups(spark, sf_dir)
    return _keyed(pages.drop("lines"), "name", components).select("seq_id", "group_key")


def _split_rows(spark: SparkSession, sf_dir: str, seeds: int) -> tuple[DataFrame, DataFrame]:
    """Every page and word record with its group, and the groups with their splits; a group weighs its words in both tables."""
    pages, words, components = _groups(spark, sf_dir)
    words = words.dropDuplicates(["rec_id"])
    size = F.when(F.col("lines").isNull(), 0).otherwise(F.size(F.flatten("lines")))
    rows = _keyed(pages, "name", components).select(F.lit("page_sequence").alias("record_kind"), F.col("seq_id").alias("record_id"), "group_key", size.cast("long").alias("words")).unionByName(
        _keyed(words, "page", components).select(F.lit("decomposition_record").alias("record_kind"), F.col("rec_id").alias("record_id"), "group_key", F.lit(1).cast("long").alias("words")))
    weights = rows.groupBy(F.col("group_key").alias("component")).agg(F.sum("words").alias("weight"))
    return rows, splits.assign_splits(weights, SPLIT_SHARES, seeds=seeds).withColumnRenamed("component", "group_key")


def p2_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page and every word record with its group and split."""
    rows, chosen = _split_rows(spark, sf_dir, splits.SEEDS)
    return rows.join(chosen.drop("weight"), "group_key").select("record_kind", "record_id", "group_key", "split", "words")


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, words and share of each split, with the seed chosen and with the first one as it is."""
    parts = []
    for rule, seeds in (("chosen_seed", splits.SEEDS), ("first_seed", 1)):
        _, chosen = _split_rows(spark, sf_dir, seeds)
        total = chosen.agg(F.sum("weight").alias("all"))
        per = chosen.groupBy("split").agg(F.count("*").alias("groups"), F.sum("weight").cast("long").alias("words"))
        parts.append(per.crossJoin(F.broadcast(total)).select(F.lit(rule).alias("rule"), "split", "groups", "words", (F.col("words") / F.col("all")).alias("share")))
    return parts[0].unionByName(parts[1])


def _corpus_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(table(spark, sf_dir, "corpus"), "corpus_id", "words").select(F.lit("corpus").alias("collection"), F.col("corpus_id").cast("string").alias("record"), "words")


def _page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(table(spark, sf_dir, "sequence_record"), "rec_id", "page", "word").select(F.lit("sequence_record").alias("collection"), F.coalesce("page", F.lit("")).alias("record"), "rec_id", "word")


def _term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms are the intervals of depth 1, so their suffixes are cut after one term."""
    corpus, words = _corpus_records(spark, sf_dir), _page_words(spark, sf_dir)
    single = words.select("collection", "record", F.col("rec_id").alias("pos"), frequency.clean_term("word").alias("term")).where("term is not null")
    suffixes = single.unionByName(frequency.term_rows(corpus)).select("collection", "record", "pos", F.array("term").alias("suffix"))
    totals = corpus.select("collection", "record").unionByName(words.select("collection", "record")).groupBy("collection").agg(F.count_distinct("record").alias("total"))
    return frequency.mark_terms(frequency.suffix_counts(suffixes, 1), totals)


def p4_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every n-gram of any length that stands twice or more: words of a corpus in order, words of a page in order of their id."""
    words = ranked_rows(_page_words(spark, sf_dir), ["record"], ["rec_id"], "pos")
    terms = words.select("collection", "record", "pos", frequency.clean_term("word").alias("term")).unionByName(frequency.term_rows(_corpus_records(spark, sf_dir)))
    return frequency.repeated_ngrams(terms).select("collection", "n", F.array_join("ngram", " ").alias("term"), "occurrences", "records")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_counts(spark, sf_dir).where("verdict is not null").select("collection", F.col("ngram")[0].alias("term"), "verdict")


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_counts(spark, sf_dir).select("collection", F.col("ngram")[0].alias("term"), "occurrences", "records", "verdict")


def _restored(spark: SparkSession, sf_dir: str, spans_only: bool) -> DataFrame:
    corpus = table(spark, sf_dir, "corpus").select(F.col("corpus_id").alias("id"), F.substring_index("name", "_", 1).alias("lang"), "source", "words")
    words = corpus.select("id", "lang", F.lit("words").alias("field"), F.posexplode("words").alias("pos", "value"))
    paths = corpus.select("id", "lang", F.lit("source").alias("field"), F.lit(-1).alias("pos"), F.col("source").alias("value"))
    return mojibake.restore(words.unionByName(paths), corpus.select("id", "lang"), spans_only=spans_only).toDF("corpus_id", "field", "pos", "restored")


def p5_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded multibyte spans alone, over the whole table."""
    return _restored(spark, sf_dir, True)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _restored(spark, sf_dir, False)


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_sizes(once(table(spark, sf_dir, "documents"), "doc_id", "text", "source"), "doc_id", "text").withColumnRenamed("doc_id", "id")


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _sizes(spark, sf_dir).select("id", F.col("tokens").alias("size"))
    return packing.pack(items, table(spark, sf_dir, "container_spec")).withColumnRenamed("item", "doc_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the least number that could hold all tokens, and the share of room that is filled, by kind."""
    packed = p6_pack(spark, sf_dir)
    bins = packed.groupBy("container_kind", "container").agg(F.sum("size").alias("fill"))
    spec = table(spark, sf_dir, "container_spec").select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity"))
    per = bins.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest")).join(F.broadcast(spec), "container_kind")
    return per.select("container_kind", "capacity", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), "tokens", "fullest", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("filled"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_target"))[0].withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_target"))[1]


def _languages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = once(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    model = language.fit(table(spark, sf_dir, "lang_reference"), table(spark, sf_dir, "documents"))
    return documents, language.label_segments(documents, model)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, segments = _languages(spark, sf_dir)
    labels = documents.select("doc_id", language.language_code(F.col("lang")).alias("label"))
    return segments.join(labels, "doc_id").where("seg_no > 0 or label is null or label <> lang").select("doc_id", "seg_no", "lang")


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir)[1]


def p8_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How confidence goes with agreement: documents of one language with a label, by tenths of the confidence."""
    documents, segments = _languages(spark, sf_dir)
    labels = documents.select("doc_id", language.language_code(F.col("lang")).alias("label")).where("label is not null")
    one = segments.where("seg_no = 0").join(labels, "doc_id")
    tenth = F.least(F.floor(F.col("confidence") * 10), F.lit(9)).cast("int")
    return one.groupBy(tenth.alias("tenth")).agg(F.count("*").alias("documents"), F.avg("confidence").alias("confidence"), F.avg((F.col("label") == F.col("lang")).cast("double")).alias("agreeing"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_split": p2_split, "p2_shares": p2_shares, "p4_method": p4_method, "p4_found": p4_found, "p4_terms": p4_terms, "p5_method": p5_method, "p5_found": p5_found, "p6_pack": p6_pack, "p6_fill": p6_fill, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_languages": p8_languages, "p8_confidence": p8_confidence}
_TERMS = """WITH c0 AS (SELECT DISTINCT ON (corpus_id) corpus_id, words FROM corpus ORDER BY corpus_id), s0 AS (SELECT DISTINCT ON (rec_id) rec_id, page, word FROM sequence_record ORDER BY rec_id),
raw AS (SELECT 'corpus' AS collection, CAST(corpus_id AS VARCHAR) AS record, unnest(words) AS w FROM c0 UNION ALL SELECT 'sequence_record', coalesce(page, ''), word FROM s0),
term AS (SELECT collection, record, lower(trim(nfc_normalize(w), ' ')) AS term FROM raw WHERE w IS NOT NULL),
tot AS (SELECT 'corpus' AS collection, count(*) AS total FROM c0 UNION ALL SELECT 'sequence_record', count(DISTINCT coalesce(page, '')) FROM s0),
n AS (SELECT collection, term, count(*) AS occurrences, count(DISTINCT record) AS records FROM term WHERE term <> '' GROUP BY ALL),
v AS (SELECT n.*, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.1 * total THEN 'common' END AS verdict FROM n JOIN tot USING (collection))
"""

_NGRAMS = """WITH RECURSIVE c0 AS (SELECT DISTINCT ON (corpus_id) corpus_id, words FROM corpus ORDER BY corpus_id), s0 AS (SELECT DISTINCT ON (rec_id) rec_id, page, word FROM sequence_record ORDER BY rec_id),
raw AS (SELECT 'corpus' AS collection, CAST(corpus_id AS VARCHAR) AS record, CAST(generate_subscripts(words, 1) AS BIGINT) AS pos, unnest(words) AS w FROM c0
 UNION ALL SELECT 'sequence_record', coalesce(page, ''), row_number() OVER (PARTITION BY coalesce(page, '') ORDER BY rec_id), word FROM s0),
t AS (SELECT collection, record, pos, lower(trim(nfc_normalize(w), ' ')) AS term FROM raw WHERE lower(trim(nfc_normalize(w), ' ')) <> ''),
g AS (SELECT 1 AS n, collection, record, pos, term AS gram, count(*) OVER (PARTITION BY collection, term) AS c FROM t
 UNION ALL SELECT n + 1, g.collection, g.record, g.pos, gram || chr(31) || term, count(*) OVER (PARTITION BY g.collection, gram || chr(31) || term) FROM g JOIN t ON t.collection = g.collection AND t.record = g.record AND t.pos = g.pos + n WHERE c > 1)
SELECT collection, CAST(n AS INTEGER) AS n, replace(gram, chr(31), ' ') AS term, count(*) AS occurrences, count(DISTINCT record) AS records FROM g WHERE c > 1 GROUP BY collection, n, gram"""
_WINDOWS = """WITH e0 AS (SELECT DISTINCT ON (entry_id) entry_id, words FROM herbal_entry ORDER BY entry_id), q0 AS (SELECT DISTINCT ON (seq_id) seq_id, lines FROM page_sequence ORDER BY seq_id),
r AS (SELECT 'herbal_entry' AS record_kind, entry_id AS record_id, words FROM e0 UNION ALL SELECT 'page_sequence', seq_id, flatten(lines) FROM q0),
w AS (SELECT record_kind, record_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM r),
g AS (SELECT *, list(word) OVER v AS span, count(word) OVER v AS known FROM w WINDOW v AS (PARTITION BY record_kind, record_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
s AS (SELECT record_kind, span FROM g WHERE known = 12 GROUP BY ALL HAVING count(DISTINCT record_id) > 1),
p AS (SELECT DISTINCT g.record_kind, g.record_id, unnest(range(pos, pos + 12)) AS place FROM g JOIN s ON s.record_kind = g.record_kind AND s.span = g.span WHERE known = 12)
SELECT record_kind, record_id, count(*) AS shared_words FROM p GROUP BY ALL"""
_GROUPS = r"""WITH RECURSIVE q0 AS (SELECT DISTINCT ON (seq_id) seq_id, name, quire FROM page_sequence ORDER BY seq_id),
f AS (SELECT name AS page, quire FROM q0 UNION SELECT page, quire FROM decomposition_record),
n AS (SELECT DISTINCT CASE WHEN regexp_matches(page, '(?i)^\W*f(?:ol|olio)?\W*0*(\d+)\W*([rv]\d*)\W*$') THEN 'f' || regexp_extract(page, '(?i)^\W*f(?:ol|olio)?\W*0*(\d+)\W*([rv]\d*)\W*$', 1) || lower(regexp_extract(page, '(?i)^\W*f(?:ol|olio)?\W*0*(\d+)\W*([rv]\d*)\W*$', 2)) ELSE nullif(lower(trim(page)), '') END AS p,
 CASE WHEN regexp_matches(quire, '(?i)^\W*(?:\$q\s*=|quire\b|q\.)?\W*([a-z])\W*0*(\d+)\W*$') THEN upper(regexp_extract(quire, '(?i)^\W*(?:\$q\s*=|quire\b|q\.)?\W*([a-z])\W*0*(\d+)\W*$', 1)) || regexp_extract(quire, '(?i)^\W*(?:\$q\s*=|quire\b|q\.)?\W*([a-z])\W*0*(\d+)\W*$', 2) END AS q, page FROM f),
e AS (SELECT DISTINCT '1' || p AS a, coalesce('0' || q, '1' || p) AS b FROM n WHERE p IS NOT NULL),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e),
c AS (SELECT a AS v, a AS u FROM both_ways UNION SELECT c.v, x.b FROM c JOIN both_ways x ON x.a = c.u),
m AS (SELECT v, min(u) AS k FROM c GROUP BY v)
SELECT seq_id, coalesce(substring(k, 2), '') AS group_key FROM q0 LEFT JOIN n ON n.page IS NOT DISTINCT FROM q0.name LEFT JOIN m ON m.v = '1' || n.p GROUP BY ALL"""

ORACLE: dict[str, str] = {
    "p1_found": _WINDOWS,
    "p2_found": _GROUPS,
    "p4_method": _NGRAMS,
    "p4_found": _TERMS + "SELECT collection, term, verdict FROM v WHERE verdict IS NOT NULL",
    "p4_terms": _TERMS + "SELECT collection, term, occurrences, records, verdict FROM v",
}
