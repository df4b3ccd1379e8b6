"""Relations shared by the queries, and the same relations as SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import tokens
from folioscope.sources.tables import once, table

SEED = 408


def page_lines(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """``parts``: partitions in which the pages are to lie; the exchange that finds redelivered pages makes them."""
    pages = table(spark, sf_dir, "page_sequence")
    return tokens.pages(once(pages.repartition(parts, "seq_id") if parts else pages, "seq_id", "currier", "topic", "quire", "lines"))


def token_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_rows(page_lines(spark, sf_dir))


def corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus_id, lang, words) without null and blank words."""
    lang = F.lower(F.substring_index("name", "_", 1))
    words = F.filter("words", lambda w: F.trim(w) != "")
    return once(table(spark, sf_dir, "corpus"), "corpus_id", "name", "words").select("corpus_id", lang.alias("lang"), words.alias("words")).where(F.size("words") > 0)


PAGES_SQL = """
pg0 AS (SELECT DISTINCT ON (seq_id) seq_id, currier, topic, quire, lines FROM page_sequence ORDER BY seq_id),
pg AS (SELECT seq_id, coalesce(currier, '?') AS currier, coalesce(topic, '?') AS topic,
  CASE WHEN regexp_extract(upper(coalesce(quire, '')), '([A-Z])-?[0-9]+', 1) <> '' THEN regexp_extract(upper(quire), '([A-Z])-?[0-9]+', 1) ELSE '?' END AS fold,
  list_filter(list_transform(lines, lambda ws: list_filter(ws, lambda w: w IS NOT NULL)), lambda ws: len(ws) > 0) AS lines FROM pg0 WHERE lines IS NOT NULL),
ln AS (SELECT seq_id, currier, topic, fold, unnest(lines) AS ws, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS ln FROM pg),
tok AS (SELECT seq_id, currier, topic, fold, ln, CAST(len(ws) AS INTEGER) AS n, unnest(ws) AS word, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS wi FROM ln),
tokn AS (SELECT *, lag(word) OVER (PARTITION BY seq_id, ln ORDER BY wi) AS prev_word,
  CASE WHEN n = 1 THEN 'single' WHEN wi = 0 THEN 'first' WHEN wi = n - 1 THEN 'last' ELSE 'middle' END AS position FROM tok)
"""

CORPORA_SQL = """
co0 AS (SELECT DISTINCT ON (corpus_id) corpus_id, name, words FROM corpus ORDER BY corpus_id),
co AS (SELECT corpus_id, lower(split_part(name, '_', 1)) AS lang, list_filter(words, lambda w: trim(w, ' ') <> '') AS words FROM co0 WHERE words IS NOT NULL),
cw AS (SELECT corpus_id, lang, unnest(words) AS word, CAST(generate_subscripts(words, 1) - 1 AS INTEGER) AS pos FROM co)
"""

UNITS_SQL = "regexp_extract_all({w}, 'ckh|cth|cph|cfh|ch|sh|.', 0)"


def with_pages(sql: str) -> str:
    return f"WITH {PAGES_SQL.strip()}\n{sql}"


def mi_sql(pairs: str, by: str = "", x: str = "x", y: str = "y", digits: int = 6) -> str:
    """Mutual information of (x, y) of the relation ``pairs`` (by, x, y), by the definition over joint and marginal counts."""
    g, p = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    px, py = (f"PARTITION BY {by}, {x}", f"PARTITION BY {by}, {y}") if by else (f"PARTITION BY {x}", f"PARTITION BY {y}")
    return f"""jn AS (SELECT {g}{x}, {y}, count(*) AS c FROM {pairs} GROUP BY ALL),
mg AS (SELECT *, sum(c) OVER ({p}) AS t, sum(c) OVER ({px}) AS cx, sum(c) OVER ({py}) AS cy FROM jn)
SELECT {g}CAST(sum(c) AS BIGINT) AS pairs, round(sum(c / t * log2(c * t / (CAST(cx AS DOUBLE) * cy))), {digits}) AS mi FROM mg {'GROUP BY ' + by if by else ''}"""
