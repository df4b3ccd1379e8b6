"""Reader of transcription files: pages, loci, inherited metadata and tokens.

A file is one record (the format carries state over its lines), so files spread over tasks; within a file the
running state is kept by windows over line numbers of that file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.operators.packed import resolve_transcription

# The format's patterns.
PAGE = r"^<([^.,>]+)>\s+<!\s*(.*?)>"
LOCUS = r"^<([^,>]+),([^;>]+)(?:;([^>]+))?>\s*(.*)$"
VARIABLE, TAG = r"\$([A-Z])=([^\s>]+)", r"<@([A-Z])=([^>]+)>"


def tokens(raw: Column) -> Column:
    """Apparent words: parts between ``.``, ``,`` and drawing gaps, resolved and trimmed."""
    text = F.translate(resolve_transcription(raw, loose=False), ",", ".")
    return F.filter(F.transform(F.split(text, r"\."), lambda t: F.trim(t)), lambda t: t != "")


def certain(all_tokens: Column) -> Column:
    return F.filter(all_tokens, lambda t: t.rlike("^[a-z]+$"))


def _pairs(text: Column, pattern: str) -> Column:
    """Pairs (key, value) of a pattern with two groups, in order."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("v"))


def read_transcription(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, page, locus_id, locator, locus_type, transcriber, raw_text, tokens, certain_tokens, paragraph_start,
    paragraph_end, metadata).

    Blank lines and those that begin with ``#`` are skipped; a line that ends in ``/`` goes on in the next, which begins with
    ``/``. A line that is neither page header nor locus, a locus outside its page, before any page or with a short code, and an
    unfinished line raise an error naming file and line. Later variables win over earlier ones; inline tags hold for later
    loci of the page, ``@`` as value deletes.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("no", "line"))
    raw = raw.select("file", (F.col("no") + 1).alias("no"), F.rtrim("line").alias("line")).where("line <> '' and not startswith(line, '#')")
    w = Window.partitionBy("file").orderBy("no")
    where = F.concat_ws(":", "file", "no")
    open_before = F.coalesce(F.lag(F.col("line").endswith("/")).over(w), F.lit(False))
    raw = raw.withColumn("joined", open_before).withColumn("last", F.lead("no").over(w).isNull())
    bad = (F.col("joined") & ~F.col("line").startswith("/")) | (F.col("line").endswith("/") & F.col("last"))
    raw = raw.withColumn("line", F.when(bad, F.raise_error(F.concat(F.lit("continuation at "), where)).cast("string")).otherwise(F.col("line")))
    raw = raw.withColumn("group", F.sum((~F.col("joined")).cast("int")).over(w))
    piece = F.struct("no", F.regexp_replace(F.when(F.col("joined"), F.trim(F.substring("line", F.lit(2), F.length("line")))).otherwise(F.col("line")), "/$", "").alias("t"))
    lines = raw.groupBy("file", "group").agg(F.array_sort(F.collect_list(piece)).alias("p")).select("file", F.col("p")[0]["no"].alias("no"), F.array_join(F.transform("p", lambda x: x["t"]), "").alias("line"))
    page = F.nullif(F.regexp_extract("line", PAGE, 1), F.lit(""))
    lines = lines.withColumn("header", page).withColumn("page", F.last(page, True).over(w))
    lines = lines.withColumn("vars", F.when(F.col("header").isNotNull(), _pairs(F.regexp_extract("line", PAGE, 2), VARIABLE)).otherwise(_pairs(F.regexp_extract("line", LOCUS, 4), TAG)))
    lines = lines.withColumn("page_no", F.sum(F.col("header").isNotNull().cast("int")).over(w))
    state = F.flatten(F.collect_list("vars").over(Window.partitionBy("file", "page_no").orderBy("no")))
    lines = lines.withColumn("state", state).where("header is null")
    latest = F.aggregate("state", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])))
    part = lambda k: F.regexp_extract("line", LOCUS, k)
    where = F.concat_ws(":", "file", "no")
    problem = F.when(~F.col("line").rlike(LOCUS), "not a locus at ").when(F.col("page").isNull(), "locus before a page at ").when(~part(1).startswith(F.concat("page", F.lit("."))), "locus of another page at ").when(F.length(part(2)) < 2, "short code at ")
    checked = lines.withColumn("line", F.when(problem.isNotNull(), F.raise_error(F.concat(problem, where)).cast("string")).otherwise(F.col("line")))
    t = tokens(part(4))
    return checked.select("file", F.col("no").alias("line_no"), "page", part(1).alias("locus_id"), F.substring(part(2), 1, 1).alias("locator"), F.substring(part(2), F.lit(2), F.length(part(2))).alias("locus_type"), F.nullif(part(3), F.lit("")).alias("transcriber"), part(4).alias("raw_text"), t.alias("tokens"), certain(t).alias("certain_tokens"), F.contains(part(4), F.lit("<%>")).alias("paragraph_start"), F.contains(part(4), F.lit("<$>")).alias("paragraph_end"), F.map_filter(latest, lambda _, v: v != "@").alias("metadata"))
