"""Readers of OCR and page markup and of catalogue pages."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text


def ocr_words(spark: SparkSession, path: str, sections: DataFrame, least_confidence: float = 50) -> DataFrame:
    """(page, section, word) of OCR XML with one OBJECT a page: confident Hebrew words of 1 to 20 letters, finals folded.

    ``sections`` has (section, first, last), a small table of page ranges; the first matching range in order of its start wins. The bytes come
    with the row, so any file system will do; pages are parsed one by one and let go.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                for _, node in ET.iterparse(io.BytesIO(content), events=("end",)):
                    if node.tag != "OBJECT":
                        continue
                    name = next((p.get("value") for p in node.iter("PARAM") if p.get("name") == "PAGE"), "")
                    digits = "".join(c for c in name.rsplit(".", 1)[0].rsplit("_", 1)[-1] if c.isdigit())
                    rows = [(int(digits or 0), float(w.get("x-confidence") or 0), w.text or "") for w in node.iter("WORD")]
                    node.clear()
                    if rows:
                        yield pd.DataFrame(rows, columns=["page", "confidence", "raw"])

    files = spark.read.format("binaryFile").load(path).select("content")
    words = files.mapInPandas(run, "page int, confidence double, raw string").where(F.col("confidence") >= least_confidence)
    words = words.select("page", F.explode(F.regexp_extract_all("raw", F.lit("([\u05d0-\u05ea]+)"), F.lit(1))).alias("word")).where(F.length("word").between(1, 20))
    ranges = sections.select("section", "first", "last").orderBy("first", "section").collect()  # a handful of ranges
    section = F.coalesce(*[F.when(F.col("page").between(r["first"], r["last"]), r["section"]) for r in ranges], F.lit(None).cast("string"))
    return words.select("page", section.alias("section"), text.medial_letters(F.col("word")).alias("word")).where("section is not null")


def page_lines(files: DataFrame) -> DataFrame:
    """(line_id, y, text) of page XML given as (name, content): the last file wins for a line id, lines go by least y."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = lambda n: n.tag.rpartition("}")[2]
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["name"], pdf["content"]):
                for line in (n for n in ET.fromstring(content).iter() if local(n) == "TextLine"):
                    points = next((n.get("points", "") for n in line if local(n) == "Coords"), "")
                    words = next((u.text or "" for e in line if local(e) == "TextEquiv" for u in e if local(u) == "Unicode"), "")
                    ys = [float(p.split(",")[1]) for p in points.split() if "," in p]
                    rows.append((name, line.get("id"), min(ys, default=0.0), words))
            yield pd.DataFrame(rows, columns=["name", "line_id", "y", "text"])

    lines = files.select("name", "content").mapInPandas(run, "name string, line_id string, y double, text string")
    latest = lines.withColumn("_r", F.row_number().over(Window.partitionBy("line_id").orderBy(F.desc("name")))).where("_r = 1")
    return latest.select("line_id", "y", "text")


def entries(paragraphs: DataFrame, starters: Sequence[str] = (), marker: str = r"^f?\d+[rv]$") -> DataFrame:
    """(doc, entry, heading, words) from (doc, pos, words): a paragraph of at most three words is a heading, later ones are its body.

    A longer paragraph whose second to fourth word is a prose starter is a heading and the beginning of its body. A paragraph that is
    a folio marker ends the entry before it. Islands of each document by a running count; headings without a body are left out.
    """
    joined = F.array_join("words", " ")
    at = F.array_min(F.filter(F.transform(F.array(*[F.lit(x) for x in starters]).cast("array<string>"), lambda x: F.array_position(F.slice("words", 2, 3), x)), lambda k: k > 0)) if starters else F.lit(None).cast("long")
    rows = paragraphs.where(F.size("words") > 0).select("doc", "pos", "words", joined.rlike(marker).alias("mark"), at.alias("at"))
    short = F.size("words") <= 3
    rows = rows.withColumn("head", F.when(F.col("mark"), F.lit(None)).when(short, joined).when(F.col("at").isNotNull(), F.array_join(F.slice("words", F.lit(1), F.col("at").cast("int")), " ")))
    rows = rows.withColumn("body", F.when(F.col("mark") | short, F.array().cast("array<string>")).when(F.col("at").isNotNull(), F.slice("words", F.col("at").cast("int") + 1, F.size("words"))).otherwise(F.col("words")))
    over = Window.partitionBy("doc").orderBy("pos")
    rows = rows.withColumn("entry", F.sum((F.col("head").isNotNull() | F.col("mark")).cast("int")).over(over))
    body = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]))
    made = rows.where("entry > 0").groupBy("doc", "entry").agg(F.max("head").alias("heading"), body.alias("words"))
    return made.where(F.col("heading").isNotNull() & (F.size("words") > 0))


def training_subset(content: str, keep: Mapping[str, str]) -> str:
    """Page XML with the lines of ``keep`` only, their text replaced and its confidence set to 1."""
    root = ET.fromstring(content)
    local = lambda n: n.tag.rpartition("}")[2]
    for parent in list(root.iter()):
        for line in [n for n in parent if local(n) == "TextLine"]:
            if line.get("id") not in keep:
                parent.remove(line)
                continue
            for equiv in (n for n in line if local(n) == "TextEquiv"):
                equiv.set("conf", "1.0")
                for u in (n for n in equiv if local(n) == "Unicode"):
                    u.text = keep[line.get("id")]
    return ET.tostring(root, encoding="unicode")
