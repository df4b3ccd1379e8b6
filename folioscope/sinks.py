"""Writers of results: JSON and Markdown reports, score tables, traces, and character datasets.

Reports are made of results of bounded size (one row a group); tables and traces of any size are written by the tasks.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_REPORT_ROWS = 10_000


def report_rows(df: DataFrame) -> list[dict]:
    """The rows of a result that goes into a report; a result too large for one is refused, not cut."""
    rows = df.limit(MAX_REPORT_ROWS + 1).collect()
    if len(rows) > MAX_REPORT_ROWS:
        raise ValueError("this result is no summary: write it as a table")
    return sorted((r.asDict(recursive=True) for r in rows), key=lambda r: json.dumps(r, default=str, sort_keys=True))


def report(parts: Mapping[str, DataFrame]) -> dict[str, list[dict]]:
    return {name: report_rows(df) for name, df in parts.items()}


def _plain(value):
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    return str(value) if value is not None and not isinstance(value, (str, int, float, bool, list, dict)) else value


def json_text(made: Mapping[str, list[dict]]) -> str:
    """Sorted keys, two spaces of indent."""
    return json.dumps({k: [{a: _plain(b) for a, b in r.items()} for r in rows] for k, rows in made.items()}, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def markdown_text(made: Mapping[str, list[dict]], title: str) -> str:
    """A heading and a table for each part."""
    cell = lambda v: f"{v:.6g}" if isinstance(v, float) else str("" if v is None else v).replace("|", "\\|")
    lines = [f"# {title}", ""]
    for name, rows in made.items():
        lines += [f"## {name.replace('_', ' ')}", ""]
        if rows:
            lines += ["| " + " | ".join(rows[0]) + " |", "|" + "-|" * len(rows[0])]
            lines += ["| " + " | ".join(cell(v) for v in r.values()) + " |" for r in rows]
        else:
            lines.append("No rows.")
        lines.append("")
    return "\n".join(lines)


def text_summary(made: Mapping[str, list[dict]]) -> str:
    """One line a row: part, then name=value."""
    return "\n".join(f"{name}: " + "  ".join(f"{k}={_plain(v)}" for k, v in r.items()) for name, rows in made.items() for r in rows) + "\n"


def score_table(df: DataFrame, path: str, by: str) -> None:
    """A tab-separated table in order of ``by``, written by the tasks as ordered parts with a header each."""
    df.orderBy(by).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def trace(df: DataFrame, path: str) -> None:
    """JSON lines, compressed where the name ends in ``.gz``; nested columns stay nested, nulls are kept."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", False)
    (writer.option("compression", "gzip") if path.rstrip("/").endswith(".gz") else writer).json(path)


def character_dataset(texts: DataFrame, text_col: str, order: str, path: str, share: float = 0.9, clip: int | None = None) -> DataFrame:
    """Writes (part, pos, id) of all characters of the texts in order, the first ``share`` as training, and returns the vocabulary (c, id).

    Positions come from ranks of the texts and running sizes of their partitions, so no text of texts is made. ``clip`` keeps the first characters.
    """
    from folioscope.operators.ranking import ranked_rows

    chars = texts.where(F.length(text_col) > 0).select(F.col(order).alias("_o"), F.posexplode(F.split(text_col, "")).alias("_k", "c"))
    placed = ranked_rows(chars, [], ["_o", "_k"], "pos", "_n")
    if clip is not None:
        placed = placed.where(F.col("pos") < clip).withColumn("_n", F.least(F.col("_n"), F.lit(clip)))
    vocabulary = ranked_rows(placed.select("c").distinct(), [], ["c"], "id")
    coded = placed.join(F.broadcast(vocabulary), "c")  # an alphabet: code points are bounded
    part = F.when(F.col("pos") < F.floor(F.col("_n") * share), "train").otherwise("val")
    coded.select(part.alias("part"), "pos", F.col("id").cast("int").alias("id")).write.mode("overwrite").partitionBy("part").parquet(path)
    return vocabulary


def write_text(path: str, content: str) -> None:
    Path(path).write_text(content, encoding="utf-8")
