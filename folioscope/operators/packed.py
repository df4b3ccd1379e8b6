"""Several values packed in one field: one row per value with its position.

Each string is reduced to a *delimiter skeleton*: quoted stretches, escapes and ordinary characters are
masked, and what is left is the enclosing mark, the kinds of quoting and the set of separators in use. All
strings of one skeleton are split by one rule. Rules are made once per distinct skeleton and joined back by
broadcast. The number of skeletons has a fixed bound whatever the data: 4 enclosures x 2 x 2 x 2 flags x
2^10 separator sets (``SEPARATORS`` and one class for every other sign), and rules are short strings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut_lineage

# Separators told apart in a skeleton; any other sign outside a word falls into one class.
SEPARATORS = (" ", "\t", ",", ";", "|", ".", "·", ":", "/")
OTHER_SIGN = "o"
ENCLOSURES = {"[": "]", "(": ")", "{": "}"}

# Ordinary characters of a word: letters, marks, digits, the uncertainty sign and codes.
_ORD = r"\p{L}\p{M}\p{N}?_@<>&%#*+"
_CODE = r"@\d{3};"
_DQ = r'"(?:[^"\\]|\\.|"")*"'
_SQ = r"'(?:[^'\\]|\\.|'')*'"


def _innermost(text: Column) -> Column:
    """First alternatives and contents of ligatures in place of brackets that hold no others."""
    text = F.regexp_replace(text, r"\[([^\[\]:]*)(?::[^\[\]]*)?\]", "$1")
    return F.regexp_replace(text, r"\{([^{}]*)\}", "$1")


def resolve_brackets(text: Column) -> Column:
    """``_innermost`` to its fixpoint. Two passes, which nearly all texts need at most, stay in generated code; deeper
    texts go on for as many passes as brackets are open at once in them."""
    twice = _innermost(_innermost(text))
    step = lambda s, c: F.when(c.isin("[", "{"), F.struct((s["open"] + 1).alias("open"), F.greatest(s["most"], s["open"] + 1).alias("most"))).otherwise(F.struct(F.greatest(s["open"] - 1, F.lit(0)).alias("open"), s["most"].alias("most")))
    marks = F.split(F.regexp_replace(twice, r"[^\[\]{}]", ""), "")
    nesting = F.aggregate(marks, F.struct(F.lit(0).alias("open"), F.lit(0).alias("most")), step)["most"]
    deep = F.aggregate(F.sequence(F.lit(1), nesting), twice, lambda t, _: _innermost(t))
    return F.when(twice.rlike(r"\[[^\[\]]*\]|\{[^{}]*\}"), deep).otherwise(twice)


def resolve_transcription(raw: Column, loose: bool = True) -> Column:
    """Transcription markup to words and separators: drawing gaps become ``.``, marks, tags and comments vanish,
    the first alternative and the content of a ligature stay, ``@ddd;`` becomes ``Uddd``.

    Brackets are resolved at any depth. ``loose`` takes ``=`` and ``-`` as separators too.
    """
    text = F.regexp_replace(raw, r"<!.*?>", "")
    text = F.regexp_replace(text, r"<[-~]>", ".")
    text = resolve_brackets(F.regexp_replace(text, r"<[%$]>|<@[A-Z]=[^>]+>", ""))
    text = F.regexp_replace(text, r"@(\d{3});", "U$1")
    text = F.replace(text, F.lit("/"), F.lit(""))
    return F.regexp_replace(text, r"[=\-]", ".") if loose else text


def _enclosure(text: Column) -> Column:
    return F.coalesce(*[F.when(text.startswith(a) & text.endswith(b) & (F.length(text) > 1), F.lit(a)) for a, b in ENCLOSURES.items()], F.lit(""))


def skeleton(body: Column, enclosure: Column, single_quotes: Column) -> Column:
    """``enclosure`` + flags + the sorted set of separators outside quotes."""
    no_dq = F.regexp_replace(body, rf'(?<![{_ORD}"]){_DQ}(?![{_ORD}"])', "\u0001")
    no_q = F.when(single_quotes, F.regexp_replace(no_dq, rf"(?<![{_ORD}']){_SQ}(?![{_ORD}'])", "\u0002")).otherwise(no_dq)
    no_esc = F.regexp_replace(no_q, r"\\.", "\u0003")
    masked = F.regexp_replace(F.regexp_replace(no_esc, _CODE, ""), rf"""[{_ORD}"'\\]""", "")
    known = "".join(SEPARATORS).replace(".", r"\.").replace("|", r"\|")
    signs = F.regexp_replace(masked, rf"[^{known}\u0001\u0002\u0003]", OTHER_SIGN)
    return F.concat(enclosure, F.when(single_quotes, "'").otherwise('"'), F.array_join(F.array_sort(F.array_distinct(F.split(signs, ""))), ""))


def resolve_rule(skel: str) -> tuple[str, str]:
    """(pattern of one value, quotes in use) for a skeleton."""
    body = skel[1:] if skel[:1] in ENCLOSURES else skel
    single, signs = body[:1] == "'", body[1:]
    seps = [s for s in SEPARATORS if s in signs]
    cls = "".join("\\" + s if s in ".|" else s for s in seps)
    if OTHER_SIGN in signs:
        cls += rf"""[^{_ORD}"'\\{"".join(SEPARATORS)}]"""
    sep = f"[{cls}]" if cls else r"(?!)"
    bare = f"[^{cls}]" if OTHER_SIGN not in signs else f"(?:(?!{sep})(?s:.))"
    bare = bare if cls else "(?s:.)"
    word = rf"(?:{_CODE}|\\(?s:.)|{bare})+"
    quoted = [q for q, on in ((_DQ, "\u0001" in signs), (_SQ, single and "\u0002" in signs)) if on]
    return "|".join([rf"{q}(?={sep}|$)" for q in quoted] + [word]), "".join(c for c, on in (('"', "\u0001" in signs), ("'", single and "\u0002" in signs)) if on)


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        made = [resolve_rule(s) for s in pdf["_skel"]]
        yield pd.DataFrame({"_skel": pdf["_skel"], "_pattern": [m[0] for m in made], "_quotes": [m[1] for m in made]})


def _unpack(value: Column, quotes: Column) -> Column:
    value = F.trim(F.regexp_replace(value, r"^\s+|\s+$", ""))
    first = F.substring(value, 1, 1)
    is_q = (F.length(value) > 1) & first.isin('"', "'") & F.contains(quotes, first) & (F.substring(value, -1, 1) == first)
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    inner = F.replace(inner, F.concat(first, first), first)
    return F.regexp_replace(F.when(is_q, inner).otherwise(value), r"\\((?s:.))", "$1")


def split_packed(df: DataFrame, id_col: str, transcription: Iterable[str] = (), exported: Iterable[str] = ()) -> DataFrame:
    """Rows (id, field, pos, value) for every value of the named string columns.

    ``transcription`` columns hold transcription markup, ``exported`` columns delimited, quoted, escaped or
    enclosed lists. Values keep their order, ``pos`` counts from 0 over values that aren't empty.

    Null, empty and blank fields, and fields of separators only, give no row. Rows with a null id give none.
    Repeated ids give repeated rows: deduplicate first if an id may come again. Other columns of ``df``,
    whatever their names, play no part. An empty table gives an empty result. Texts of any length are split
    whole; a field of n values is one row until the final explode.
    """
    transcription, exported = list(transcription), list(exported)
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    parts = [F.struct(F.lit(f).alias("field"), strip(resolve_transcription(df[f])).alias("text"), F.lit(False).alias("sq")) for f in transcription]
    parts += [F.struct(F.lit(f).alias("field"), strip(df[f]).alias("text"), F.lit(True).alias("sq")) for f in exported]
    long = df.where(df[id_col].isNotNull()).select(df[id_col].alias("_id"), F.inline(F.array(*parts))).where(F.length("text") > 0)
    enc = F.when(F.col("sq"), _enclosure(F.col("text"))).otherwise("")
    body = F.when(F.col("_enc") != "", F.substring("text", F.lit(2), F.length("text") - 2)).otherwise(F.col("text"))
    long = long.withColumn("_enc", enc).withColumn("_body", body).withColumn("_skel", skeleton(F.col("_body"), F.col("_enc"), F.col("sq"))).select("_id", "field", "_body", "_skel")
    long = cut_lineage(long.sortWithinPartitions("_skel"))  # skeletons are made once; like ones adjoin, so each pattern is compiled once a task
    rules = long.select("_skel").distinct().mapInPandas(_rules, "_skel string, _pattern string, _quotes string")
    found = long.join(F.broadcast(rules), "_skel").select("_id", "field", "_quotes", F.regexp_extract_all("_body", F.col("_pattern"), F.lit(0)).alias("_hits"))
    values = F.filter(F.transform("_hits", lambda v: _unpack(v, F.col("_quotes"))), lambda v: F.length(v) > 0)
    return found.select("_id", "field", F.posexplode(values).alias("pos", "value")).withColumnRenamed("_id", id_col)
