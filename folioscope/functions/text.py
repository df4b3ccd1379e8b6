"""Column functions on words, units and lines; all run inside the JVM except where named ``*_udf``."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Composite units of the transcription alphabet, in the order they are tried, and sentinels.
UNIT_GROUPS = ("ckh", "cth", "cph", "cfh", "ch", "sh")
OTHER, SPACE, BOUNDARY, UNKNOWN_WORD, BOS, EOW, UNKNOWN = "<OTHER>", "<SPACE>", "<W>", "<UNKNOWN_WORD>", "<BOS>", "<EOW>", "<UNKNOWN>"
FINALS, MEDIALS = "ךםןףץ", "כמנפצ"
SEP = "\x1f"


def casefolded(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def plain_words(text: Column) -> Column:
    """Maximal runs of letters, case-folded."""
    return F.regexp_extract_all(casefolded(text), F.lit(r"(\p{L}+)"), F.lit(1))


def letter_mark_words(text: Column) -> Column:
    """Runs that begin with a letter and go on with letters and marks, case-folded."""
    return F.regexp_extract_all(casefolded(text), F.lit(r"(\p{L}[\p{L}\p{M}]*)"), F.lit(1))


def unmarked_words(text: Column) -> Column:
    """As ``letter_mark_words`` with the marks dropped."""
    return F.transform(letter_mark_words(text), lambda w: F.regexp_replace(w, r"\p{M}", ""))


def control_words(text: Column) -> Column:
    """Lower-case letter runs with one inner apostrophe part."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+(?:['’]\p{L}+)?)"), F.lit(1))


def units(word: Column, grouped: bool = True) -> Column:
    return F.regexp_extract_all(word, F.lit(f"((?s:{'|'.join(UNIT_GROUPS)}|.))" if grouped else "((?s:.))"), F.lit(1))


def unit_pattern(u: Column) -> Column:
    """Multiplicities of the distinct symbols, descending, joined by commas."""
    n = F.transform(F.array_distinct(u), lambda s: F.size(F.filter(u, lambda x: x == s)))
    return F.array_join(F.transform(F.sort_array(n, asc=False), lambda x: x.cast("string")), ",")


def anagram_key(u: Column) -> Column:
    return F.array_join(F.array_sort(u), SEP)


def length_bucket(n: Column) -> Column:
    return F.when(n < 8, n.cast("string")).otherwise("8+")


def signature(u: Column, depth: int) -> Column:
    """Length bucket, first ``depth`` units, bar, last ``depth`` units; prefix and suffix may overlap."""
    n = F.size(u)
    head = F.array(length_bucket(n))
    if depth == 0:
        return F.concat(head, F.array(F.lit("|")))
    return F.concat(head, F.slice(u, 1, depth), F.array(F.lit("|")), F.slice(u, F.greatest(n - depth + 1, F.lit(1)), F.lit(depth)))


def line_position(i: Column, n: Column) -> Column:
    return F.when(n == 1, "single").when(i == 0, "first").when(i == n - 1, "last").otherwise("middle")


def paragraph_state(line: Column, ends: Column) -> Column:
    return F.concat(F.when(line < 3, line.cast("string")).otherwise("3+"), F.lit(":"), F.when(ends, "end").otherwise("open"))


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def char_ngrams(word: Column, n: int) -> Column:
    last = F.length(word) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def medial_letters(text: Column) -> Column:
    return F.translate(text, FINALS, MEDIALS)


def legacy_clean(line: Column) -> Column:
    """The older cleaning, which drops every tag and with it drawing gaps."""
    return F.regexp_replace(line, r"<.*?>", "")


def drop_romans_and_brackets(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, r"\b[MCDXLIV]+\b", ""), r"\[.*?\]", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def mark_count(text: Column, mark: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("long")


def paragraphs(markup: Column) -> Column:
    """Text of each ``<p>`` without bracketed notes and tags, white space folded; entities stay."""
    raw = F.regexp_extract_all(markup, F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))
    return F.transform(raw, lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"\[[^\]]*\]", ""), r"<[^>]+>", " "), r"\s+", " ")))


def between_anchors(markup: Column, start: str, end: str) -> Column:
    """The text after the first ``start`` up to the next ``end``, null where either is missing."""
    after = F.when(F.contains(markup, F.lit(start)), F.substring(markup, F.locate(start, markup) + len(start), F.length(markup)))
    return F.when(F.contains(after, F.lit(end)), F.substring(after, F.lit(1), F.locate(end, after) - 1))


def title_forms(title: Column, least: int = 2) -> Column:
    """The title without spaces and its prefixes of at least ``least`` letters, longest first, once each."""
    whole = F.regexp_replace(title, r"\s+", "")
    n = F.length(whole)
    return F.when(n >= least, F.array_distinct(F.transform(F.sequence(n, F.lit(least), F.lit(-1)), lambda k: F.substring(whole, F.lit(1), k)))).otherwise(F.array().cast("array<string>"))


def _mapped(function):
    def run(values: pd.Series) -> pd.Series:
        return values.map({v: function(v) for v in values.dropna().unique()})

    return F.pandas_udf(run, T.StringType())


def _strip_marks(text: str, form: str) -> str:
    return "".join(c for c in unicodedata.normalize(form, text) if not unicodedata.combining(c))


nfc_udf = _mapped(lambda s: unicodedata.normalize("NFC", s))
unescape_udf = _mapped(html.unescape)
unmarked_nfd_udf = _mapped(lambda s: _strip_marks(s, "NFD"))
unmarked_nfkd_udf = _mapped(lambda s: _strip_marks(s, "NFKD"))
nfkc_udf = _mapped(lambda s: unicodedata.normalize("NFKC", s))
