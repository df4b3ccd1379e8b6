"""Text read in the wrong character encoding: find the values and restore them.

Characters are mapped back to the bytes of a legacy encoding. Over those bytes runs the automaton of well-formed
UTF-8 (compiled, for each legacy encoding, into a regular expression over characters); its maximal multibyte spans
are decoded and nothing else is touched. It is run again as long as spans are left, for text damaged several times.
Damage from one legacy encoding to another leaves no multibyte spans; there the bytes are read again in the other encoding.

Each reading is a hypothesis. A hypothesis holds for a value if the restored form is a more usual word of the whole
collection, or has fewer characters that are unusual in the record's language. The hypothesis with most values of a
record behind it is taken for the record first, so that rare words follow the rest. Values holding U+FFFD have lost characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut_lineage

# Encodings text may have been read in, for UTF-8 bytes; (read in, written in) for others. cp1252 stands for latin-1 too.
READ_IN = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "iso8859_2", "koi8_r")
BYTE_PAIRS = (("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "iso8859_2"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "iso8859_5"), ("cp1252", "cp1253"), ("cp1252", "iso8859_7"), ("cp1252", "cp1255"), ("cp1252", "iso8859_8"), ("cp1252", "mac_roman"))
USUAL_SHARE = 0.2
KNOWN_RECORDS = 3
LOST = "�"


@lru_cache
def _char_of_byte(encoding: str) -> tuple[str, ...]:
    """Character of each byte; a byte without one stands for the control character of its number."""
    table = [bytes([b]).decode(encoding, "replace") for b in range(256)]
    return tuple(chr(b) if c == LOST else c for b, c in enumerate(table))


@lru_cache
def _byte_of_char(encoding: str) -> dict[str, int]:
    found = {c: b for b, c in enumerate(_char_of_byte(encoding))}
    return {chr(b): b for b in range(0x80, 0xA0)} | found  # bytes 80-9F may have been read as control characters


@lru_cache
def _automaton(encoding: str) -> re.Pattern:
    """Maximal runs of well-formed multibyte UTF-8, over the characters that stand for the bytes."""
    chars: dict[int, str] = {}
    for c, b in _byte_of_char(encoding).items():
        chars[b] = chars.get(b, "") + c
    cls = lambda lo, hi: "[" + "".join(re.escape(chars.get(b, "")) for b in range(lo, hi + 1)) + "]"
    ok = lambda *ranges: all(any(b in chars for b in range(lo, hi + 1)) for lo, hi in ranges)
    tail = (0x80, 0xBF)
    forms = [((0xC2, 0xDF), tail), ((0xE0, 0xE0), (0xA0, 0xBF), tail), ((0xE1, 0xEC), tail, tail), ((0xED, 0xED), (0x80, 0x9F), tail), ((0xEE, 0xEF), tail, tail), ((0xF0, 0xF0), (0x90, 0xBF), tail, tail), ((0xF1, 0xF3), tail, tail, tail), ((0xF4, 0xF4), (0x80, 0x8F), tail, tail)]
    return re.compile("(?:" + "|".join("".join(cls(*r) for r in form) for form in forms if ok(*form)) + ")+")


def decode_spans(text: str, encoding: str) -> str:
    """``text`` with its maximal well-formed multibyte spans decoded."""
    table = _byte_of_char(encoding)
    return _automaton(encoding).sub(lambda m: bytes(table[c] for c in m[0]).decode("utf-8"), text)


@lru_cache
def _char_map(read_in: str, written_in: str) -> dict[int, str]:
    """What a character read in one encoding was in the other; characters without a byte, and bytes without a character, are left out."""
    made = {}
    for c, b in _byte_of_char(read_in).items():
        other = bytes([b]).decode(written_in, "replace")
        if c > "\x7f" and other != LOST:
            made[ord(c)] = other
    return made


def reread(text: str, read_in: str, written_in: str) -> str | None:
    """The bytes of ``text`` read in the encoding they were written in; null if a character has no byte or a byte no character."""
    table = _char_map(read_in, written_in)
    return text.translate(table) if all(c <= "\x7f" or ord(c) in table for c in text) else None


_NEIGHBOURS = re.compile(r"[^\x00-\x7f]{2}")


def readings(text: str) -> Iterator[tuple[int, str]]:
    """(number of the hypothesis, restored text) where it differs: spans decoded once, twice and so on in one encoding have
    numbers from 0, readings of bytes in another encoding have numbers below 0."""
    if _NEIGHBOURS.search(text):  # a multibyte span has two characters outside ASCII at least
        for k, encoding in enumerate(READ_IN):
            before, depth = text, 0
            while (after := decode_spans(before, encoding)) != before:
                yield depth * len(READ_IN) + k, after
                before, depth = after, depth + 1
    odd = {ord(c) for c in text if c > "\x7f"}
    for k, pair in enumerate(BYTE_PAIRS):
        table = _char_map(*pair)
        if odd <= table.keys():
            other = text.translate(table)
            if other != text:
                yield -1 - k, other


def plain_form(text: str) -> str:
    return unicodedata.normalize("NFC", text).strip().lower()


def oddness(text: str, usual: frozenset[str]) -> int:
    """Characters outside ASCII that are unusual in the language, and capitals after a small letter."""
    composed = unicodedata.normalize("NFC", text)
    odd = sum(c > "\x7f" and c not in usual and not set(c.lower()) <= usual for c in composed)
    return odd + (0 if composed.islower() else sum(a.islower() and b.isupper() for a, b in zip(composed, composed[1:])))


_CONTROL = re.compile("[\x7f-\x9f]")


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    alphabets: dict[str, frozenset[str]] = {}
    for pdf in batches:
        rows = []
        for lang, value, letters in zip(pdf["lang"], pdf["value"], pdf["letters"]):
            alphabet = alphabets.get(lang)
            if alphabet is None:
                alphabet = alphabets[lang] = frozenset(letters or "")
            before = -1
            for h, restored in readings(value):
                if _CONTROL.search(restored):
                    continue
                before = oddness(value, alphabet) if before < 0 else before
                after = oddness(restored, alphabet)
                if after <= before:
                    rows.append((lang, value, h, restored, plain_form(value), plain_form(restored), before, after))
        yield pd.DataFrame(rows, columns=["lang", "value", "h", "restored", "old", "new", "odd_old", "odd_new"])


def _plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(plain=pdf["value"].map({v: plain_form(v) for v in pdf["value"].unique()}))


def restore(values: DataFrame, records: DataFrame, word_field: str = "words", spans_only: bool = False) -> DataFrame:
    """(id, field, pos, restored) for the values that a wrong decoding changed; '' where characters are lost.

    ``values`` has (id long, lang string, field string, pos int, value string), one row a value, ``records`` (id, lang), one or more
    rows a record. Words are the values of ``word_field``: they make up the vocabulary. Languages are compared in lower case; a null
    language is a language of its own. Null and empty values and those in ASCII are never cases. Repeated rows of a place count once.
    An empty table gives an empty result. Texts of any length are read whole. Other columns play no part.

    ``spans_only`` keeps to decoded spans: no bytes are read in another encoding, and no value is marked as lost.

    The usual characters of a language are those in at least ``USUAL_SHARE`` of its records, so at most 1 / USUAL_SHARE times as many
    as a record has on average. They come to the values by a join on the language.
    """
    lang = F.lower(F.coalesce("lang", F.lit(""))).alias("lang")
    odd = values.where(F.col("id").isNotNull() & F.col("value").rlike(r"[^\x00-\x7F]")).select(F.col("id"), lang, "field", F.col("pos").cast("int").alias("pos"), "value").dropDuplicates(["id", "field", "pos"])
    odd = cut_lineage(odd.mapInPandas(_plain, "id long, lang string, field string, pos int, value string, plain string"))
    folded = odd.where(F.col("field") == word_field).select("lang", "id", F.col("plain").alias("value")).distinct()
    vocabulary = folded.groupBy("value").agg(F.count_distinct("id").alias("n"))
    letters = folded.select("lang", "id", F.explode(F.array_distinct(F.split(F.regexp_replace("value", r"[\x00-\x7F]", ""), ""))).alias("c")).where("c <> ''").groupBy("lang", "c").agg(F.count_distinct("id").alias("n"))
    sizes = records.where("id is not null").select("id", lang).distinct().groupBy("lang").agg(F.count("*").alias("all"))
    usual = cut_lineage(letters.join(sizes, "lang").where(F.col("n") >= USUAL_SHARE * F.col("all")).groupBy("lang").agg(F.array_join(F.array_sort(F.collect_list("c")), "").alias("letters")))

    distinct = odd.where(~F.contains("value", F.lit(LOST))).select("lang", "value").distinct().join(usual, "lang", "left")
    found = distinct.mapInPandas(_candidates, "lang string, value string, h int, restored string, old string, new string, odd_old int, odd_new int")
    found = cut_lineage(found.where("h >= 0") if spans_only else found)
    known = found.join(vocabulary.toDF("old", "n_old"), "old", "left").join(vocabulary.toDF("new", "n_new"), "new", "left").fillna(0, ["n_old", "n_new"])
    commoner = F.col("n_new") > F.col("n_old")
    spans, plainer = F.col("h") >= 0, F.col("odd_new") < F.col("odd_old")
    holds = commoner | (plainer & ~((F.col("n_old") >= KNOWN_RECORDS) & (F.col("n_new") < F.col("n_old"))))
    rank = F.struct((~commoner).alias("a"), F.col("odd_new").alias("b"), (-F.col("n_new")).alias("c"), F.when(spans, F.col("h")).otherwise(F.lit(1 << 20) - F.col("h")).alias("d"))
    held = known.where(holds).withColumn("rank", rank).groupBy("lang", "value").agg(F.array_sort(F.collect_list(F.struct((~(spans | plainer)).alias("weak"), "rank", "h", "restored"))).alias("options"))
    cases = cut_lineage(odd.select("id", "lang", "field", "pos", "value").join(held, ["lang", "value"]).select("id", "field", "pos", "options"))

    # A reading from one legacy encoding to another that makes a word commoner, but no plainer, follows others of its record only.
    first = F.filter("options", lambda o: (o["restored"] == F.col("options")[0]["restored"]) & ~o["weak"])
    votes = cases.select("id", F.explode(first).alias("o")).groupBy("id", F.col("o.h").alias("h")).agg(F.count("*").alias("n"), F.min("o.rank.d").alias("d"))
    chosen = votes.groupBy("id").agg(F.min_by("h", F.struct(-F.col("n"), F.col("d"))).alias("chosen"))
    own = F.filter("options", lambda o: (o["h"] == F.col("chosen")) & (o["rank"]["b"] <= F.col("options")[0]["rank"]["b"]))
    best = F.when(~F.col("options")[0]["weak"], F.col("options")[0]["restored"])
    restored = cases.join(chosen, "id").select("id", "field", "pos", F.coalesce(F.get(own, F.lit(0))["restored"], best).alias("restored")).where("restored is not null")
    restored = restored.withColumn("restored", F.when(F.contains("restored", F.lit(LOST)), "").otherwise(F.col("restored")))
    if spans_only:
        return restored
    return restored.unionByName(odd.where(F.contains("value", F.lit(LOST))).select("id", "field", "pos", F.lit("").alias("restored")))
