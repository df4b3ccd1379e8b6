"""Language of each document and of each segment of mixed documents, with a confidence.

Multinomial naive Bayes over hashed character n-grams of words. The matrix of log probabilities (``BUCKETS`` rows, one
column a language: a fixed size) goes to every task. A batch of texts is cut into words in one pass; its new words are scored
by one sparse product (the rows of their n-grams, summed by ``reduceat``), and pieces are sums of their words. Pieces end at
clause and sentence ends and after ``PIECE_WORDS`` words, so that a change inside a sentence is seen. Pieces form segments by
the best path with a price for each change of language; stretches below the least length join their neighbours. The confidence is
the posterior with scores tempered by the square root of the number of words, as n-grams of one text aren't independent.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
ALPHA = 0.1
TRAIN_ROWS = 2000
MIN_WORDS = 8
CHANGE = 6.0
TEMPERATURE = 4.0
CACHE_WORDS = 200_000
PIECE_WORDS = 8

# Notations of the languages' names.
NOTATIONS = {
    "en": ("en", "eng", "english", "englisch", "anglais", "inglés", "inglese"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand"),
    "es": ("es", "spa", "esp", "spanish", "español", "espanol", "castellano"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "flemish"),
    "la": ("la", "lat", "latin", "latina", "lingua latina"),
    "he": ("he", "iw", "heb", "hebrew", "עברית", "ivrit"),
}

# What belongs to no language: tags, bracketed references, short phrases in parentheses, codes with digits, dotted or dashed transcriptions.
_NEUTRAL = re.compile(r"</?[^\s<>\x01][^<>\x01]*>|\[[^\[\]\x01]*\]|\((?:[^()\s\x01]+\s*){1,7}\)|–[^\S\n]*[^\s\x01]+|[^\s\x01]*\d[^\s\x01]*|\b[^\W\d_]+(?:\.[^\W\d_]+)+")
_TOKEN = re.compile(r"[^\W\d_]+|[.!?…,;:]+(?=\s|\x01|$)|\n|\x01")
_TEXT_END = "\x01"


def language_code(label: Column) -> Column:
    """The code a label means in any of its notations, null where it names none of the languages."""
    plain = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    table = F.create_map(*[F.lit(x) for code, names in NOTATIONS.items() for name in names for x in (name, code)])
    return F.coalesce(table[plain], table[F.regexp_extract(plain, r"^([a-z]{2,3})[-_]", 1)])


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c)) if not text.isascii() else text.lower()


def _buckets(word: str) -> list[int]:
    w = f"^{word}$"
    return [zlib.crc32(w[i : i + n].encode()) % BUCKETS for n in ORDERS for i in range(len(w) - n + 1)]


def words_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of all texts, folded, with the number of the text and of the piece of each; pieces go on counting over the texts."""
    plain = _TEXT_END.join(t.replace(_TEXT_END, " ").replace("’", "'") for t in texts)
    tokens = np.array(_TOKEN.findall(_fold(_NEUTRAL.sub(" ", plain))), dtype=object)
    if not len(tokens):
        return [], np.zeros(0, int), np.zeros(0, int)
    word = np.fromiter((t[0].isalpha() for t in tokens), bool, len(tokens))
    text = np.cumsum(tokens == _TEXT_END)
    clause = np.cumsum(~word)[word]
    first = np.append(True, clause[1:] != clause[:-1])
    place = np.arange(len(clause)) - np.maximum.accumulate(np.where(first, np.arange(len(clause)), 0))
    piece = np.cumsum(first | (place % PIECE_WORDS == 0)) - 1 if len(clause) else clause
    return tokens[word].tolist(), text[word], piece


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        smooth = counts + ALPHA
        self.prepare(languages, np.log(smooth / smooth.sum(0)).astype(np.float32))

    def prepare(self, languages: list[str], logs: np.ndarray) -> Model:
        self.languages, self.logs = languages, logs
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(languages)), np.float32)
        return self

    def scores(self, words: list[str]) -> np.ndarray:
        """Log probabilities of each word, less the best of its languages; each word is scored once while it is remembered."""
        if len(self.known) > CACHE_WORDS:
            self.prepare(self.languages, self.logs)
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            buckets = [_buckets(w) for w in new]
            starts = np.cumsum([0, *map(len, buckets[:-1])])
            rows = np.add.reduceat(self.logs[np.concatenate(buckets)], starts)
            self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, rows - rows.max(1, keepdims=True)])
        return self.rows[[self.known[w] for w in words]]

    def label_all(self, texts: list[str]) -> list[tuple[int, str, float, int]]:
        """(number of the text, language, confidence, words) of each segment in reading order; none for a text without words."""
        words, text, piece = words_of(texts)
        if not words:
            return []
        at = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
        scores, sizes, owner = np.add.reduceat(self.scores(words), at), np.diff(np.append(at, len(words))), text[at]
        path = scores.argmax(1)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        last = np.append(first[1:], len(owner))
        for k in np.flatnonzero(np.minimum.reduceat(path, first) != np.maximum.reduceat(path, first)):
            span = slice(first[k], last[k])
            path[span] = _segments(scores[span], sizes[span])
        starts = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (owner[1:] != owner[:-1])))
        total, count = np.add.reduceat(scores, starts), np.add.reduceat(sizes, starts)
        odds = np.exp((total - total.max(1, keepdims=True)) / (TEMPERATURE * np.sqrt(count))[:, None])
        share = (odds / odds.sum(1, keepdims=True))[np.arange(len(starts)), path[starts]]
        return [(int(o), self.languages[p], float(c), int(n)) for o, p, c, n in zip(owner[starts], path[starts], share, count)]

    def label(self, text: str) -> list[tuple[str, float, int]]:
        return [s[1:] for s in self.label_all([text])]


def _segments(scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    best = scores.argmax(1)
    if (best == best[0]).all():
        return best
    n, k = scores.shape
    total, back = scores[0].copy(), np.zeros((n, k), int)
    for i in range(1, n):
        top = int(total.argmax())
        change = total[top] - CHANGE
        stay = total >= change
        back[i] = np.where(stay, np.arange(k), top)
        total = np.where(stay, total, change) + scores[i]
    path = np.empty(n, int)
    path[-1] = total.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    while True:  # the shortest stretch below the least length joins the neighbour that its words fit better
        starts = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
        if len(starts) == 1:
            return path
        words, own = np.add.reduceat(sizes, starts), np.add.reduceat(scores, starts)
        short = int(words.argmin())
        if words[short] >= MIN_WORDS:
            return path
        near = [path[starts[j]] for j in (short - 1, short + 1) if 0 <= j < len(starts)]
        path[starts[short] : starts[short + 1] if short + 1 < len(starts) else n] = max(near, key=lambda c: own[short][c])


def _count(languages: list[str], rows: list[tuple[str, str]]) -> np.ndarray:
    counts = np.zeros((BUCKETS, len(languages)))
    words, text, _ = words_of([t for _, t in rows])
    if words:
        column = np.array([languages.index(lang) for lang, _ in rows])[text]
        known: dict[tuple[str, int], int] = {}
        for key in zip(words, column):
            known[key] = known.get(key, 0) + 1
        for (word, c), n in known.items():
            np.add.at(counts[:, c], _buckets(word), n)
    return counts


def fit(reference: DataFrame, documents: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from (lang, sample_text) and, to fill it out, from at most ``train_rows`` labelled documents.

    Documents (doc_id, text, lang) are taken in the order of a hash of their id; those count whose label agrees
    with what the reference alone makes of the whole text. Null texts and labels are skipped.
    """
    rows = [(r[0], r[1]) for r in reference.select("lang", "sample_text").where("lang is not null and sample_text is not null").collect()]
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        raise ValueError("no reference samples")
    counts = _count(languages, rows)
    if documents is None:
        return Model(languages, counts)
    model = Model(languages, counts)
    sample = documents.select("doc_id", "text", language_code(F.col("lang")).alias("code")).where("text is not null and code is not null").orderBy(F.xxhash64("doc_id")).limit(train_rows).collect()
    found: dict[int, list[str]] = {}
    for owner, lang, _, _ in model.label_all([r.text for r in sample]):
        found.setdefault(owner, []).append(lang)
    sure = [(r.code, r.text) for k, r in enumerate(sample) if found.get(k) == [r.code]]
    return Model(languages, counts + _count(languages, sure))


def label_segments(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, seg_no, lang, confidence, words) of each document (doc_id, text): seg_no 0 for a document of one
    language, from 1 in reading order for several.

    Neighbouring segments differ in language and have at least ``MIN_WORDS`` words; a shorter document still gets its one
    language. Null, empty and blank texts, and those of figures, tags or signs only, give no row. Repeated rows give
    repeated results; equal scores go to the first language in order of code. Texts are read whole. Other columns play no part.
    """
    languages, logs = model.languages, model.logs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model.__new__(Model).prepare(languages, shared.value)
        for pdf in batches:
            found = own.label_all(pdf["text"].tolist())
            if not found:
                continue
            owner = np.array([s[0] for s in found])
            new = np.append(True, owner[1:] != owner[:-1])
            place = np.arange(len(owner)) - np.maximum.accumulate(np.where(new, np.arange(len(owner)), 0)) + 1
            alone = np.bincount(owner)[owner] == 1
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[owner], "seg_no": np.where(alone, 0, place), "lang": [s[1] for s in found], "confidence": [s[2] for s in found], "words": [s[3] for s in found]})

    shared = documents.sparkSession.sparkContext.broadcast(logs)
    return documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInPandas(run, "doc_id long, seg_no int, lang string, confidence double, words int")
