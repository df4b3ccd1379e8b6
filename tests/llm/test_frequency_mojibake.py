import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioscope.llm.frequency import clean_term, deep_suffixes, mark_terms, repeated_ngrams, suffix_counts, term_rows
from folioscope.llm.mojibake import decode_spans, oddness, readings, reread, restore


@pytest.mark.parametrize("batch", [10000, 7])
def test_counts_against_brute_force(spark, batch):
    rng = random.Random(batch)
    passage = [f"p{k}" for k in range(37)]
    rows = [(rng.choice("ab"), f"r{k}", [rng.choice([f"w{rng.randrange(6)}", "hot", "Hot ", None, "", " "]) for _ in range(rng.randrange(0, 30))]) for k in range(24)] + [("a", "long", ["hot"] * 50), (None, None, ["x"]), ("a", "n", None), ("b", "p", passage + ["q"] + passage), ("b", "s", passage[3:])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "collection string, record string, words array<string>, pos int")
    single = [(c or "", r or "", k, t) for c, r, words in rows for k, w in enumerate(words or []) if (t := (w or "").strip(" ").lower())]
    at = {x[:3]: x[3] for x in single}
    occurrences, records = Counter(), defaultdict(set)
    for c, r, k in at:
        run = ()
        while (c, r, k + len(run)) in at:
            run += (at[c, r, k + len(run)],)
            occurrences[c, run] += 1
            records[c, run].add(r)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.collection, tuple(r.ngram)): (r.n, r.occurrences, r.records) for r in repeated_ngrams(term_rows(df)).collect()}
        one = suffix_counts(term_rows(df).select("collection", "record", "pos", F.array("term").alias("suffix")), 1, 5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: (len(k[1]), n, len(records[k])) for k, n in occurrences.items() if n > 1}
    assert {(r.collection, tuple(r.ngram)): (r.occurrences, r.records) for r in one} == {k: (n, len(records[k])) for k, n in occurrences.items() if len(k[1]) == 1}
    blocks, deepest = deep_suffixes(term_rows(df.where("record = 'p'")), 8)
    assert deepest >= 38 and blocks.count() == 75 and repeated_ngrams(term_rows(df.limit(0))).count() == 0


def test_terms_and_marks(spark):
    values = [" É", "é", "ΟΔΟΣ", "", "  ", None, "a\t", "<UNKNOWN>"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", clean_term("v").alias("t"))
    assert [r.t for r in df.collect()] == ["é", "é", "οδος", None, None, None, "a\t", "<unknown>"]
    counts = spark.createDataFrame([("c", k) for k in (1, 2, 3, 10, 11, 100)], "collection string, records long")
    totals = spark.createDataFrame([("c", 100)], "collection string, total long")
    got = {r.records: r.verdict for r in mark_terms(counts, totals).collect()}
    assert got == {1: "rare", 2: "rare", 3: None, 10: None, 11: "common", 100: "common"}
    assert suffix_counts(spark.createDataFrame([], "collection string, record string, pos long, suffix array<string>")).count() == 0


def test_span_decoding():
    for text in ("véer", "doł msta", "чинару", "רבא ’x", "ρικατα", "Ångel", "日本"):
        data = text.encode()
        for encoding in ("cp1252", "mac_roman", "cp437", "cp850", "cp1250"):
            broken = "".join(bytes([b]).decode(encoding, "replace") if bytes([b]).decode(encoding, "replace") != "�" else chr(b) for b in data)
            assert decode_spans(broken, encoding) == text
    for plain in ("naïf", "MAÇÃ", "Âge", "©", "×", "ascii", "", "Ã©tonnant"[2:], "ре"):
        assert decode_spans(plain, "cp1252") == plain
    assert decode_spans("caÂ© Ã x", "cp1252") == "ca© Ã x"
    assert decode_spans("À\u0080 í \u0080", "cp1252") == "À\u0080 í \u0080"  # overlong, surrogate
    assert reread("lÍi", "mac_roman", "cp1252") == "lêi" and reread("ł", "mac_roman", "cp1252") is None
    assert ("véer" in {t for _, t in readings("vÃƒÂ©er")}) and not list(readings("abc"))
    deep = "véer"
    for _ in range(5):
        deep = "".join(bytes([b]).decode("cp1252", "replace").replace("\ufffd", chr(b)) for b in deep.encode())
    assert "véer" in {t for _, t in readings(deep)}  # damage of any depth
    assert oddness("vertÈre", {"è"}) == 1 and oddness("VERTÈRE", {"è"}) == 0


def test_restore(spark):
    words = ["véer", "plagéne", "lêi", "monç", "rivàe", "douû"]
    rows = []
    for i in range(40):
        rows += [(i, "fr", "words", k, w) for k, w in enumerate(words + ["Âge", "þorn", f"é{i}a"])]
    utf = lambda w: w.encode().decode("cp1252", "replace")
    mac = lambda w: w.encode("cp1252").decode("mac_roman")
    broken = [(100, "FR", "words", 0, utf("véer")), (100, "FR", "words", 1, "lêi"), (100, "FR", "words", 2, utf("þorn")), (100, "FR", "words", 3, utf("çàx")), (100, "FR", "source", -1, "x/" + utf("dé") + ".txt"),
              (101, "fr", "words", 0, mac("véer")), (101, "fr", "words", 1, mac("plagéne")), (101, "fr", "words", 2, "Âge"), (101, "fr", "words", 3, mac("çàrt")), (101, "fr", "words", 4, "monç"),
              (102, "fr", "words", 0, "v�er"), (102, "fr", "words", 1, None), (102, "fr", "words", 2, ""), (102, "fr", "words", 3, utf(utf("rivàe").replace("\xa0", "\xa0"))), (None, "fr", "words", 0, utf("véer")), (103, None, "words", 0, "ÿ" * 20000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows + broken], "id long, lang string, field string, pos int, value string, h int, restored string")
    got = {(r.id, r.field, r.pos): r.restored for r in restore(df, df).collect()}
    want = {(100, "words", 0): "véer", (100, "words", 2): "þorn", (100, "words", 3): "çàx", (100, "source", -1): "x/dé.txt", (101, "words", 0): "véer", (101, "words", 1): "plagéne", (101, "words", 3): "çàrt", (102, "words", 0): "", (102, "words", 3): "rivàe"}
    assert got == want
    spans = {(r.id, r.field, r.pos): r.restored for r in restore(df, df, spans_only=True).collect()}
    assert spans == {k: v for k, v in want.items() if k[0] != 101 and v}
    assert restore(df.limit(0), df).count() == 0
    assert unicodedata.normalize("NFC", got[100, "words", 0]) == "véer"
