import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import align, experts, keys, resample
from folioscope.sources import markup
from folioscope.sources.transcription import certain, read_transcription, tokens


def test_transcription_file(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("#=HEAD\n<f1r> <! $Q=A $I=H $L=A $H=@ $I=S>\n<f1r.1,@P0;H> <%><@H=1>daiin<->chol<$>\n\n<f1r.2,@Lf> pla/\n/nt.a?b\n<f1r.3,+P0> <@H=@>x\n<f1v> <! $Q=B>\n<f1v.1,@P0> chol\n")
    rows = {r.locus_id: r for r in read_transcription(spark, str(path)).collect()}
    assert rows["f1r.1"].metadata == {"Q": "A", "I": "S", "L": "A", "H": "1"} and rows["f1r.1"].tokens == ["daiin", "chol"] and rows["f1r.1"].transcriber == "H"
    assert (rows["f1r.1"].locator, rows["f1r.1"].locus_type, rows["f1r.1"].paragraph_start, rows["f1r.1"].paragraph_end) == ("@", "P0", True, True)
    assert rows["f1r.2"].tokens == ["plant", "a?b"] and rows["f1r.2"].certain_tokens == ["plant"] and rows["f1r.2"].metadata["H"] == "1" and rows["f1r.2"].transcriber is None
    assert "H" not in rows["f1r.3"].metadata and rows["f1v.1"].metadata == {"Q": "B"}
    for bad in ("<f1r> <! $Q=A>\nnonsense", "<f1r.1,@P0> x", "<f1r> <! >\n<f2r.1,@P0> x", "<f1r> <! >\n<f1r.1,P> x", "<f1r> <! >\n<f1r.1,@P0> x/"):
        path.write_text(bad + "\n")
        with pytest.raises(Exception, match="at file"):
            read_transcription(spark, str(path)).collect()


def test_tokens(spark):
    df = spark.createDataFrame([("<%>daiin.chol,shol<->qokaiin<~>chedy<$>",), ("[d:t]aiin.qo?ey.{ch}ol",), ("a-b.@123;c",), (None,)], "r string")
    got = [(r.t, r.c) for r in df.select(tokens(F.col("r")).alias("t"), certain(tokens(F.col("r"))).alias("c")).collect()]
    assert got[0] == (["daiin", "chol", "shol", "qokaiin", "chedy"],) * 2 and got[1] == (["daiin", "qo?ey", "chol"], ["daiin", "chol"]) and got[3] == (None, None)


def test_markup(spark, tmp_path):
    path = tmp_path / "o.xml"
    path.write_text('<d><OBJECT><PARAM name="PAGE" value="sample_0150.djvu"/><LINE><WORD x-confidence="90">שלום</WORD><WORD x-confidence="20">רע</WORD></LINE></OBJECT></d>', "utf-8")
    sections = spark.createDataFrame([("I", 0, 99), ("II", 100, 199), ("late", 150, 160)], "section string, first int, last int")
    assert [tuple(r) for r in markup.ocr_words(spark, str(path), sections).collect()] == [(150, "II", "שלומ")]
    page = '<P><TextLine id="{}"><Coords points="1,{} 5,9"/><TextEquiv><Unicode>{}</Unicode></TextEquiv></TextLine></P>'
    files = spark.createDataFrame([("a", page.format("x", 7, "old")), ("b", page.format("x", 3, "new")), ("a2", page.format("y", 1, "top"))], "name string, content string")
    assert [tuple(r) for r in markup.page_lines(files).orderBy("y", "text").collect()] == [("y", 1.0, "top"), ("x", 3.0, "new")]
    paragraphs = spark.createDataFrame([(pos, words, "d") for pos, words in [(1, ["A", "b"]), (2, list("wxyz")), (3, list("uvwt")), (4, ["C"]), (5, list("1234")), (6, ["end"]), (7, ["f3v"]), (8, list("lost")), (9, ["Red", "Root", "is", "a", "plant"])]], "pos int, words array<string>, doc string")
    got = [(r.heading, r.words) for r in markup.entries(paragraphs, ["is", "has"]).orderBy("entry").collect()]
    assert got == [("A b", list("wxyzuvwt")), ("C", list("1234")), ("Red Root", ["is", "a", "plant"])]
    kept = markup.training_subset(page.format("x", 7, "old").replace("</P>", "") + page.format("y", 1, "top")[3:], {"y": "new"})
    assert "new" in kept and "old" not in kept and 'conf="1.0"' in kept


def test_alignment():
    assert align.alignment("abc", "axbc") == (1, [0, 2, 3, 4])
    assert align.transfer_lines(["the root", "drawing"], "the root drawing") == (["the root", "drawing"], 0.0)
    rng = random.Random(1)
    for _ in range(30):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(0, 9))) for _ in range(2))
        cost, ends = align.alignment(a, b)
        m = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                m[i][j] = min(m[i - 1][j - 1] + (a[i - 1] != b[j - 1]), m[i - 1][j] + 1, m[i][j - 1] + 1)
        assert cost == m[-1][-1] and ends == sorted(ends) and ends[0] <= ends[-1] == len(b)


def test_keys(spark):
    df = spark.createDataFrame([(list("aba"), list("xyz")), (list("abc"), list("xxy")), (list("aba"), list("xyx"))], "c array<string>, p array<string>")
    got = [r.m for r in df.select(keys.pair_mapping(F.col("c"), F.col("p")).alias("m")).collect()]
    assert got[0] is None and got[1] is None and [tuple(x) for x in got[2]] == [("a", "x"), ("b", "y")]
    counts = spark.createDataFrame([(list("abca"), list("xyzx")), (list("aabc"), list("xyzw")), (list("ab"), list("xyz"))], df.schema)
    assert [r.k for r in counts.select(keys.anagram_key_count(F.col("c"), F.col("p")).alias("k")).collect()] == [2, 0, 0]
    options = {"p1": [(("a", "x"), ("b", "y"))], "p2": [(("a", "x"), ("c", "z")), (("a", "q"),)], "p3": [(("b", "x"),)]}
    assert keys.fit_keys(options) == (2, [(("a", "q"), ("b", "x")), (("a", "x"), ("b", "y"), ("c", "z"))], False)
    rows = [(7, page, [{"c": c, "p": p} for c, p in m]) for page, ms in options.items() for m in ms]
    assert [tuple(r) for r in keys.fit_runs(spark.createDataFrame(rows, "run int, page string, mapping array<struct<c:string,p:string>>"), "run").collect()] == [(7, 2, 2, False)]
    labels = spark.createDataFrame([("f1", "f1.1", list("aba")), ("f1", "f1.2", list("cdc"))], "page string, locus_id string, units array<string>")
    forms = spark.createDataFrame([("t", "xyx")], "target string, form string")
    assert keys.constraints(labels, forms).count() == 2
    words = ["xyx", "yxz", "xzy"] * 4
    plain = {}
    for w in words:
        for a, b in zip(w, w[1:]):
            plain[a, b] = plain.get((a, b), 0) + 1
    log_p = {k: np.log2(n / sum(plain.values())) for k, n in plain.items()}
    objective = keys.Objective(plain, log_p)
    wrong = {"x": "y", "y": "x", "z": "z"}
    assert objective.score(keys.polish(objective, wrong)) >= objective.score(wrong)
    runs = keys.search(spark.createDataFrame([(1, 5), (2, 6)], "run int, seed int"), objective, wrong, 200).collect()
    for r in runs:
        key = {x.c: x.p for x in r.key}
        assert r.score >= objective.score(wrong) and r.score == pytest.approx(objective.score(key))
        assert all(objective.gain(key, a, b) <= 1e-9 for a in key for b in key if a < b)
    assert len(set(keys.reduce_alphabet([list("aabbcd")]).values())) == 3


def test_experts(spark):
    units = ["a", "b"]
    import itertools

    mass = sum(experts.edit_probability(["a"], list(t), 0.1, 0.2, 0.8, 2) for n in range(4) for t in itertools.product(units, repeat=n))
    assert mass == pytest.approx(1)
    w = experts.mixture_weights(np.array([[0.2, 0.8]] * 20))
    assert w[1] > 0.999
    fitted = experts.fit_copy_weights(spark.createDataFrame([("g", 10, 0.01, 0.5), ("h", 5, 0.5, 0.01)], "t string, n long, base double, edit double"), ["t"]).collect()
    assert {r.t: r.weight > 0.5 for r in fitted} == {"g": True, "h": False}
    df = spark.createDataFrame([("g", 0.2, 0.8)] * 20 + [("h", 0.8, 0.2)] * 5, "t string, a double, b double")
    fitted = experts.fit_mixture(df, ["a", "b"], ["t"], 60)
    assert fitted[("g",)]["b"] > 0.999 and fitted[("h",)]["a"] > 0.999
    train = spark.createDataFrame([("m", "c", "aa")] * 6 + [("m", "c", "bb")] * 3 + [("m", "c", text.UNKNOWN)], "morph string, cond string, cat string")
    cand = spark.createDataFrame([("m", "c", k, k, p) for k, p in (("aa", 0.6), ("bb", 0.3), (text.UNKNOWN, 0.1))], "morph string, cond string, cand string, cat string, p0 double")
    out = {r.cand: r.p for r in experts.reweight(cand, ["morph", "cond"], ["morph", "cond"], ["morph"], train, "cat").collect()}
    assert sum(out.values()) == pytest.approx(1) and abs(out["aa"] - 0.6) < 0.02
    import pandas as pd

    v = pd.DataFrame([("a", "f", 1.0), ("b", "f", 1.0), ("c", "g", 1.0)], columns=["word", "feature", "value"])
    assert experts.spherical_classes(v, {"a": 3, "b": 2, "c": 1, "d": 1}, 2) == {"a": 0, "b": 0, "c": 1, "d": 0}


def test_copy_weights_make_their_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    rows = spark.createDataFrame([("g", 10, 0.01, 0.5), ("g", 4, 0.01, 0.5), ("g", 1, 0.5, 0.01), ("h", 5, 0.5, 0.01)], "t string, n long, base double, edit double")
    fitted = {r.t: (r.weight, r.log_likelihood) for r in experts.fit_copy_weights(rows.mapInPandas(count, rows.schema), ["t"]).collect()}
    assert made.value == 4
    w = 0.25
    for _ in range(30):
        w = min(max((14 * w * 0.5 / (w * 0.5 + (1 - w) * 0.01) + w * 0.01 / (w * 0.01 + (1 - w) * 0.5)) / 15, 0.001), 0.999)
    assert fitted["g"][0] == pytest.approx(w, abs=1e-6) and fitted["h"][0] == pytest.approx(0.001, abs=1e-3)


def test_resampling_helpers():
    assert resample.equal_windows(25, 5, 4) == [0, 7, 13, 20] and resample.equal_windows(4, 5, 4) == [] and resample.equal_windows(10, 4, 1) == [3]
    assert resample.balanced_folds({"a": 5, "b": 4, "c": 3, "d": 3}, 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    with pytest.raises(ValueError):
        resample.balanced_folds({"a": 1}, 2)


def test_samples_order_few_rows(spark, monkeypatch):
    """The first words of the whole md5 order, while only a small part of the rows is ever ordered; a bound that is too low is raised."""
    import hashlib

    from folioscope.operators import shape

    rows = [("a" if k % 4 else None, k, f"w{k}") for k in range(4000)] + [("few", k, "x") for k in range(9)]
    words = spark.createDataFrame(rows, "g string, k int, word string")
    ordered = []
    whole = shape.ranked_rows

    def counted(df, *args):
        ordered.append(df.count())
        return whole(df, *args)

    monkeypatch.setattr(shape, "ranked_rows", counted)
    key = lambda t, g, k: hashlib.md5("|".join(["7", str(t), *([g] if g else []), str(k)]).encode()).hexdigest()
    expected = sorted((t, g or "", k) for t in (1, 2, 3) for g in ("a", None) for _, k in sorted((key(t, g, k), k) for h, k, _ in rows if h == g)[:10])
    got = lambda: sorted((r.trial, r.g or "", r.k) for r in shape.sample_words(words, ["g"], 10, 3, 7, ["k"]).collect())
    assert got() == expected and ordered[0] < 1500
    first = shape._pruning
    monkeypatch.setattr(shape, "_pruning", lambda n, size, widen: first(n * 64, size, widen))
    assert got() == expected


def test_both_sides_order_few_rows(spark, monkeypatch):
    """Neither side of the resampling orders its words once a trial."""
    from folioscope.operators import shape
    from folioscope.plans import bounds
    from folioscope.plans.common import corpora, token_facts

    sf, ordered, whole = "/root/testdata/sf0.01", [], shape.ranked_rows
    monkeypatch.setattr(shape, "ranked_rows", lambda df, *args: ordered.append(df.count()) or whole(df, *args))
    bounds.resample_groups(spark, sf)
    words = [token_facts(spark, sf).count(), corpora(spark, sf).selectExpr("sum(size(words)) n").first().n]
    assert [x < 0.7 * bounds._T * n for x, n in zip(ordered, words)] == [True, True], (ordered, words)
