import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm.spans import Level, compress, recompress, shared_span_words, windows
from folioscope.llm.splits import assign_splits, connected_components, plain_page, plain_quire


def brute(rows, n):
    seen, out = defaultdict(set), {}
    places = {}
    for kind, i, words in rows:
        for j in range(len(words or []) - n + 1):
            w = tuple(words[j : j + n])
            if None not in w:
                seen[kind or "", w].add(i)
                places.setdefault((kind or "", i), []).append((j, w))
    for (kind, i), at in places.items():
        covered = {p for j, w in at if len(seen[kind, w]) > 1 for p in range(j, j + n)}
        if covered:
            out[kind, i] = len(covered)
    return out


def found(spark, rows, n):
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "kind string, id long, words array<string>, at int, c0 string")
    return {(r.kind, r.id): r.shared_words for r in shared_span_words(df, n).collect()}


@pytest.mark.parametrize("n,alphabet", [(2, 3), (5, 3), (12, 2), (12, 1), (12, 30), (20, 4)])
def test_spans_against_brute_force(spark, n, alphabet):
    rng = random.Random(n * 100 + alphabet)
    passages = [[f"w{rng.randrange(alphabet)}" for _ in range(rng.randrange(n - 2, 3 * n))] for _ in range(4)]
    rows = []
    for i in range(40):
        words = []
        for _ in range(rng.randrange(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice([f"w{rng.randrange(alphabet)}", f"u{i}", None]) for _ in range(rng.randrange(1, 15))]
        rows.append((rng.choice(["a", "b"]), i, words))
    assert found(spark, rows, n) == brute(rows, n)


def test_span_edges(spark):
    long = [f"t{k}" for k in range(300_000)]
    rows = [("a", 1, list("abcdefghijkl")), ("a", 2, list("xabcdefghijkl")), ("b", 3, list("abcdefghijkl")), ("a", 4, None), ("a", 5, []), ("a", None, list("abcdefghijkl")),
            ("a", 6, list("mnopqrstuvwx") * 2), (None, 7, ["z"] * 40), (None, 8, ["z"] * 12), ("l", 9, long), ("l", 10, long[100_000:100_050])]
    assert found(spark, rows, 12) == {("a", 1): 12, ("a", 2): 12, ("", 7): 40, ("", 8): 12, ("l", 9): 50, ("l", 10): 50}
    assert found(spark, rows[3:5], 12) == {} and shared_span_words(spark.createDataFrame([], "kind string, id long, words array<string>"), 12).count() == 0
    with pytest.raises(ValueError):
        shared_span_words(spark.createDataFrame([], "kind string, id long, words array<string>"), 1)


def test_equal_windows_have_equal_cores():
    rng = np.random.default_rng(3)
    span = rng.integers(0, 5, 12)
    text = np.concatenate([rng.integers(0, 5, 40), span, rng.integers(0, 5, 40), span, rng.integers(0, 5, 40)]).astype(np.uint64)
    words, seg, place = [text, text + np.uint64(7)], np.zeros(len(text), int), np.arange(len(text))
    level, a, b = Level(words, place, place + 1, seg), place, place + 1
    for salt in (1, 2):
        level, a, b, made = compress(level, a, b, salt)
    w = windows(words, seg, level, a, b, 12)
    by = defaultdict(set)
    for at, core, name in zip(w["at"], w["c0"], w["w0"]):
        by[tuple(text[at : at + 12])].add((core, name))
    assert all(len(x) == 1 for x in by.values())
    assert len({next(iter(x))[1] for x in by.values()}) == len(by)


def test_rounds_shorten_and_names_are_global(spark):
    rng = random.Random(9)
    rows = [("k", i, [rng.choice("abc") for _ in range(200)]) for i in range(30)]
    words = {i: w for _, i, w in rows}
    meaning = {}
    for rounds in (1, 2, 3):
        state = recompress(spark.createDataFrame(rows, "kind string, id long, words array<string>"), rounds).collect()
        assert sum(len(r.s0) for r in state) < 0.9**rounds * 30 * 200
        for r in state:
            at = 0
            for name, n in zip(zip(r.s0, r.s1), r.len):
                assert meaning.setdefault((rounds, name), words[r.id][at : at + n]) == words[r.id][at : at + n]
                at += n
            assert at == 200


def components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a or b), find(b or a)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(150):03}", f"n{rng.randrange(150):03}") for _ in range(90)]
    edges += [(f"p{k:02}", f"p{k + 1:02}") for k in range(40)] + [("hub", f"h{k}") for k in range(200)] + [("alone", None), (None, "other"), ("hub", "h1"), ("self", "self")]
    df = spark.createDataFrame([(*e, "x") for e in [*edges, (None, None)]], "a string, b string, v string")
    assert {r.node: r.component for r in connected_components(df).collect()} == components(edges)
    assert connected_components(df.limit(0)).count() == 0


def test_plain_notations(spark):
    quires = {" A01 ": "A1", "quire C7": "C7", "$Q=e020": "E20", "B-102": "B102", "a1": "A1", "?": None, "unknown": None, "@": None, "": None, None: None, " ? ": None, "A0": "A0"}
    pages = {"F0012R": "f12r", "<f9v>": "f9v", "fol. 0103r": "f103r", " f7v ": "f7v", "f85r2": "f85r2", "Cover ": "cover", " ": None, None: None}
    df = spark.createDataFrame([(q,) for q in quires], "q string").select("q", plain_quire(F.col("q")).alias("p"))
    assert {r.q: r.p for r in df.collect()} == quires
    df = spark.createDataFrame([(q,) for q in pages], "q string").select("q", plain_page(F.col("q")).alias("p"))
    assert {r.q: r.p for r in df.collect()} == pages


def test_splits(spark):
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    rows = [(f"c{k}", 1.0 + k % 7, "x") for k in range(4000)] + [("huge", 5000.0, "x"), ("huge", 1000.0, "y"), (None, 9.0, "x"), ("none", None, "x")]
    df = spark.createDataFrame(rows, "component string, weight double, split string")
    got = {r.component: (r.split, r.weight) for r in assign_splits(df, shares).collect()}
    assert len(got) == 4002 and got["huge"] == ("train", 6000.0) and got["none"][1] == 0
    total = Counter()
    for split, weight in got.values():
        total[split] += weight
    whole = sum(total.values())
    assert all(abs(total[k] / whole - v) < 0.02 for k, v in shares.items())
    assert {r.component: r.split for r in assign_splits(df.repartition(7), shares).collect()} == {k: v[0] for k, v in got.items()}
    plain = {r.component: r.split for r in assign_splits(df, shares, seeds=1).collect()}
    assert len(plain) == 4002 and sum(plain[k] == got[k][0] for k in plain) < 4002
    assert assign_splits(df.limit(0), shares).count() == 0
    with pytest.raises(ValueError):
        assign_splits(df, {"train": 0.5})
