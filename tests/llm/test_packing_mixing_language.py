import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioscope.llm.language import fit, label_segments, language_code, words_of
from folioscope.llm.mixing import mix, sainte_lague
from folioscope.llm.packing import best_fit, pack
from folioscope.llm.tokens import token_sizes

TEXT = {"en": "The root drawing shows a different hand near the upper edge and keeps the short suffix for the second time", "de": "Die Wurzelzeichnung zeigt eine andere Hand am oberen Rand und behält die kurze Nachsilbe zum zweiten Mal", "la": "Figura radicis aliam manum ostendit iuxta marginem superiorem et syllabam brevem servat iterum atque iterum"}


def test_best_fit_prefers_the_tightest_bin():
    assert best_fit([6, 5, 4, 3, 2], 10) == [[0, 2], [1, 3, 4]]
    assert best_fit([], 10) == [] and best_fit([10, 10], 10) == [[0], [1]]


@pytest.mark.parametrize("group", [50, 20_000])
def test_packing(spark, group):
    rng = random.Random(1)
    rows = [(k, rng.choice([rng.randrange(1, 90), 100, 250, 0, None])) for k in range(1200)] + [(None, 5), (5000, -3), (6000, 1_000_000)]
    items = spark.createDataFrame([(*r, "x") for r in rows], "id long, size long, container string")
    kinds = spark.createDataFrame([("a", 100), ("b", 256)], "container_kind string, capacity_tokens int")
    got = pack(items, kinds, group).collect()
    whole = {i: s for i, s in rows if i is not None and s and s > 0}
    for kind, capacity in (("a", 100), ("b", 256)):
        bins, seen = defaultdict(list), Counter()
        for r in got:
            if r.container_kind == kind:
                bins[r.container].append(r)
                seen[r.item] += r.size
        assert seen == Counter(whole)
        for members in bins.values():
            members.sort(key=lambda r: r.place)
            assert [r.place for r in members] == list(range(len(members))) and sum(r.size for r in members) <= capacity
            assert all(r.start == sum(x.size for x in members[: r.place]) for r in members)
        pieces = Counter(r.item for r in got if r.container_kind == kind)
        assert all(n == -(-whole[i] // capacity) for i, n in pieces.items())
        assert len(bins) <= 1.02 * sum(whole.values()) / capacity + 1 + (group == 50) * 0.03 * len(bins)
    assert {tuple(r) for r in pack(items.repartition(9), kinds, group).collect()} == {tuple(r) for r in got}


def test_packing_edges(spark):
    items = spark.createDataFrame([], "id long, size long")
    kinds = spark.createDataFrame([("a", 100)], "container_kind string, capacity_tokens int")
    assert pack(items, kinds).count() == 0 and pack(items, kinds.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack(items, spark.createDataFrame([("a", 0)], kinds.schema))


def test_sainte_lague_against_the_plain_rule():
    rng = random.Random(2)
    for _ in range(60):
        w = [rng.choice([0.0, rng.random()]) for _ in range(rng.randrange(1, 9))]
        caps = [rng.randrange(0, 300) for _ in w]
        seats = rng.randrange(0, 600)
        given = [0] * len(w)
        for _ in range(seats):
            open_ = [i for i in range(len(w)) if w[i] > 0 and given[i] < caps[i]]
            if not open_:
                break
            given[max(open_, key=lambda i: (w[i] / (2 * given[i] + 1), -i))] += 1
        assert sainte_lague(w, seats, caps) == given
    assert sainte_lague([1.0, 1.0], 10**12) == [5 * 10**11] * 2


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(k, s, rng.randrange(1, 60)) for k, s in enumerate(["big"] * 3000 + ["mid"] * 400 + ["small"] * 60)] + [(9000, None, 5), (9001, "other", 5), (None, "big", 5), (9002, "big", 0), (9003, "big", None)]
    records = spark.createDataFrame([(*r, 1) for r in rows], "id long, source string, tokens long, repeats int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 4), ("small", 0.1, 8), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    chosen, report = mix(records, targets, shard_rows=500)
    got, shares = chosen.collect(), {r.source: r for r in report.collect()}
    size = {r[0]: r[2] for r in rows}
    cap = {"big": 1, "mid": 4, "small": 8}
    assert all(0 < r.repeats <= cap[r.source] and r.tokens == size[r.id] for r in got) and len({r.id for r in got}) == len(got)
    for s, share in (("big", 5 / 9), ("mid", 3 / 9), ("small", 1 / 9), ("absent", 0)):
        assert abs(shares[s].reached_share - share) < 0.01
        assert shares[s].reached == sum(r.tokens * r.repeats for r in got if r.source == s)
    many, _ = mix(records, targets, shard_rows=10, bundle=7)  # 300 shards in 43 bundles
    reached = Counter()
    for r in many.collect():
        reached[r.source] += r.tokens * r.repeats
        assert 0 < r.repeats <= cap[r.source]
    assert all(abs(reached[s] / sum(reached.values()) - share) < 0.05 for s, share in (("big", 5 / 9), ("mid", 3 / 9), ("small", 1 / 9)))
    _, report = mix(records, targets, total_tokens=60_000)
    shares = {r.source: r for r in report.collect()}
    assert shares["small"].reached <= 8 * shares["small"].available and 55_000 < sum(r.reached for r in shares.values()) <= 60_000
    assert mix(records.limit(0), targets)[0].count() == 0 and mix(records, targets.limit(0))[0].count() == 0
    with pytest.raises(ValueError):
        mix(records, targets.union(targets))


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "hello world", "a"), (2, None, "b"), (3, "", "c"), (None, "x", "d"), (4, "<|endoftext|>", "e")], "id long, t string, tokens2 string")
    got = {r.id: r.tokens for r in token_sizes(df, "id", "t").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and None not in got


def test_language_labels(spark):
    reference = spark.createDataFrame([(k, v) for k, v in TEXT.items()] + [(None, "x"), ("en", None)], "lang string, sample_text string")
    model = fit(reference)
    mixed = f"{TEXT['en']}. {TEXT['de']} (mutatis mutandis)! <f4r.1> ol.chedy.dar\n{TEXT['de']} [3/44]."
    rows = [(1, TEXT["en"]), (2, TEXT["de"].upper()), (3, mixed), (4, None), (5, ""), (6, "   "), (7, "<p>f93r; 617; 0.347</p>"), (8, "The root"), (9, (TEXT["la"] + ". ") * 5000), (10, f"{TEXT['en']}. Die andere Hand. {TEXT['en']}."), (None, TEXT["en"]), (11, f"{TEXT['en']} {TEXT['de']}"), (12, f"<a title='{TEXT['de']}'>{TEXT['en']}</a>")]
    got = defaultdict(list)
    for r in label_segments(spark.createDataFrame([(*r, "zz") for r in rows], "doc_id long, text string, lang string"), model).orderBy("seg_no").collect():
        assert 0 < r.confidence <= 1
        got[r.doc_id].append((r.seg_no, r.lang))
    assert got == {1: [(0, "en")], 2: [(0, "de")], 3: [(1, "en"), (2, "de")], 8: [(0, "en")], 9: [(0, "la")], 10: [(0, "en")], 11: [(1, "en"), (2, "de")], 12: [(0, "en")]}
    assert label_segments(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    words, text, piece = words_of(["A b. C1 d (e f) g – h.", "", "<p class='" + "x " * 60 + "'>É [" + "1/2 " * 30 + "] z"])
    assert words == ["a", "b", "d", "g", "e", "z"] and text.tolist() == [0, 0, 0, 0, 2, 2] and piece.tolist() == [0, 0, 1, 1, 2, 2]
    labels = {"en-GB": "en", " EN": "en", "español": "es", "fr_FR": "fr", "ger ": "de", "iw": "he", "und": None, "xx": None, "": None, "?": None, None: None, "Latin": "la", "nl-BE": "nl"}
    df = spark.createDataFrame([(k,) for k in labels], "l string").select("l", language_code(F.col("l")).alias("c"))
    assert {r.l: r.c for r in df.collect()} == labels


def test_language_held_out_accuracy(spark):
    """On the test table most labels are right: the model must agree with nearly all plain ones."""
    d = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{d}/documents.parquet")
    model = fit(spark.read.parquet(f"{d}/lang_reference.parquet"), documents, 300)
    one = label_segments(documents, model).where("seg_no = 0").withColumnRenamed("lang", "found").join(documents, "doc_id").where("lang in ('en','fr','de','es','it','nl','la','he')")
    right, n = one.agg(F.count_if(F.col("found") == F.col("lang")), F.count("*")).first()
    assert right / n > 0.93
