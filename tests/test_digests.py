"""First words of md5 in NumPy against hashlib, and what uses them."""

import random
from hashlib import md5

import pyarrow as pa

from folioscope.operators import digests, shape


def test_first_words_of_any_length(monkeypatch):
    monkeypatch.setattr(digests, "CHUNK", 50)
    rng = random.Random(4)
    texts = ["", "é|ü", *["x" * rng.choice([0, 1, 3, 20, *range(44, 64), 120]) + str(rng.randint(0, 10**6)) for _ in range(400)]]
    prefixes = ["408|1|", "408|19|", "408|20|", "", "a" * 54, "a" * 60]
    for array in (pa.array(texts), pa.array(["cut", *texts])[1:], pa.array([], pa.string()), pa.array(["y" * 80])):
        got = {(k, at + j): x for k, at, words in digests.first_words(array, prefixes) for j, x in enumerate(words.tolist())}
        assert got == {(k, j): int.from_bytes(md5((p + x).encode()).digest()[:4], "big") for k, p in enumerate(prefixes) for j, x in enumerate(array.to_pylist())}


def test_samples_hash_no_row_a_trial_in_the_plan(spark, monkeypatch):
    """A word is one row for all trials of a sample, and no digest is made as a string of its own for each."""
    plans, whole = [], shape.cut_lineage
    monkeypatch.setattr(shape, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or whole(df))
    words = spark.createDataFrame([("a", k, f"w{k}") for k in range(3000)], "g string, k int, word string")
    assert shape.sample_words(words, ["g"], 10, 3, 7, ["k"]).count() == 30
    assert plans and not any("md5" in p or "Generate" in p for p in plans)
