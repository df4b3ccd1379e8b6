"""The structure operator against counts by hand."""

import random
from collections import Counter
from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest

from folioscope.operators import structure


def distance(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        row, before = [row[0] + 1], row
        for k, y in enumerate(b):
            row.append(min(row[-1] + 1, before[k + 1] + 1, before[k] + (x != y)))
    return row[-1]


def test_one_edit():
    rng = random.Random(2)
    words = ["".join(rng.choice("aבc") for _ in range(rng.randint(0, 5))) for _ in range(120)]
    for a in words:
        for b in words:
            assert structure.one_edit(a, b) == (distance(a, b) == 1)


@pytest.mark.parametrize(("task_words", "part_words"), [(10**6, 10**6), (150, 40)])
def test_lines_are_counted_once_for_all_metrics(spark, monkeypatch, task_words, part_words):
    """All shuffles come from one pass over the lines, whole or dealt to tasks by first word."""
    monkeypatch.setattr(structure, "TASK_WORDS", task_words)
    monkeypatch.setattr(structure, "PART_WORDS", part_words)
    rng, read = random.Random(3), spark.sparkContext.accumulator(0)
    lines = [(k, 0, [rng.choice(["ab", "abc", "b", "ba", "bab", "cd", "é"]) for _ in range(rng.randint(1, 9))]) for k in range(80)]

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(lines, "seq_id long, ln int, ws array<string>")
    total = sum(len(ws) for *_, ws in lines)
    every = structure.counts(df.mapInArrow(count, df.schema), ["seq_id", "ln"], ["ab", "b"], 2, 408, -(-total // task_words))
    got = {(r.perm, r.kind, r.x, r.y): r.n for r in every.collect()}
    assert read.value == len(lines)
    for p in range(3):
        order = lambda k, ws: ws if p == 0 else [w for *_, w in sorted((md5(f"408|{p}|{k}|0|{i}".encode()).hexdigest(), i, w) for i, w in enumerate(ws))]
        made = [order(k, ws) for k, _, ws in lines]
        pairs = Counter(x for ws in made for x in zip(ws, ws[1:]))
        assert got[p, structure.PAIRS, 0, 0] == pairs.total()
        assert got[p, structure.EXACT, 0, 0] == sum(n for (a, b), n in pairs.items() if a == b)
        assert got[p, structure.EDIT, 0, 0] == sum(n for (a, b), n in pairs.items() if distance(a, b) == 1)
        number = {"ab": 0, "b": 1}
        beside, at = Counter(), Counter()
        for (a, b), n in pairs.items():
            beside[number.get(a, 2), number.get(b, 2)] += n
        for ws in made:
            for i, w in enumerate(ws):
                at[number.get(w, 2), 0 if len(ws) == 1 else 1 if i == 0 else 2 if i == len(ws) - 1 else 3] += 1
        assert {(x, y): n for (q, kind, x, y), n in got.items() if q == p and kind == structure.ADJACENT} == beside
        assert {(x, y): n for (q, kind, x, y), n in got.items() if q == p and kind == structure.POSITION} == at
        for k in structure.ORDERS:
            runs = Counter(tuple(ws[i : i + k]) for ws in made for i in range(len(ws) - k + 1))
            assert got[p, structure.RUNS, k, k] == runs.total()
            assert got[p, structure.REPEATED, k, k] == sum(n for n in runs.values() if n > 1)


def test_structure_null_reads_counts_only(spark):
    """What is left after the pass over the lines are small sums: no words, shuffles or n-grams in the plan."""
    from folioscope.plans import coding

    df = coding.structure_null(spark, "/root/testdata/sf0.001")
    assert df.count() == coding.P + 1
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "md5" not in plan and "levenshtein" not in plan


@pytest.mark.parametrize("width", [40, 70_000, 300_000])
@pytest.mark.parametrize("most", [256, 2])
def test_runs_of_many_words_are_exact(monkeypatch, width, most):
    """Runs are counted as numbers, also where four words don't fit into 64 bits, or the parts that this takes would be too many."""
    monkeypatch.setattr(structure, "MOST_PARTS", most)
    monkeypatch.setattr(structure, "PART_WORDS", 250_000)
    rng = np.random.default_rng(width)
    codes = np.concatenate([np.arange(width), np.arange(width), rng.integers(0, 9, 3000), rng.integers(0, width, 3000)]).astype(np.int32)
    codes[:50] = np.arange(50)
    codes[width + 5] = 7
    sizes = rng.integers(1, 8, len(codes))
    sizes = sizes[: np.searchsorted(np.cumsum(sizes), len(codes))]
    sizes = np.append(sizes, len(codes) - sizes.sum())
    left = np.minimum(np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes)), 4).astype(np.int8)
    got = structure.run_counts(codes, left, width)
    for k, order in enumerate(structure.ORDERS):
        found = Counter(tuple(codes[i : i + order].tolist()) for i in np.flatnonzero(left >= order))
        assert got[:, k].tolist() == [sum(n for n in found.values() if n > 1), found.total()]


def test_lines_that_first_words_leave_equal_are_ordered_by_digests(monkeypatch):
    """Equal first words fall back on the whole digest; long lines don't need room beside the line's number."""
    keys, sizes = pa.array(["1|0", "2|0", "2|1"]), np.array([4, 1, 6])
    expected = [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10], *[[at + i for k, n, at in (("1|0", 4, 0), ("2|0", 1, 4), ("2|1", 6, 5)) for i in sorted(range(n), key=lambda i: md5(f"408|{p}|{k}|{i}".encode()).digest())] for p in (1, 2)]]
    assert [o.tolist() for o in structure.orders(keys, sizes, 408, 2)] == expected
    first = structure.digests.first_words
    monkeypatch.setattr(structure.digests, "first_words", lambda *args: ((k, at, words & 0x80000000) for k, at, words in first(*args)))
    assert [o.tolist() for o in structure.orders(keys, sizes, 408, 2)] == expected


def test_structure_reads_lines_once(spark):
    """Neither the frequent words nor the total take a pass over the lines of their own, and words aren't rows on the way."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    lines = [(k % 3, k, ["a", "b", "c", "a"][k % 2 :]) for k in range(30)] + [(0, -1, [])]
    df = spark.createDataFrame(lines, "seq_id long, ln int, ws array<string>")
    assert structure.structure_metrics(df.mapInArrow(count, df.schema), ["seq_id", "ln"], 2, 2, 408).count() == 3
    assert read.value == len(lines)
    words = structure.word_counts(structure.packed(df, ["seq_id", "ln"]), df.select("seq_id", "ln").schema)
    assert sorted((r.word, r.n, *r.first) for r in words.collect()) == [("a", 45, 0, 0, 0), ("b", 30, 0, 0, 1), ("c", 30, 0, 0, 2)]
