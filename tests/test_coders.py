"""The online coder against its definition."""

import math
import random
from collections import Counter

import pytest

from folioscope.operators import coders


def by_definition(s, max_order, c):
    v, sums, counts = len(set(s)), [0.0] * (max_order + 1), Counter()
    for at, x in enumerate(s):
        p = (counts["", x] + 0.5) / (at + 0.5 * v)
        sums[0] += math.log2(p)
        counts["", x] += 1
        for k in range(1, max_order + 1):
            if at >= k:
                ctx = tuple(s[at - k : at])
                p = (counts[ctx, x] + c * p) / (counts[ctx] + c)
                counts[ctx, x] += 1
                counts[ctx] += 1
            sums[k] += math.log2(p)
    return v, -max(sums) - math.log2(sum(2.0 ** (x - max(sums)) for x in sums) / (max_order + 1))


def test_online_coder(spark, monkeypatch):
    monkeypatch.setattr(coders, "PLACES", 300)
    rng = random.Random(1)
    streams = {k: [rng.choice("abcde"[: 1 + k % 5]) for _ in range(n)] for k, n in enumerate([1, 2, 3, 4, 50, 200, 0, 1, 700, 90])}
    df = spark.createDataFrame([*streams.items(), (99, None)], "id int, s array<string>").coalesce(1)
    out = coders.prequential(df, "s", ["id"], 3)
    got = {r.id: r for r in out.collect()}
    assert set(got) == {k for k, s in streams.items() if s}
    for k, r in got.items():
        v, bits = by_definition(streams[k], 3, 2.0)
        assert (r.units, r.alphabet) == (len(streams[k]), v) and r.bits == pytest.approx(bits, abs=1e-9) and sum(r.weights) == pytest.approx(1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Window" not in plan
