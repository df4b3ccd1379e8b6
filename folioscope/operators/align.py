"""Edit distances and alignments of sequences, and transfer of line boundaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def distance_matrix(a: Sequence, b: Sequence) -> np.ndarray:
    m = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    m[0] = np.arange(len(b) + 1)
    other = np.array(list(b), dtype=object)
    steps = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        best = np.minimum(m[i - 1, :-1] + (other != x), m[i - 1, 1:] + 1) if len(b) else np.zeros(0, np.int32)
        row = np.concatenate([[i], best])
        m[i] = np.minimum.accumulate(row - steps) + steps  # insertions from the left
    return m


def alignment(a: Sequence, b: Sequence) -> tuple[int, list[int]]:
    """(distance, target prefix length for each source prefix); diagonal before deletion before insertion on ties."""
    m = distance_matrix(a, b)
    i, j = len(a), len(b)
    ends = [0] * (len(a) + 1)
    ends[i] = j
    while i or j:
        if i and j and m[i, j] == m[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
        elif i and m[i, j] == m[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
            continue
        ends[i] = j
    return int(m[-1, -1]), ends


def _align(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    made = [alignment(x or "", y or "") for x, y in zip(a, b)]
    return pd.DataFrame({"distance": [m[0] for m in made], "ends": [m[1] for m in made]})


align_udf = F.pandas_udf(_align, T.StructType([T.StructField("distance", T.IntegerType()), T.StructField("ends", T.ArrayType(T.IntegerType()))]))


def transfer_lines(lines: Sequence[str], truth: str) -> tuple[list[str], float]:
    """The truth cut where the lines end, and the character error rate of the lines against it."""
    joined = " ".join(lines)
    cost, ends = alignment(joined, truth)
    out, at, before = [], 0, 0
    for line in lines:
        at += len(line)
        out.append(truth[before : ends[at]].strip())
        before = ends[at]
        at += 1
    return out, cost / max(1, len(truth))
