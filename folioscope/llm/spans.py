"""Long exact spans shared between records, by recompression.

Every record is a row of symbols, at first its words. A round names each maximal run of one symbol and then each pair of
neighbours whose left one is of the left and whose right one is of the right class of that round; both depend on the
symbols alone, so equal substrings get equal interior symbols in every record. A name is a hash of its definition, in two
64-bit lanes, and so is the same everywhere without a join. Each round is a Spark job over the rows of the last one that
also collects the definitions it used: a second, combinable aggregation checks, by a third hash, that each name has one definition
in the whole table (else the round is done again with other names). By induction equal symbols are equal words.

Near the ends of a window a symbol may reach outside. Which ones, follows from the window's own symbols: the first and
last run of each round, then a first symbol of the right and a last one of the left class. They are popped, and
what is left is the window's *core* of high-level symbols. A window is named by its popped words and its core, which two windows
have in common exactly if they hold the same words.

1. reveal: names of cores that stand in two records (``min(id) < max(id)``), one row a core and record;
2. verify: the windows with such a core, by their whole name;
3. grow: the places of shared windows are united per record.

No pairs of records are made. A core or window common to a third of all rows is met by partial aggregation and by
semi-joins to unique keys, which are broadcast only where their written size is below Spark's threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut_lineage, discard

_U = np.uint64
# Odd multipliers of the two hash lanes.
_MUL = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))
_ADD = (_U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9))
CHUNK_TOKENS = 1 << 18
LANES = (0, 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pair_name(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    return _mix(_mix(a * _MUL[lane] + _ADD[lane]) + b * _U(0xA24BAED4963EE407))


class Level:
    """Symbols of one round: names in two lanes, first word and word after the last, and the segment they belong to."""

    def __init__(self, names: list[np.ndarray], start: np.ndarray, end: np.ndarray, seg: np.ndarray):
        self.names, self.start, self.end, self.seg = names, start, end, seg

    def runs(self, salt: int) -> tuple[Level, np.ndarray]:
        """Each maximal run of one symbol gets one name; with it the definitions (step, name, symbol, length, 0)."""
        n, seg = self.names, self.seg
        first = np.ones(len(seg), bool)
        first[1:] = (n[0][1:] != n[0][:-1]) | (n[1][1:] != n[1][:-1]) | (seg[1:] != seg[:-1])
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(seg))).astype(_U)
        long = size > 1
        names = [np.where(long, _pair_name(x[at], size + _U(salt << 32), k), x[at]) for k, x in enumerate(n)]
        none = np.zeros(len(at), _U)
        made = np.stack([none, *names, n[0][at], n[1][at], size, none], 1)
        return Level(names, self.start[at], self.end[np.append(at[1:], len(seg)) - 1] if len(seg) else self.end, seg[at]), made

    def left(self, salt: int) -> np.ndarray:
        """Which symbols are of the left class of a round."""
        return (_mix(self.names[0] + _U(salt * int(_ADD[1]) % (1 << 64))) & _U(1)).astype(bool)

    def pairs(self, left: np.ndarray, salt: int) -> tuple[Level, np.ndarray]:
        """Each symbol of the left class followed by one of the right class is joined with it; with the definitions
        (step, name, left symbol, right symbol) of all symbols, also of those that stay as they are."""
        m = len(left)
        join = np.zeros(m, bool)
        join[:-1] = left[:-1] & ~left[1:] & (self.seg[1:] == self.seg[:-1])
        taken = np.zeros(m, bool)
        taken[1:] = join[:-1]
        at = np.flatnonzero(~taken)
        joined = join[at]
        to = at + joined
        n = self.names
        names = [np.where(joined, _pair_name(x[at], x[to] ^ _U(salt), k), x[at]) for k, x in enumerate(n)]
        none = np.zeros(len(at), _U)
        made = np.stack([none + _U(1), *names, n[0][at], n[1][at], *[np.where(joined, x[to], none) for x in n]], 1)
        return Level(names, self.start[at], self.end[to], self.seg[at]), made

    def symbol_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start)), self.end - self.start)


def compress(level: Level, a: np.ndarray, b: np.ndarray, salt: int) -> tuple[Level, np.ndarray, np.ndarray, np.ndarray]:
    """One round: the level above, the bounds a[i] (b[i]) of the core of a window that begins (ends) at word i, and the definitions."""
    last = len(level.end) and int(level.end[-1])
    runs, named = level.runs(salt)
    sym = runs.symbol_of_word()
    inside = lambda x: np.clip(x, 0, max(last - 1, 0))
    if last:
        a, b = np.where(a < last, runs.end[sym[inside(a)]], a), np.where(b > 0, runs.start[sym[inside(b - 1)]], b)
        left = runs.left(salt)
        x, y = sym[inside(a)], sym[inside(b - 1)]
        a, b = np.where((a < last) & ~left[x], runs.end[x], a), np.where((b > 0) & left[y], runs.start[y], b)
    above, paired = runs.pairs(runs.left(salt), salt)
    return above, a, b, np.concatenate([named, paired])


class _Prefix:
    """Names of any substring of symbols or words, from prefix sums modulo 2^64."""

    def __init__(self, names: np.ndarray, lane: int):
        base = _MUL[lane]
        inverse = _U(pow(int(base), -1, 1 << 64))
        n = len(names)
        self.power, self.inverse = np.ones(n + 1, _U), np.ones(n + 1, _U)
        self.power[1:], self.inverse[1:] = base, inverse
        self.power, self.inverse = np.cumprod(self.power, dtype=_U), np.cumprod(self.inverse, dtype=_U)
        self.sums = np.zeros(n + 1, _U)
        self.sums[1:] = np.cumsum(_mix(names) * self.power[:n], dtype=_U)

    def name(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(_U))


def windows(words: list[np.ndarray], seg: np.ndarray, level: Level, a_of: np.ndarray, b_of: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """All windows of ``length`` words that lie in one segment: start, core bounds, names of core and window.

    A window whose core is empty (long runs of one word) is its own core, so nothing is lost.
    """
    n = len(seg)
    at = np.flatnonzero(seg[: n - length + 1] == seg[length - 1 :]) if n >= length else np.zeros(0, np.int64)
    a, b = (a_of[at], b_of[at + length - 1]) if n else (at, at)
    ok = (a < b) & (a >= at) & (b <= at + length)
    a, b = np.where(ok, a, at), np.where(ok, b, at + length)
    out = {"at": at, "a": a, "b": b}
    sym = level.symbol_of_word()
    for k in LANES:
        text, syms = _Prefix(words[k], k), _Prefix(level.names[k], k)
        p, q = (sym[np.where(ok, a, 0)], sym[np.where(ok, b - 1, 0)] + 1) if n else (a, b)
        core = np.where(ok, syms.name(p, q), 0).astype(_U)
        left_words, right_words = text.name(at, np.where(ok, a, at + length)), text.name(np.where(ok, b, at + length), at + length)
        out[f"w{k}"] = _pair_name(_pair_name(left_words, core, k), right_words, k)
        out[f"c{k}"] = np.where(ok, core, out[f"w{k}"])
    return out


# The state of a record: names of its words and of its symbols (two lanes), words of a symbol, and the core bounds, relative to the word.
_STATE = "kind string, id long, w0 array<long>, w1 array<long>, s0 array<long>, s1 array<long>, len array<int>, a array<int>, b array<int>, made array<array<long>>"
_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_ARROW = pa.schema([("kind", pa.string()), ("id", pa.int64()), *[(n, _LONGS) for n in ("w0", "w1", "s0", "s1")], *[(n, _INTS) for n in ("len", "a", "b")], ("made", pa.list_(_LONGS))])


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, kind))


def _sliced(x: pa.ListArray, lo: int, hi: int) -> np.ndarray:
    """Values of the rows lo to hi."""
    offsets = x.offsets.to_numpy()
    return x.values.slice(offsets[lo], offsets[hi] - offsets[lo]).to_numpy(zero_copy_only=False)


class Records:
    """A chunk of whole records of the state, as flat arrays over all their words."""

    def __init__(self, batch: pa.RecordBatch, lo: int, hi: int):
        of = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
        self.kinds, self.ids = of["kind"].slice(lo, hi - lo), of["id"].slice(lo, hi - lo)
        sizes = lambda x: np.diff(of[x].offsets.to_numpy()[lo : hi + 1])
        self.sizes = sizes("w0")
        rows = np.arange(hi - lo)
        self.words = [_sliced(of[f"w{k}"], lo, hi).view(_U) for k in LANES]
        self.record = np.repeat(rows, self.sizes)
        none = (self.words[0] == 0) & (self.words[1] == 0)  # a null word: it ends a segment and is in none
        self.seg = 2 * (self.record + np.cumsum(none)) + none
        end = np.cumsum(_sliced(of["len"], lo, hi).astype(np.int64))
        start = np.append(0, end[:-1]) if len(end) else end
        self.level = Level([_sliced(of[f"s{k}"], lo, hi).view(_U) for k in LANES], start, end, self.seg[start] if len(end) else start)
        place = np.arange(len(self.seg))
        self.a, self.b = place + _sliced(of["a"], lo, hi), place + 1 - _sliced(of["b"], lo, hi)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Records]:
    for batch in batches:
        total = np.cumsum(np.diff(batch.column(batch.schema.get_field_index("w0")).offsets.to_numpy()))
        lo = 0
        while lo < batch.num_rows:  # whole records, about CHUNK_TOKENS words at a time
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CHUNK_TOKENS, "right")))
            yield Records(batch, lo, hi)
            lo = hi


def _round(salt: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _chunks(batches):
            above, a, b, made = compress(r.level, r.a, r.b, salt)
            made = made[np.argsort(made[:, 1], kind="stable")]
            made = made[np.append(True, (made[1:] != made[:-1]).any(1))] if len(made) else made
            own = r.record[above.start] if len(above.start) else above.start
            symbols = np.bincount(own, minlength=len(r.ids))
            place = np.arange(len(r.seg))
            signed = lambda x: x.view(np.int64)
            rows = _lists(signed(made.ravel()), np.full(len(made), 7), pa.int64())
            first = np.zeros(len(r.ids), np.int64)
            first[:1] = len(made)  # the definitions of a chunk go with its first record
            yield pa.RecordBatch.from_arrays(
                [r.kinds, r.ids, *[_lists(signed(w), r.sizes, pa.int64()) for w in r.words], *[_lists(signed(s), symbols, pa.int64()) for s in above.names],
                 _lists(above.end - above.start, symbols, pa.int32()), _lists(a - place, r.sizes, pa.int32()), _lists(place + 1 - b, r.sizes, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(first)), pa.int32()), rows)], schema=_ARROW)

    return run


_WINDOWS = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("c0", pa.int64()), ("c1", pa.int64()), ("at", _LONGS), ("w0", _LONGS), ("w1", _LONGS)])


def _windows(length: int, cores_only: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for the windows that follow one another in a record and have the same core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _chunks(batches):
            usable = (r.seg & 1) == 0
            w = windows(r.words, np.where(usable, r.seg, -1 - np.arange(len(r.seg))), r.level, r.a, r.b, length)
            at = w["at"]
            new = np.ones(len(at), bool)
            new[1:] = (w["a"][1:] != w["a"][:-1]) | (w["b"][1:] != w["b"][:-1]) | (r.record[at][1:] != r.record[at][:-1])
            first = np.flatnonzero(new)
            own = pa.array(r.record[at[first]])
            if cores_only:
                yield pa.RecordBatch.from_arrays([r.kinds.take(own), r.ids.take(own), *[pa.array(w[f"c{k}"][first].view(np.int64)) for k in LANES]], names=["kind", "id", "c0", "c1"])
                continue
            offsets = pa.array(np.append(first, len(at)), pa.int32())
            as_list = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x.view(np.int64)))
            yield pa.RecordBatch.from_arrays([r.kinds.take(own), r.ids.take(own), *[pa.array(w[f"c{k}"][first].view(np.int64)) for k in LANES], *map(as_list, (at, w["w0"], w["w1"]))], schema=_WINDOWS)

    return run


def clashing_names(state: DataFrame) -> int:
    """Names with more than one definition among those a round used: one combinable aggregation of the distinct definitions."""
    made = state.where(F.size("made") > 0).select(F.explode("made").alias("m")).select(F.col("m")[0].alias("step"), F.col("m")[1].alias("x"), F.col("m")[2].alias("y"), F.xxhash64(F.lit("definition"), *[F.col("m")[k] for k in (3, 4, 5, 6)]).alias("d"))
    return made.groupBy("step", "x", "y").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo <> hi").count()


def recompress(records: DataFrame, rounds: int, attempts: int = 4) -> DataFrame:
    """The state after ``rounds`` rounds of naming over all records (kind, id, words), a written table."""
    name = lambda lane: F.transform("words", lambda w: F.when(w.isNotNull(), F.xxhash64(F.lit("second lane"), w) if lane else F.xxhash64(w)).otherwise(F.lit(0).cast("long")))
    words = records.select(F.explode("words").alias("w")).where("w is not null").select(F.xxhash64("w").alias("x"), F.xxhash64(F.lit("second lane"), "w").alias("y"), F.xxhash64(F.lit("definition"), "w").alias("d"))
    if words.groupBy("x", "y").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo <> hi").limit(1).count():
        raise RuntimeError("two words have one name")
    zeros, ones = (F.transform("words", lambda _: F.lit(x)) for x in (0, 1))
    w0, w1 = name(0), name(1)
    state = cut_lineage(records.select("kind", "id", w0.alias("w0"), w1.alias("w1"), w0.alias("s0"), w1.alias("s1"), ones.alias("len"), zeros.alias("a"), zeros.alias("b"), F.array().cast("array<array<long>>").alias("made")))
    for k in range(1, rounds + 1):
        for attempt in range(attempts):
            above = cut_lineage(state.mapInArrow(_round(k + 64 * attempt), _STATE))
            if not clashing_names(above):
                break
            discard(above)
        else:
            raise RuntimeError("names clash in every attempt")
        discard(state)
        state = above
    return state


def shared_windows(records: DataFrame, length: int) -> DataFrame:
    """(kind, id, at): starts of the windows of ``length`` words that stand in another record of the kind too."""
    rounds = max(1, int(np.log2(max(length, 6) / 3)))
    usable = records.where(F.col("id").isNotNull() & (F.size("words") >= length)).select(F.coalesce("kind", F.lit("")).alias("kind"), F.col("id").cast("long").alias("id"), "words")
    state = recompress(usable, rounds)
    state_rows = state.select("kind", "id", "w0", "w1", "s0", "s1", "len", "a", "b")
    names = state_rows.mapInArrow(_windows(length, cores_only=True), "kind string, id long, c0 long, c1 long")
    cores = state_rows.mapInArrow(_windows(length), "kind string, id long, c0 long, c1 long, at array<long>, w0 array<long>, w1 array<long>")
    two = lambda df, *keys: df.groupBy("kind", *keys).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("kind", *keys)
    shared = cut_lineage(two(names, "c0", "c1"))
    candidates = cut_lineage(cores.join(shared, ["kind", "c0", "c1"], "left_semi").select("kind", "id", F.inline(F.arrays_zip("at", "w0", "w1"))))
    discard(state, shared)
    return candidates.join(two(candidates, "w0", "w1"), ["kind", "w0", "w1"], "left_semi").select("kind", "id", "at")


def shared_span_words(records: DataFrame, min_words: int = 12) -> DataFrame:
    """(kind, id, shared_words) of the records (kind, id, words) with a span of at least ``min_words`` successive
    words that stands word for word in a record of the same kind with another id.

    ``shared_words`` counts the word places in at least one such span, each once. A span repeated in its own
    record only isn't shared. Null ids, null arrays, empty and short records give no row; a null element
    belongs to no span and ends it; a null kind counts as ''. Repeated rows of one id count once each for their own
    places, so deduplicate ids first. Other columns play no part. Records of any length are read whole.
    """
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    starts = shared_windows(records.select("kind", "id", "words"), min_words)
    per = starts.groupBy("kind", "id").agg(F.array_sort(F.collect_set("at")).alias("p"))
    n = F.lit(min_words).cast("long")
    gaps = F.zip_with(F.col("p"), F.slice("p", F.lit(2), F.size("p")), lambda x, y: F.when(y.isNull(), n).otherwise(F.least(n, y - x)))
    return per.select("kind", "id", F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g).alias("shared_words"))
