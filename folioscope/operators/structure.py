"""Seven structure metrics of lines and of their shuffles: each line is shuffled once, for all of them, in NumPy.

Batches of lines give counts over a small vocabulary and over neighbours at once. Runs of words are counted for each shuffle in a
task that gets its lines as codes with the words of each batch; where a shuffle has more than ``TASK_WORDS`` words, runs are dealt to
several tasks by their first word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import text
from folioscope.operators import digests, stats
from folioscope.session import cut_lineage

METRICS = ("adjacent_mi", "position_mi", "exact_rate", "edit1_rate", "repeated_2", "repeated_3", "repeated_4")
ORDERS = (2, 3, 4)
TASK_WORDS = 16_000_000  # fixed value: words of one shuffle whose runs one task counts, if no word is too frequent
PART_WORDS = 8_000_000  # fixed value: runs that a task holds at a time
BATCH_WORDS = 1_000_000  # fixed value: words that are shuffled at a time
MOST_PARTS = 256  # fixed value: parts for which runs of 64 bits are worth passes over the words
ADJACENT, POSITION, PAIRS, EXACT, EDIT, REPEATED, RUNS = range(7)


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion or replacement makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def spelled(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of words and their sets of characters, in 64 bits."""
    length, marks = np.array([len(w) for w in words], dtype=np.int32), np.zeros(len(words), dtype=np.uint64)
    bits = np.uint64(1) << (np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4") % 64).astype(np.uint64)
    if len(bits):
        marks[length > 0] = np.bitwise_or.reduceat(bits, (np.cumsum(length) - length)[length > 0])
    return length, marks


def near_pairs(length: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Whether words and the next may be one edit apart: others differ by more than one in length or two in characters."""
    return (np.abs(length[1:] - length[:-1]) <= 1) & (np.bitwise_count(marks[1:] ^ marks[:-1]) <= 2)


def edit_pairs(words: Sequence[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``one_edit`` of pairs of word numbers."""
    return np.array([one_edit(words[a], words[b]) for a, b in zip(left.tolist(), right.tolist())], dtype=bool)


def shuffled(key: str, size: int, seed: int, perm: int) -> list[int]:
    """Places of the words of a line in md5 order of (seed, perm, key, index)."""
    return sorted(range(size), key=lambda i: (md5(f"{seed}|{perm}|{key}|{i}".encode()).digest(), i))


def orders(keys: pa.Array, sizes: np.ndarray, seed: int, permutations: int) -> Iterator[np.ndarray]:
    """For each shuffle, places of the words of lines in md5 order inside each line; perm 0 stays. Lines in which the first words of
    digests don't decide are ordered by whole digests."""
    n, line = int(sizes.sum()), np.repeat(np.arange(len(sizes)), sizes)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    index = np.arange(n) - begin
    yield np.arange(n)
    words = np.empty((permutations, n), dtype=np.uint32)
    texts = pc.binary_join_element_wise(keys.take(pa.array(line)), pa.array([str(i) for i in range(int(sizes.max()))]).take(pa.array(index)), "|")
    for k, at, first in digests.first_words(texts, [f"{seed}|{p}|" for p in range(1, permutations + 1)]):
        words[k, at : at + len(first)] = first
    low = int(sizes.max()).bit_length()
    fits = len(sizes).bit_length() + 32 + low <= 63
    if fits:
        base, shift, mask = line.astype(np.uint64) << np.uint64(32 + low) | index.astype(np.uint64), np.uint64(low), np.uint64((1 << low) - 1)
    for p, first in enumerate(words, 1):
        if fits:
            placed = first.astype(np.uint64)
            placed <<= shift
            placed |= base
            placed.view(np.int64).sort()  # quicker than without a sign
            order = (placed & mask).view(np.int64) + begin
            placed >>= shift
            equal = line[1:][placed[1:] == placed[:-1]]
        else:
            order = np.lexsort((first, line))
            equal = line[1:][(first[order][1:] == first[order][:-1]) & (line[1:] == line[:-1])]
        for k in np.unique(equal).tolist():
            at = int(sizes[:k].sum())
            order[at : at + int(sizes[k])] = [at + i for i in shuffled(keys[k].as_py(), int(sizes[k]), seed, p)]
        yield order


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the keys that stand twice or more, and a dense number of each of these."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.argsort(keys)
    placed = keys[order]
    new = np.concatenate([[True], placed[1:] != placed[:-1]])
    more = np.diff(np.append(np.flatnonzero(new), len(keys))) > 1
    group = np.cumsum(new) - 1
    kept = more[group]
    return order[kept], (np.cumsum(more) - 1)[group[kept]]


def nested_runs(codes: np.ndarray, left: np.ndarray, at: np.ndarray, width: int) -> list[int]:
    """Instances of runs from the places ``at`` that stand twice or more, for each of ``ORDERS``, for words of any number: only what goes on
    from a repeated run can be repeated, so numbers stay exact and small."""
    out, number = [], codes[at].astype(np.int64)
    for order in ORDERS:
        whole = left[at] >= order
        at, number = at[whole], number[whole]
        kept, number = repeated(number * width + codes[at + order - 1])
        at = at[kept]
        out.append(len(at))
    return out


def run_counts(codes: np.ndarray, left: np.ndarray, width: int, begins: np.ndarray | None = None) -> np.ndarray:
    """Instances of runs of words that stand twice or more, and of all runs, for each of ``ORDERS``.

    ``left``: words of the line from a place on, ``begins``: the words at which a run may begin. A run is one number of 64 bits, of which the
    first word has what it needs inside its part; runs are counted by their first word, about ``PART_WORDS`` at a time.
    """
    out = np.zeros((2, len(ORDERS)), dtype=np.int64)
    first = left >= ORDERS[0] if begins is None else (left >= ORDERS[0]) & begins[codes]
    out[1] = [np.count_nonzero(first & (left >= order)) for order in ORDERS]
    bits = max(1, (width - 1).bit_length())
    if bits * ORDERS[-1] > 64:  # runs with a word that stands once aren't repeated
        again = np.bincount(codes, minlength=width) > 1
        width, known, codes = int(again.sum()), again[codes], np.maximum(np.cumsum(again, dtype=np.int32) - 1, 0)[codes]
        left = np.minimum(left, sum(np.logical_and.reduce([np.append(known[k:], np.zeros(k, dtype=bool)) for k in range(j + 1)]).astype(np.int8) for j in range(ORDERS[-1])))
        first &= left >= ORDERS[0]
        bits = max(1, (width - 1).bit_length())
    parts = 1 << max(0, -(-len(codes) // PART_WORDS) - 1).bit_length()  # a power of two
    excess = 1 << max(0, bits * ORDERS[-1] - 64)
    parts = max(parts, excess) if excess <= MOST_PARTS else parts
    if excess > MOST_PARTS:
        for part in range(parts):
            out[0] += nested_runs(codes, left, np.flatnonzero(first & (codes % parts == part)), width)
        return out
    share, runs = (codes & (parts - 1)).astype(np.uint16), (codes >> (parts.bit_length() - 1)).astype(np.uint64)
    for j in range(1, ORDERS[-1]):
        runs <<= np.uint64(bits)
        runs[:-j] |= codes[j:].astype(np.uint32)
    for part in range(parts):
        mine = first if parts == 1 else first & (share == part)
        for k, order in enumerate(ORDERS):
            placed = runs[mine if order == ORDERS[0] else mine & (left >= order)]
            placed >>= np.uint64((ORDERS[-1] - order) * bits)
            if (width - 1) // parts >> max(0, 32 - (order - 1) * bits) == 0 and (order - 1) * bits <= 32:
                placed = placed.astype(np.uint32)
            else:
                placed = placed.view(np.int64)  # quicker than without a sign; equal stays equal
            placed.sort()
            same = placed[1:] == placed[:-1]
            out[0, k] += np.count_nonzero(same) + np.count_nonzero(same[1:] > same[:-1]) + int(same[:1].sum())  # each group has one more than it has equal neighbours
    return out


def to_bytes(batch: pa.RecordBatch) -> bytes:
    stream = pa.BufferOutputStream()
    with pa.ipc.new_stream(stream, batch.schema) as to:
        to.write_batch(batch)
    return stream.getvalue().to_pybytes()


def packed(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines (keys, ws) as rows (lines) of about ``BATCH_WORDS`` words each, in the order of the keys,
    with words as numbers and their dictionary; empty lines fall out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in digests.gathered(batches, BATCH_WORDS, lambda b: len(b.column("ws").flatten())):
            if pc.min(pc.list_value_length(batch.column("ws"))).as_py() == 0:
                batch = batch.filter(pc.greater(pc.list_value_length(batch.column("ws")), 0))
            if batch.num_rows:
                placed = pc.sort_indices(batch, sort_keys=[(k, "ascending") for k in keys], null_placement="at_start")
                if (placed.to_numpy() != np.arange(len(placed))).any():  # else the words needn't be copied
                    batch = batch.take(placed)
                ends = np.append(0, np.cumsum(pc.list_value_length(batch.column("ws")).to_numpy(zero_copy_only=False)))
                words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), batch.column("ws").flatten().dictionary_encode())
                yield pa.record_batch([pa.array([to_bytes(batch.set_column(batch.num_columns - 1, "ws", words))], pa.binary())], names=["lines"])

    return lines.select(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), *keys, "ws").mapInArrow(run, "lines binary")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.DictionaryArray]]:
    """Keys, sizes and words of the lines of each row of ``packed``."""
    for batch in batches:
        for row in batch.column("lines"):
            lines = pa.ipc.open_stream(row.as_buffer()).read_next_batch()
            yield lines, pc.list_value_length(lines.column("ws")).to_numpy(zero_copy_only=False).astype(np.int64), lines.column("ws").flatten()


def task_row(perm: int, task: int, cells: np.ndarray, sizes: np.ndarray | None = None, words: pa.DictionaryArray | None = None) -> pa.RecordBatch:
    """A row for a task: counts, or sizes of lines and the bytes of one of them, and their words with the dictionary."""
    row = [[perm], [task], [b"" if sizes is None else sizes.tobytes()], [0 if sizes is None else sizes.itemsize], [b"" if words is None else to_bytes(pa.record_batch([words], names=["w"]))], [cells.tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary()))], names=["perm", "task", "sizes", "width", "lines", "cells"])


def counts(lines: DataFrame, keys: Sequence[str], top: Sequence[str], permutations: int, seed: int, tasks: int) -> DataFrame:
    """``packed_counts`` of lines (keys, ws)."""
    return packed_counts(packed(lines, keys), top, permutations, seed, tasks)


def packed_counts(lines: DataFrame, top: Sequence[str], permutations: int, seed: int, tasks: int) -> DataFrame:
    """(perm, kind, x, y, n) of lines of ``packed``, observed and shuffled: words side by side and by their place over the words of ``top``,
    pairs, equal pairs and pairs one edit apart, repeated runs and runs of each order."""
    other = len(top)
    number = {w: k for k, w in enumerate(top)} | {text.OTHER: other}
    side, none = other + 1, np.zeros((3, 0), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sizes, coded in unpacked(batches):
            words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            known = np.array([number.get(w, other) for w in words], dtype=np.int32)
            length, marks = spelled(words)
            wi, n = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)
            place = np.where(n == 1, 0, np.where(wi == 0, 1, np.where(wi == n - 1, 2, 3))).astype(np.int32)
            second = wi[1:] > 0
            task = None if tasks == 1 else np.array([zlib.crc32(w.encode()) % tasks for w in words])
            small, brief = pa.uint16() if len(words) <= 1 << 16 else pa.uint32(), np.uint8 if sizes.max() < 256 else np.uint32
            close, every = [], []
            for p, order in enumerate(orders(batch.column("key"), sizes, seed, permutations)):
                c = codes[order]
                k = known[c]
                near = near_pairs(length[c], marks[c]) & second
                at = np.flatnonzero(near)
                close.append(c[at].astype(np.int64) * len(words) + c[at + 1])
                found = [(ADJACENT, np.bincount((k[:-1] * side + k[1:])[second], minlength=side * side)), (POSITION, np.bincount(k * 4 + place, minlength=side * 4))]
                found += [(PAIRS, np.array([np.count_nonzero(second)])), (EXACT, np.array([np.count_nonzero((c[1:] == c[:-1]) & second)]))]
                every.append(np.concatenate([np.stack([np.full(len(z := np.flatnonzero(a)), kind), z, a[z]]) for kind, a in found], axis=1).astype(np.int64))
                for t in range(tasks):
                    if tasks == 1:
                        mine, own = sizes, c
                    else:
                        has = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=task[c] == t, minlength=len(sizes)) > 0
                        mine, own = sizes[has], c[np.repeat(has, sizes)]
                    yield task_row(p, t, none, mine.astype(brief), pa.DictionaryArray.from_arrays(pa.array(own).cast(small), coded.dictionary))
            distinct, which = np.unique(np.concatenate(close), return_inverse=True)
            apart = edit_pairs(words, distinct // len(words), distinct % len(words))[which]
            ends = np.cumsum([len(x) for x in close])
            for p, (end, x) in enumerate(zip(ends.tolist(), close)):
                yield task_row(p, 0, np.concatenate([every[p], [[EDIT], [0], [np.count_nonzero(apart[end - len(x) : end])]]], axis=1).astype(np.int64))

    def count(key: tuple, table: pa.Table) -> pa.Table:
        perm, t = (k.as_py() for k in key)
        cells = [np.frombuffer(x.as_py(), dtype=np.int64).reshape(3, -1) for x in table.column("cells")]
        with_lines = table.filter(pc.greater(pc.binary_length(table.column("lines")), 0))
        sizes, parts = [], []
        for size, brief, lines in zip(*(with_lines.column(c) for c in ("sizes", "width", "lines"))):
            part = pa.ipc.open_stream(lines.as_buffer()).read_next_batch().column(0)
            sizes.append(np.frombuffer(size.as_buffer(), dtype=f"u{brief.as_py()}").astype(np.int64))
            parts.append(pa.DictionaryArray.from_arrays(part.indices.cast(pa.int32()), part.dictionary))
        runs = np.zeros((2, len(ORDERS)), dtype=np.int64)
        if parts:
            every = pa.chunked_array(parts).unify_dictionaries()
            words = every.chunk(0).dictionary
            code = np.concatenate([x.indices.to_numpy() for x in every.chunks])
            del table, with_lines, parts
            left = np.concatenate([np.minimum(np.repeat(np.cumsum(z), z) - np.arange(z.sum()), ORDERS[-1]).astype(np.int8) for z in sizes])
            begins = None if tasks == 1 else np.array([zlib.crc32(w.encode()) % tasks == t for w in words.to_pylist()], dtype=bool)
            runs = run_counts(code, left, len(words), begins)
        rows = np.concatenate([*cells, *[np.array([np.full(len(ORDERS), kind), ORDERS, n]) for kind, n in zip((REPEATED, RUNS), runs)]], axis=1)
        kinds = rows[0]
        spread = np.where(kinds == ADJACENT, side, np.where(kinds == POSITION, 4, 1 << 40))
        x = np.where(kinds < PAIRS, rows[1] // spread, rows[1])
        return pa.table({"perm": pa.array(np.full(len(x), perm), pa.int32()), "kind": pa.array(kinds, pa.int32()), "x": pa.array(x, pa.int64()), "y": pa.array(rows[1] % spread, pa.int64()), "n": pa.array(rows[2], pa.int64())})

    made = lines.mapInArrow(run, "perm int, task int, sizes binary, width int, lines binary, cells binary")
    made = made.groupBy("perm", "task").applyInArrow(count, "perm int, kind int, x long, y long, n long")
    return made.groupBy("perm", "kind", "x", "y").agg(F.sum("n").alias("n"))


def word_counts(lines: DataFrame, keys: T.StructType) -> DataFrame:
    """(word, n, first) of lines of ``packed``: counts and the first places (keys, wi) in the order of the keys, one row a batch and word first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sizes, coded in unpacked(batches):
            codes = coded.indices.to_numpy(zero_copy_only=False)
            begins = np.cumsum(sizes) - sizes
            first = np.zeros(len(coded.dictionary), dtype=np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]  # the last of equals stays
            line = np.repeat(np.arange(len(sizes)), sizes)[first]
            own = batch.select(keys.names).take(pa.array(line))
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(codes, minlength=len(first)), pa.int64()), *own.columns, pa.array(first - begins[line], pa.int32())], names=["word", "n", *keys.names, "wi"])

    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), *keys.fields, T.StructField("wi", T.IntegerType())])
    return lines.mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"), F.min(F.struct(*keys.names, "wi")).alias("first"))


def structure_metrics(lines: DataFrame, keys: Sequence[str], k: int, permutations: int, seed: int) -> DataFrame:
    """(perm, the seven metrics) of lines (keys, ws), observed (perm 0) and with words shuffled inside the lines: two mutual informations
    over the k most frequent words, ties by first place, two rates of neighbours, three of n-grams. ``lines`` is read once."""
    pack = cut_lineage(packed(lines, keys))
    words = cut_lineage(word_counts(pack, lines.select(*keys).schema))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    top = [r["word"] for r in words.orderBy(F.desc("n"), "first").limit(k).select("word").collect()]
    every = cut_lineage(packed_counts(pack, top, permutations, seed, -(-total // TASK_WORDS) or 1))  # at most side² + 4 side + 9 rows a shuffle
    mi = lambda kind, name: stats.mutual_information(every.where(F.col("kind") == kind), "x", "y", ["perm"], "n").select("perm", F.col("mi").alias(name))
    of = lambda kind, x=None: F.sum(F.when((F.col("kind") == kind) & (F.lit(True) if x is None else F.col("x") == x), F.col("n")))
    rate = lambda a, b: F.when(b > 0, F.coalesce(a, F.lit(0)) / b)
    rates = every.groupBy("perm").agg(rate(of(EXACT), of(PAIRS)).alias("exact_rate"), rate(of(EDIT), of(PAIRS)).alias("edit1_rate"), *[rate(of(REPEATED, k), of(RUNS, k)).alias(f"repeated_{k}") for k in ORDERS])
    return mi(ADJACENT, "adjacent_mi").join(mi(POSITION, "position_mi"), "perm").join(rates, "perm").select("perm", *METRICS)
