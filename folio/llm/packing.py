"""Best-fit packing of tokenised documents into sequences, after a linear grouping scheme.

Lengths are whole numbers up to the capacity, so the driver plans on the histogram (at most ``capacity`` rows at any
input size): large lengths are rounded up within groups of equal cardinality, few-size configurations are optimised by
column generation, the actual lengths are substituted group by group, and what is left (small lengths, rounding
remainders) goes best-fit, longest first, into the remaining gaps. The plan is a table of intervals "the items of
length l with ranks a to b go to sequences s, s+1, ... at offset o"; executors look their pieces up in it.
A piece's rank among those of its length comes from task-local counters plus a running sum over (length, task), told to
the tasks where it is small, so that the pieces are not shuffled, and joined to the pieces where it is not.

Defined results: null text counts as empty (one end id, so one piece of length 1); repeated rows are packed each;
null ``doc_id`` is kept; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import documents, stored, text_buffer, tidy
from folio.llm.tokens import encoded, encoder

CAPACITY = 1024
#: Up to so many rows (length, task), the running sums go to the tasks that look pieces up as one broadcast (16 bytes each); more are joined.
TOLD = 1 << 18


def groups(hist: dict[int, int], small: int, count: int) -> list[tuple[int, list[list[int]]]]:
    """Linear grouping: (rounded length, [[length, number], ...]) from the longest, ``count`` groups of equal cardinality."""
    large = [[n, hist[n]] for n in sorted(hist, reverse=True) if n > small and hist[n]]
    share = max(1, -(-sum(n for _, n in large) // count))
    out, room = [], 0
    for length, n in large:
        while n:
            if not room:
                out.append((length, []))
                room = share
            k = min(n, room)
            out[-1][1].append([length, k])
            n, room = n - k, room - k
    merged: list[tuple[int, list[list[int]]]] = []
    for size, runs in out:
        if merged and merged[-1][0] == size:
            merged[-1][1].extend(runs)
        else:
            merged.append((size, runs))
    return merged


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Fractional optimum of few-size bin packing: revised simplex, columns generated by a knapsack over the capacity."""
    k = len(sizes)
    inverse = np.diag(1.0 / (capacity // sizes))
    columns = [np.where(np.arange(k) == i, capacity // sizes[i], 0) for i in range(k)]
    x = inverse @ demand
    for _ in range(rounds):
        y = inverse.sum(axis=0)
        value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        low = int(sizes.min())
        for c in range(low, capacity + 1):
            fits = c - sizes
            got = np.where(fits >= 0, value[np.maximum(fits, 0)] + y, -1.0)
            best = int(got.argmax())
            value[c], choice[c] = (got[best], best) if got[best] > value[c - 1] + 1e-12 else (value[c - 1], -2)
        if value[capacity] <= 1 + 1e-7:
            break
        col, c = np.zeros(k, np.int64), capacity
        while c >= low and choice[c] != -1:
            if choice[c] == -2:
                c -= 1
            else:
                col[choice[c]] += 1
                c -= int(sizes[choice[c]])
        d = inverse @ col
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = x - step * d
        x[out] = step
        inverse[out] /= d[out]
        others = np.arange(k) != out
        inverse[others] -= np.outer(d[others], inverse[out])
        columns[out] = col
    return list(zip(columns, np.maximum(x, 0), strict=True))


def plan(hist: dict[int, int], capacity: int = CAPACITY, count: int = 96) -> tuple[np.ndarray, int]:
    """Intervals (length, first rank, items, first sequence, offset) as rows, and the number of sequences."""
    hist = {int(k): int(v) for k, v in hist.items() if v}
    rank = dict.fromkeys(hist, 0)
    left = dict(hist)
    bins: list[list] = []  # [copies, free, [(length, first rank)]], one item of each slot a copy

    def put(length: int, n: int) -> tuple[int, int]:
        first = rank[length]
        rank[length] += n
        left[length] -= n
        return length, first

    if left.get(capacity):
        n = left[capacity]
        bins.append([n, 0, [put(capacity, n)]])
    grouped = groups({k: v for k, v in left.items() if k < capacity}, capacity // 16, count)
    if grouped:
        sizes = np.array([s for s, _ in grouped])
        demand = np.array([sum(n for _, n in runs) for _, runs in grouped], float)
        members = [sorted({k for k, _ in runs}, reverse=True) for _, runs in grouped]
        lengths = sorted((k for k in left if k < capacity), reverse=True)
        for col, x in sorted(configurations(sizes, demand, capacity), key=lambda z: -z[1]):
            copies = int(x + 1e-6)
            slots = [j for j in np.flatnonzero(col) for _ in range(col[j])]
            while copies:
                # actual lengths stand in for the rounded ones, the last slot takes the longest that fits; where one runs out, the copies split
                chosen: list[int] = []
                for j in slots[:-1]:
                    if (k := next((k for k in members[j] if left[k] > chosen.count(k)), None)) is not None:
                        chosen.append(k)
                free = capacity - sum(chosen)
                if (k := next((k for k in lengths if k <= free and left[k] > chosen.count(k)), None)) is not None:
                    chosen.append(k)
                if len(chosen) < len(slots):
                    break  # a group has run out: its remainder goes best-fit
                step = min(copies, *(left[k] // chosen.count(k) for k in chosen))
                heads = [put(k, step) for k in chosen]
                bins.append([step, capacity - sum(chosen), heads])
                copies -= step
    by_free: dict[int, list[list]] = {}
    for b in bins:
        by_free.setdefault(b[1], []).append(b)
    for length in sorted((k for k in left if left[k] > 0), reverse=True):
        while left[length]:
            free = next((f for f in range(length, capacity + 1) if by_free.get(f)), None)
            if free is None:
                per = capacity // length
                n = left[length] // per
                if n:
                    new = [n, capacity - per * length, [put(length, n) for _ in range(per)]]
                else:
                    m = left[length]
                    new = [1, capacity - m * length, [put(length, 1) for _ in range(m)]]
                bins.append(new)
                by_free.setdefault(new[1], []).append(new)
                continue
            b = by_free[free].pop()
            n = min(b[0], left[length])
            if n < b[0]:  # the rest of the class stays as it is, its items' ranks after those of the split part
                rest = [b[0] - n, free, [(k, r + n) for k, r in b[2]]]
                by_free[free].append(rest)
                bins.append(rest)
                b[0] = n
            b[1] = free - length
            b[2].append(put(length, n))
            by_free.setdefault(b[1], []).append(b)
    rows, sequence = [], 0
    for copies, _, slots in bins:
        offset = 0
        for length, first in slots:
            rows.append((length, first, copies, sequence, offset))
            offset += length
        sequence += copies
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return table, sequence


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's rank among those of its length in its task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            doc_ids = batch.column(0)
            for a, b, ids, counts in encoded(enc, *text_buffer(batch.column(1))):
                end = np.array([end_id], "<u4").tobytes()
                row, piece, start, length, crc, rank = [], [], [], [], [], []
                top = 0
                for i, n in enumerate(counts.tolist()):
                    data = ids[top : top + n].astype("<u4").tobytes() + end
                    top, n = top + n, n + 1
                    first = n % capacity or capacity
                    cuts = [0, *range(first, n + 1, capacity)]
                    for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        row.append(a + i)
                        piece.append(k)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(data[4 * s : 4 * e]))
                        rank.append(int(seen[e - s]))
                        seen[e - s] += 1
                yield pa.record_batch([doc_ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(rank, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    task.keeps = True  # the encoder, for the worker's next task
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tidy(task), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def offsets(counts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (length, part, n): the keys of (length, part) in order, and how many pieces of the length the parts before hold."""
    length, part, n = (counts.column(c).to_numpy().astype(np.int64) for c in ("length", "part", "n"))
    key = (length << 32) + part
    order = np.argsort(key)
    n, length = n[order], length[order]
    before = np.cumsum(n) - n
    return key[order], before - before[np.searchsorted(length, length)]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, told: int = TOLD) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset``."""
    cut = stored(pieces(docs, tokenizer, end_id, capacity), "pieces")  # written once: ranks must not change afterwards
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    lengths = counts.groupBy("length").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).collect()  # at most `capacity` rows
    table, _ = plan({r["length"]: r["n"] for r in lengths}, capacity)
    small = sum(r["parts"] for r in lengths) <= told
    if small:
        known = cut.sparkSession.sparkContext.broadcast(offsets(counts.toArrow()))
    else:
        before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
        cut = cut.join(before, ["length", "part"])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = (table[:, 0] << 44) + table[:, 1]
        for pdf in batches:
            length = pdf["length"].to_numpy()
            if small:
                keys, firsts = known.value
                first = firsts[np.searchsorted(keys, (length << 32) + pdf["part"].to_numpy())]
            else:
                first = pdf["before"].to_numpy()
            rank = pdf["rank"].to_numpy() + first
            at = np.searchsorted(key, (length << 44) + rank, "right") - 1
            pdf["sequence_id"] = table[at, 3] + rank - table[at, 1]
            pdf["offset"] = table[at, 4]
            yield pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return cut.mapInPandas(tidy(assign), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2)
