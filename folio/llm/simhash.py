"""SimHash near-dedup with bit-sliced comparison.

A fingerprint sums the bits of the XXH64 hashes of a text's word shingles. Fingerprints within ``radius`` (at most 2)
are found without comparing all pairs: 64 bits are cut into four parts, and two fingerprints that differ in two bits at
most agree in two parts at least, so each distinct fingerprint goes to six buckets keyed by two parts. A bucket with
more than ``split`` fingerprints is dealt anew by its other bits in the same way (six ways, 16 more bits), which bounds a
group at 2**16 fingerprints whatever the input holds.

Within a task the sorted fingerprints' bit planes are kept vertically, as 64 long bit vectors. Comparing every member
with the one d places on is 64 exclusive-ors of a plane with itself shifted by d, summed by carry-save counters; the
block is abandoned as soon as every lane exceeds the radius. Matches are merged in the task, so a bucket yields at most
one link a member. Links become components over distinct fingerprints.

With ``similarity`` documents whose shingle sets have at least this Jaccard similarity are linked besides
(:mod:`folio.llm.shingles`), as such pairs often differ in more bits than buckets can find.

Defined results: null or wordless text has fingerprint zero, linked like any other; copies share one fingerprint, and
rows that repeat a ``doc_id`` are kept; null ``doc_id`` rows link but never name a component (null where no other does);
texts of any length are read whole; other columns stay in :func:`keep_first`, whatever their names, and are left out of
:func:`near_duplicates`; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import documents, hot_of, join_salted, stored, tidy
from folio.llm.components import components

BLOCK_LANES = 1 << 15
SPLIT = 1024


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits; bit i is set where more than half of the shingles' hashes have it."""
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    if len(ws) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(ws), 42)], np.uint64)
    else:
        line = b" ".join(ws)
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        h = xxhash.xxh64_intdigest
        hashes = np.array([h(line[a:b], 42) for a, b in zip(starts[: len(ws) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text_col: str = "text") -> DataFrame:
    """``docs`` with ``fp`` (long: the fingerprint's bits)."""
    columns = [c for c in docs.columns if c not in (text_col, "fp")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(text_col).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(fps, pa.int64())], names=[*columns, "fp"])

    return docs.select(*columns, text_col).mapInArrow(tidy(task), docs.select(*columns).schema.add("fp", "long"))


def _planes(fps: np.ndarray) -> list[int]:
    """Plane j as one number: bit i is bit j of fps[i]."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return [int.from_bytes(np.packbits(bits[:, j], bitorder="little").tobytes(), "little") for j in range(64)]


def _lanes(n: int, word: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(word.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n])


def near(planes: list[int], d: int, lanes: int, radius: int) -> int:
    """Which of the lanes (a bit vector) are within ``radius`` of the one d places on: carry-save counters, one bit vector a digit.

    The counters start so high that the first difference over the radius carries out of their last digit; that lane leaves,
    and the block is abandoned as soon as no lane is left.
    """
    digits = radius.bit_length() if radius else 1
    start = (1 << digits) - 1 - radius
    counter = [lanes if start >> k & 1 else 0 for k in range(digits)]
    alive = lanes
    for p in planes:
        carry = (p ^ (p >> d)) & alive
        for k in range(digits):
            if not carry:
                break
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        else:
            alive &= ~carry
            if not alive:
                break
    return alive


def link_groups(key: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, first of its matches) within runs of equal ``key``; every match within the radius is joined by them."""
    n = len(key)
    if n < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([first, [n]]))
    a_out, b_out = [], []
    # runs of about equal size share blocks, so that few lanes idle
    classes = np.ceil(np.log2(sizes)).astype(np.int64)
    for c in np.unique(classes[sizes > 1]):
        runs = np.flatnonzero((classes == c) & (sizes > 1))
        ends = np.cumsum(sizes[runs])
        i = 0
        while i < len(runs):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK_LANES, "right")))
            s, f = sizes[runs[i:j]], first[runs[i:j]]
            at = np.arange(s.sum()) + np.repeat(f - (np.cumsum(s) - s), s)
            block = fps[at]
            left = np.repeat(s, s) - (np.arange(len(at)) - np.repeat(np.cumsum(s) - s, s))  # places to the run's end
            planes = _planes(block)
            label = np.arange(len(block))
            for d in range(1, int(s.max())):
                lanes = int.from_bytes(np.packbits(left > d, bitorder="little").tobytes(), "little")
                hit = near(planes, d, lanes, radius)
                if not hit:
                    continue
                x = _lanes(len(block), hit)
                y = x + d
                while True:  # unite: labels only fall, and a label is a member's place
                    lx, ly = label[x], label[y]
                    differ = lx != ly
                    if not differ.any():
                        break
                    x, y, lx, ly = x[differ], y[differ], lx[differ], ly[differ]
                    np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
                    while True:
                        flat = label[label]
                        if (flat == label).all():
                            break
                        label = flat
            joined = np.flatnonzero(label != np.arange(len(block)))
            a_out.append(block[joined])
            b_out.append(block[label[joined]])
            i = j
    return (np.concatenate(a_out), np.concatenate(b_out)) if a_out else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _part(i: int):
    """Sixteen bits of the fingerprint."""
    return F.shiftrightunsigned(F.col("fp"), 16 * i).bitwiseAND(F.lit(0xFFFF))


def _pair_keys():
    """Six keys from four parts: which pair of parts, and their bits."""
    return [F.struct(F.lit(k).alias("way"), F.shiftleft(_part(i), 16).bitwiseOR(_part(j)).alias("bits")) for k, (i, j) in enumerate(combinations(range(4), 2))]


def _rest(way: int):
    """For bucket way ``way``: the six keys of the 32 bits that the bucket leaves open, as four parts of eight."""
    open_parts = [p for p in range(4) if p not in list(combinations(range(4), 2))[way]]
    eights = [F.shiftrightunsigned(F.col("fp"), 16 * p + 8 * h).bitwiseAND(F.lit(255)) for p in open_parts for h in (0, 1)]
    return F.array(*[F.shiftleft(eights[i], 8).bitwiseOR(eights[j]).bitwiseOR(F.lit((k + 1) << 16)) for k, (i, j) in enumerate(combinations(range(4), 2))])


def links(distinct: DataFrame, radius: int = 2, split: int = SPLIT) -> DataFrame:
    """Links (a, b) over distinct fingerprints ``fp`` that connect all pairs within the radius."""
    if not 0 <= radius <= 2:
        raise ValueError("four parts find a radius of 2 at most")
    dealt = distinct.select("fp", F.explode(F.array(*_pair_keys())).alias("k")).select("fp", F.col("k.way").alias("way"), F.col("k.bits").alias("bits"))
    sizes = dealt.groupBy("way", "bits").agg(F.count("*").alias("n")).where("n > 1")
    sized = dealt.join(sizes, ["way", "bits"])
    sub = F.when(F.col("n") <= split, F.array(F.lit(0).cast("long")))
    for w in range(6):
        sub = sub.when(F.col("way") == w, _rest(w))
    keyed = sized.select("fp", F.xxhash64("way", "bits").alias("k1"), F.explode(sub).alias("k2"))
    keyed = keyed.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "fp")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest_k, rest_f = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        for pdf in batches:
            k = np.concatenate([rest_k, pdf[["k1", "k2"]].to_numpy(np.int64)])
            f = np.concatenate([rest_f, pdf["fp"].to_numpy(np.int64)])
            if not len(k):
                continue
            run = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]).any(axis=1))])
            cut = int(np.searchsorted(run, run[-1]))  # the last group may go on in the next batch
            a, b = link_groups(run[:cut], f[:cut].view(np.uint64), radius)
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
            rest_k, rest_f = k[cut:], f[cut:]
        a, b = link_groups(np.zeros(len(rest_f), np.int64), rest_f.view(np.uint64), radius)
        yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return keyed.mapInPandas(tidy(task), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """One row per document: ``id_col``, ``fp``, ``component_id`` (the least id reachable)."""
    if similarity is not None:
        from folio.llm import shingles

        return shingles.near_duplicates(docs, shingle, similarity, id_col, text_col, radius=radius)
    printed = stored(fingerprints(docs.select(id_col, text_col), shingle, text_col), "fingerprints")
    least = printed.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("n"))
    hot = hot_of(least, "fp", "n", printed.count())  # one text in very many rows
    roots = components(links(least.select("fp"), radius))
    named = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return join_salted(printed, named.join(firsts, "root").select("fp", "component_id"), "fp", hot, id_col).select(id_col, "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """The documents that are their component's first (and those without an id)."""
    found = near_duplicates(docs, shingle, radius, id_col, text_col, similarity)
    firsts = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__folio_id")).distinct()
    return docs.join(firsts, docs[id_col] == F.col("__folio_id"), "left_semi").unionByName(docs.where(F.col(id_col).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
