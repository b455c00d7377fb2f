"""Bloom filters built on executors, merged segment by segment, and broadcast up to a fixed bound.

A filter only ever lets too much through: what passes is counted or joined exactly afterwards, so a filter that is
full costs time and never changes a result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from folio.llm.common import mix64, tidy

SEGMENT = 1 << 17  # bytes of a filter's segment
MAX_BITS = 1 << 29  # 64 MB: the bound of what is broadcast


def bits_for(n: int, a_hash: int = 16, max_bits: int = MAX_BITS) -> int:
    """A power of two of about ``a_hash`` bits for each of ``n`` hashes, at most ``max_bits``."""
    return min(max_bits, max(1 << 16, 1 << (a_hash * n - 1).bit_length() if n else 0))


def _positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(h)
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


def _has(filt: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (filt[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _add(filt: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(filt, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


class TwoBlooms:
    """A filter of hashes seen at least once and one of hashes seen at least twice, two bits a hash. No hash seen twice is missed."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        h, n = np.unique(hashes, return_counts=True)
        p, q = _positions(h, self.bits)
        again = (n > 1) | (_has(self.once, p) & _has(self.once, q))
        for at in (p, q):
            _add(self.twice, at[again])
            _add(self.once, at)


def passes(filt: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may have been added."""
    p, q = _positions(hashes, len(filt) * 8)
    return _has(filt, p) & _has(filt, q)


def _merged(df: DataFrame, bits: int, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], twice: bool) -> np.ndarray:
    size = min(SEGMENT, bits // 8)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = None
        for batch in batches:
            filters = filters or TwoBlooms(bits)
            for h in hashes(batch):
                filters.add(h)
        for k in range(bits // 8 // size if filters else 0):
            part = slice(k * size, (k + 1) * size)
            if filters.once[part].any():
                yield pa.record_batch({"segment": pa.array([k], pa.int32()), "once": [zlib.compress(filters.once[part].tobytes(), 1)], "twice": [zlib.compress(filters.twice[part].tobytes(), 1)]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, once, two = None, None, None  # rows come sorted by segment: one pair is held

        def told() -> pd.DataFrame:
            return pd.DataFrame({"segment": [segment], "bits": [zlib.compress((two if twice else once).tobytes(), 1)]})

        for pdf in batches:
            for k, o, t in zip(pdf["segment"], pdf["once"], pdf["twice"], strict=True):
                o, t = (np.frombuffer(zlib.decompress(bytes(x)), np.uint8) for x in (o, t))
                if k != segment:
                    if segment is not None:
                        yield told()
                    segment, once, two = k, o.copy(), t.copy()
                else:
                    two |= t | (once & o)
                    once |= o
        if segment is not None:
            yield told()

    parts = df.mapInArrow(tidy(build), "segment int, once binary, twice binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInPandas(tidy(merge), "segment int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.collect():  # compressed segments of one filter: bounded like it, and one job for all partitions
        out[r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(zlib.decompress(bytes(r["bits"])), np.uint8)
    return out


def twice_filter(df: DataFrame, bits: int, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """The filter of hashes that ``hashes`` yields twice or more over all batches of ``df``."""
    return _merged(df, bits, hashes, True)


def once_filter(df: DataFrame, bits: int, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """The filter of all hashes that ``hashes`` yields."""
    return _merged(df, bits, hashes, False)
