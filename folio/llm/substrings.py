"""Substring dedup by seeds and extension.

Seeds are winnowed anchors of words; documents meet on anchors that more than one of them has. An anchor's unit (all
windows around it) is named by a 128-bit digest of its words: where a smaller document has the same unit, the whole unit
is repeated. The first document of each different unit brings its words to the anchor's task. There the units that
share the seed, word by word, are extended by one word after the other, to the left and to the right; each step parts
the classes of units that still agree, so that all matches of an anchor are extended together and no pairs are made. A
window is repeated where its left and right extensions meet in a class with a smaller document; repeated windows merge
into maximal repeats, which are ``size`` words long at least. Words are compared by content.

An anchor with over ``max_units`` different units is parted by what its windows share (:mod:`folio.llm.anchors`), and
the parts take the same way; texts of any length are read whole, in slices of whole rows.

Defined results: null text has no words; documents of fewer than ``size`` words lose nothing; rows that repeat a
``doc_id`` don't repeat each other (none is smaller); rows with a null ``doc_id`` neither lose nor take; white space is
not kept (one space joins the kept words); other columns are left out, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.anchors import Windows, contexts, covered, hot_keys, join_anchors, join_units, row_id, runs, split_units, suspected_units, with_rows
from folio.llm.common import documents, stored, tidy

#: Units that one step extends together.
SHARD_UNITS = 4096
MAX_UNITS = 500


def _parted(classes: np.ndarray, words: np.ndarray, vocabulary: int) -> np.ndarray:
    """The classes after one more word (-1: none left)."""
    return np.unique(classes * (vocabulary + 1) + words + 1, return_inverse=True)[1]


def repeated_starts(group: np.ndarray, ids: np.ndarray, place: np.ndarray, n: np.ndarray, texts: list[list[bytes]], size: int, gram: int) -> list[np.ndarray]:
    """For each unit (group of its anchor, document, anchor's place, windows, words): the windows that a smaller document of the group has too."""
    known: dict[bytes, int] = {}
    flat = np.array([known.setdefault(w, len(known)) for ws in texts for w in ws], np.int64)
    ends = np.cumsum([len(ws) for ws in texts])
    starts = ends - [len(ws) for ws in texts]
    reach = size - gram

    def beside(first: np.ndarray, step: int, count: int) -> np.ndarray:
        at = first[:, None] + step * np.arange(count)
        return np.where((at >= starts[:, None]) & (at < ends[:, None]), flat[np.clip(at, 0, len(flat) - 1)], -1)

    seed = group
    for w in beside(starts + place, 1, gram).T:
        seed = _parted(seed, w, len(known))
    left, right = [seed], [seed]
    for w in beside(starts + place - 1, -1, reach).T:
        left.append(_parted(left[-1], w, len(known)))
    for w in beside(starts + place + gram, 1, reach).T:
        right.append(_parted(right[-1], w, len(known)))
    hit_unit, hit_start = [], []
    for k in range(reach + 1):  # words of the window before the seed
        own = np.flatnonzero((place >= k) & (place - k < n))
        if not len(own):
            continue
        both = np.unique(left[k][own] * len(group) + right[reach - k][own], return_inverse=True)[1]
        least = np.full(both.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, both, ids[own])
        found = own[least[both] < ids[own]]
        hit_unit.append(found)
        hit_start.append(place[found] - k)
    unit, start = np.concatenate(hit_unit), np.concatenate(hit_start)
    order = np.lexsort((start, unit))
    cuts = np.searchsorted(unit[order], np.arange(len(group) + 1))
    return [start[order[i:j]] for i, j in zip(cuts, cuts[1:], strict=False)]


def _extended(units: DataFrame, spec: Windows) -> DataFrame:
    """Repeated ranges (rid, s1, n) of the units' contexts. Rows of an anchor stay together."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, groups = None, 0

        def done() -> pa.RecordBatch:
            rid, s1, count = [], [], []
            if held:
                group, ids, place, n = (np.array([x[i] for x in held], np.int64) for i in range(4))
                for (_, _, _, _, r, s, _), at in zip(held, repeated_starts(group, ids, place, n, [x[6] for x in held], spec.size, spec.gram), strict=True):
                    if len(at):
                        first, many = runs(at)
                        rid += [r] * len(first)
                        s1 += (s + first).tolist()
                        count += many.tolist()
                held.clear()
            return pa.record_batch([pa.array(rid, pa.binary()), pa.array(s1, pa.int64()), pa.array(count, pa.int64())], names=["rid", "s1", "n"])

        for batch in batches:
            for h, rid, i, s1, n, a, x in zip(*(batch.column(c).to_pylist() for c in ("h", "rid", "id", "s1", "n", "a", "context")), strict=True):
                if h != last:
                    if len(held) >= SHARD_UNITS:
                        yield done()
                    last, groups = h, groups + 1
                held.append((groups, i, a, n, rid, s1, x.split(b" ")))
        yield done()

    return units.repartition("h").sortWithinPartitions("h").mapInArrow(tidy(task), "rid binary, s1 long, n long")


def repeated_windows(docs: DataFrame, spec: Windows, max_units: int = MAX_UNITS) -> DataFrame:
    """Ranges (rid, s1, n) of windows of ``docs`` (rid, id, text) that start in a document with a smaller id."""
    found = stored(suspected_units(docs.where("id is not null"), spec), "seeds")
    whole, units = [], []
    for width in (*spec.parts, 0):
        total = found.count()
        hot, hot_units = hot_keys(found, total)
        kinds = found.groupBy("h", "u").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        seeds = kinds.groupBy("h").agg(F.min("first").alias("lo"), F.max("last").alias("hi"), F.count("*").alias("kinds")).where("lo < hi").select("h", "kinds")
        kinds = join_anchors(kinds.select("h", "u", "first"), seeds, hot)
        met = stored(join_units(found, kinds, hot_units).select("rid", "s1", "n", "h", "a", "kinds", (F.col("first") < F.col("id")).alias("whole")), "met")
        whole.append(met.where("whole").select("rid", "s1", "n"))
        own = met.where("not whole and kinds > 1").select("rid", "s1", "n", "h", "a", F.lit(True).alias("single"), "kinds")
        is_large = (F.col("kinds") > max_units) if width else F.lit(False)  # a part of one window is never large
        units.append(own.where(~is_large).drop("kinds"))
        large = own.where(is_large).drop("kinds")
        if large.isEmpty():
            break
        found = stored(split_units(with_rows(docs, large, total), spec, width), "parts")
    units = reduce(DataFrame.union, units)
    return reduce(DataFrame.union, whole).union(_extended(contexts(with_rows(docs, units, units.count()), spec), spec))


def remove_repeats(docs: DataFrame, size: int = 50, gram: int = 8, id_col: str = "doc_id", text_col: str = "text", max_units: int = MAX_UNITS) -> DataFrame:
    """One row per document: ``id_col``, kept text (words joined by a space), n_words, n_removed, spans (word runs removed)."""
    rows = docs.select(row_id(id_col, text_col).alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranges = repeated_windows(rows, Windows(size, gram, True, (8, 1)), max_units)
    found = ranges.groupBy("rid").agg(F.collect_list(F.struct("s1", "n")).alias("ranges"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_words, n_removed, spans = [], [], [], []
            for t, r in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                ws = (t or "").encode().split()
                gone = covered(r, size)
                n_words.append(len(ws))
                n_removed.append(sum(b - a for a, b in gone))
                for a, b in reversed(gone):
                    del ws[a:b]
                kept.append(b" ".join(ws).decode())
                spans.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=[id_col, text_col, "n_words", "n_removed", "spans"])

    return rows.join(found, "rid", "left").select("id", "text", "ranges").mapInArrow(tidy(task), f"`{id_col}` long, `{text_col}` string, n_words long, n_removed long, spans array<array<long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], size: int = 50) -> list[tuple[int, int, int, str]]:
    """The query's rows, every window looked up: for tests."""
    import hashlib

    first: dict[tuple, int] = {}
    words = [(d, (t or "").encode().split()) for d, t in docs]
    for d, ws in words:
        for i in range(len(ws) - size + 1):
            w = tuple(ws[i : i + size])
            first[w] = min(first.get(w, d), d)
    out = []
    for d, ws in words:
        gone = {j for i in range(len(ws) - size + 1) if first[tuple(ws[i : i + size])] < d for j in range(i, i + size)}
        out.append((d, len(ws), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(ws) if i not in gone)).hexdigest()))
    return out


#: The query's rows in SQL, every window looked up by its MD5.
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
g AS (SELECT rid, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS first FROM w) WHERE first < doc_id),
x AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS j FROM g),
l AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM d),
k AS (SELECT l.rid, count(x.j) AS n_removed, string_agg(word, ' ' ORDER BY l.j) FILTER (WHERE x.j IS NULL) AS kept FROM l LEFT JOIN x ON l.rid = x.rid AND l.j = x.j GROUP BY l.rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""
