"""Suffix-array dedup: repeated byte strings by induced sorting of shard texts.

A string of ``size`` bytes that occurs twice has the same anchor in both places (:mod:`folio.llm.anchors`), so the texts
around one anchor make up a shard's text, and all equal strings meet in one shard. Units that occur whole twice or more
(equal 128-bit digests) are repeated at once and stand in the shard once. Each shard's suffix array is made by induced
sorting: suffixes are classified, the leftmost-smaller (LMS) substrings are sorted by one induction, named by content,
and ordered recursively, then all suffixes are induced from them; the permuted common prefixes are computed at
irreducible places and carried on. A place is repeated where the common prefix with either neighbour reaches ``size``.

Every step is done for a whole bucket of suffixes at a time, so buckets must be few: names that occur once are in place
already and only end the strings of the others, and where there are still over ``BUCKETS`` names, each is written as two
digits for the recursion, which keeps the suffixes' order.

An anchor with over ``max_units`` different units is parted by what its windows share, and the parts take the same way;
texts of any length are read whole, in slices of whole rows.

Defined results: null text counts as empty; texts shorter than ``size`` lose nothing; rows that repeat a document repeat
each other; nothing crosses documents; the kept bytes may end within a character; other columns are left out, whatever
their names; an empty table gives no row.
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

SHARD_BYTES = 3 << 17
#: Names that a recursion sorts as they are.
BUCKETS = 2048
MAX_UNITS = 500


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (the last, the sentinel, is)."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    step[-1] = 1
    at = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def _put(sa: np.ndarray, place: np.ndarray, t: np.ndarray, found: np.ndarray, sign: int, count: np.ndarray) -> None:
    """Puts the suffixes, in order, at their buckets' next places. ``count``: whole numbers from 0."""
    c = t[found]
    if len(c) == 1:
        k = c[0]
        sa[place[k]] = found[0]
        place[k] += sign
        return
    order = c.argsort(kind="stable")
    c = c[order]
    cut = (c[1:] != c[:-1]).nonzero()[0]
    first = np.zeros(len(cut) + 2, np.int64)
    first[1:-1] = cut + 1
    first[-1] = len(c)
    n = first[1:] - first[:-1]
    first = first[:-1]
    own = c[first]
    at = place[own]
    sa[(at - sign * first).repeat(n) + sign * count[: len(c)]] = found[order]
    place[own] = at + sign * n


def _induce(t: np.ndarray, small: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array from LMS suffixes in (partial) order: larger-type suffixes forwards, smaller-type backwards."""
    n, k = len(t), len(ends)
    heads = np.concatenate([[0], ends[:-1]])
    sa = np.full(n, -1, np.int64)
    count = np.arange(n)
    c = t[lms]
    order = np.argsort(c, kind="stable")
    own, bounds = lms[order], np.searchsorted(c[order], np.arange(k + 1)).tolist()
    used = np.unique(t).tolist()
    large, small = ~small, small.copy()
    small[-1] = False  # place -1, before the first, and the sentinel are never induced
    place = heads.copy()
    starts = heads.tolist()
    for b in used:
        at = starts[b]
        while at < (to := int(place[b])):
            found = sa[at:to] - 1
            at = to
            found = found[large[found]]
            if len(found):
                _put(sa, place, t, found, 1, count)
        if bounds[b] < bounds[b + 1]:
            found = own[bounds[b] : bounds[b + 1]] - 1
            found = found[large[found]]
            if len(found):
                _put(sa, place, t, found, 1, count)
    large_ends = place.tolist()
    place = ends - 1
    sa[0] = n - 1  # the sentinel's bucket
    place[t[n - 1]] -= 1
    tops = place.tolist()
    for b in reversed(used):
        at = tops[b]
        while at > (to := int(place[b])):
            found = sa[to + 1 : at + 1][::-1] - 1
            at = to
            found = found[small[found]]
            if len(found):
                _put(sa, place, t, found, -1, count)
        if starts[b] < large_ends[b]:
            found = sa[starts[b] : large_ends[b]][::-1] - 1
            found = found[small[found]]
            if len(found):
                _put(sa, place, t, found, -1, count)
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Of ``t``, any whole numbers from 0; a smaller sentinel is added and left out again."""
    t = np.concatenate([t.astype(np.int64) + 1, [0]])
    return _sort(t)[1:]


def _names(t: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Names, from 0, of the sorted substrings of ``length`` at ``at``: equal content has one name."""
    padded = np.concatenate([t, np.zeros(8, t.dtype)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(t), 8), (t.itemsize, t.itemsize))
    same = length[1:] == length[:-1]
    live, k = np.flatnonzero(same), 0
    while len(live):
        left = length[live] - k
        differ = ((eight[at[live] + k] != eight[at[live + 1] + k]) & (np.arange(8) < left[:, None])).any(axis=1)
        same[live[differ]] = False
        live = live[~differ & (left > 8)]
        k += 8
    return np.concatenate([[0], np.cumsum(~same)])


def _by_rest(names: np.ndarray, longest: int) -> np.ndarray:
    """The places of names that occur more than once, ordered by name and what follows."""
    once = np.bincount(names)[names] == 1
    kept = ~once  # and the name that ends each run of them: no comparison goes past it
    kept[1:] |= ~once[:-1]
    at = np.flatnonzero(kept)
    own, ranks = np.unique(names[at], return_inverse=True)
    if len(own) > BUCKETS and 2 * len(at) < longest:
        base = int(np.ceil(np.sqrt(len(own))))
        digits = np.stack([ranks // base, ranks % base], axis=1).ravel()
        order = suffix_array(digits)
        order = order[order % 2 == 0] // 2
    else:
        order = suffix_array(ranks)
    order = at[order]
    return order[~once[order]]


def _sort(t: np.ndarray) -> np.ndarray:
    """Suffix array of ``t``, whose last element is its only least one."""
    n = len(t)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ends = np.cumsum(np.bincount(t))
    narrow = t.astype(np.uint16) if len(ends) <= 1 << 16 else t
    sa = _induce(narrow, small, ends, lms)
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        got = sa[is_lms[sa]]
        place = np.zeros(n, np.int64)
        place[lms] = np.arange(len(lms))
        length = np.minimum(np.concatenate([lms[1:], [n - 1]]) + 1, n) - lms  # a substring ends with the next LMS element
        name = _names(narrow, got, length[place[got]])
        if name[-1] < len(lms) - 1:
            names = np.empty(len(lms), np.int64)
            names[place[got]] = name
            many = np.bincount(name)[name] > 1
            got[many] = lms[_by_rest(names, n - 1)]
            sa = _induce(narrow, small, ends, got)
        else:
            sa = _induce(narrow, small, ends, got)
    return sa


def common_prefixes(raw: np.ndarray, left: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(permuted common prefixes, the place before each in the array); ``left``: bytes to the end of the place's own text, 0 at a separator."""
    n = len(raw)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    carried = (before > 0) & (at > 0)
    p = before[carried]
    i = at[carried]
    same = (raw[i - 1] == raw[p - 1]) & (left[i - 1] > 0) & (left[p - 1] > 0)
    carried[i] = same
    out = np.zeros(n, np.int64)
    todo = np.flatnonzero(~carried & (before >= 0))
    padded = np.concatenate([raw, np.zeros(32, raw.dtype)])
    known = np.zeros(len(todo), np.int64)
    limit = np.minimum(left[todo], left[before[todo]])
    live = np.flatnonzero(limit > 0)
    eight = np.lib.stride_tricks.as_strided(padded, (n + 24, 8), (1, 1))  # the eight bytes from each place, without a copy
    while len(live):
        a, b = todo[live] + known[live], before[todo[live]] + known[live]
        differ = eight[a] != eight[b]
        any_ = differ.any(axis=1)
        known[live] += np.where(any_, differ.argmax(axis=1), 8)
        live = live[~any_ & (known[live] < limit[live])]
    out[todo] = np.minimum(known, limit)
    last = np.maximum.accumulate(np.where(~carried, at, -1))
    out = np.where(carried, np.maximum(0, out[last] - (at - last)), out)
    return out, before


def repeated_starts(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text: the places where a string of ``size`` bytes starts that starts at another place too."""
    lens = np.array([len(x) for x in texts], np.int64)
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    ends = np.cumsum(lens + 1) - 1
    t = raw.astype(np.int64) + 1
    t[ends] = 0
    left = np.repeat(ends, lens + 1) - np.arange(len(raw))
    sa = suffix_array(t)
    prefix, _ = common_prefixes(raw, left, sa)
    hit = prefix >= size
    after = np.zeros(len(raw), bool)
    after[sa[:-1]] = hit[sa[1:]]
    places = np.flatnonzero(hit | after)
    cut = np.searchsorted(places, np.concatenate([[0], ends + 1]))
    starts = ends - lens
    return [places[a:b] - s for a, b, s in zip(cut, cut[1:], starts, strict=False)]


#: Places of the anchor within a window that share one core (the bytes that all windows with these places hold).
CORE = 48


def open_ranges(group: list[tuple[int, int, bytes]], size: int) -> list[tuple[int, int]]:
    """For units (anchor's place, windows, bytes) of one anchor: the range of windows that may equal a window of another unit.

    Equal windows have the anchor at equal places, so they share the core of these places. A unit keeps the span of
    windows whose cores another unit has too; no equal pair is lost.
    """
    seen: dict[tuple[int, int], int] = {}
    cores: list[list[tuple[tuple[int, int], int, int]]] = []
    for a, n, x in group:
        own = []
        for k in range((a - n + 1) // CORE, a // CORE + 1):
            low, high = k * CORE, (k + 1) * CORE
            key = (k, hash(x[a - low : a - high + 1 + size]))
            seen[key] = seen.get(key, 0) + 1
            own.append((key, max(0, a - high + 1), min(n - 1, a - low)))
        cores.append(own)
    out = []
    for own in cores:
        shared = [(s, e) for key, s, e in own if seen[key] > 1]
        out.append((min(s for s, _ in shared), max(e for _, e in shared) + 1) if shared else (0, 0))
    return out


def _sharded(units: DataFrame, size: int) -> DataFrame:
    """Repeated window ranges (rid, s1, n) of the single contexts. Rows of an anchor stay together; a shard ends with the anchor that fills it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, bool, bytes]] = []
        group: dict[tuple, tuple] = {}
        total, last = 0, None

        def close() -> None:
            nonlocal total
            for (r, s1), (a, n, x, single), (s, e) in zip(group, group.values(), open_ranges([g[:3] for g in group.values()], size), strict=True):
                if e > s:
                    held.append((r, s1 + s, single, x[s : e - 1 + size]))
                    total += e - s - 1 + size
            group.clear()

        def done() -> pa.RecordBatch:
            nonlocal total
            rid, s1, n = [], [], []
            for (r, s, single, _), at in zip(held, repeated_starts([x[3] for x in held], size) if held else (), strict=True):
                if single and len(at):
                    first, many = runs(at)
                    rid += [r] * len(first)
                    s1 += (s + first).tolist()
                    n += many.tolist()
            held.clear()
            total = 0
            return pa.record_batch([pa.array(rid, pa.binary()), pa.array(s1, pa.int64()), pa.array(n, pa.int64())], names=["rid", "s1", "n"])

        for batch in batches:
            for h, rid, s1, n, a, x, single in zip(*(batch.column(c).to_pylist() for c in ("h", "rid", "s1", "n", "a", "context", "single")), strict=True):
                if h != last:
                    close()
                    if total >= SHARD_BYTES:
                        yield done()
                group[(rid, s1)] = (a, n, x, single)  # a row that repeats brings nothing new
                last = h
        close()
        yield done()

    return units.repartition("h").sortWithinPartitions("h").mapInArrow(tidy(task), "rid binary, s1 long, n long")


def repeated_ranges(rows: DataFrame, spec: Windows, max_units: int = MAX_UNITS) -> DataFrame:
    """Ranges (rid, s1, n) of windows of ``rows`` (rid, id, text) that start at any other place too."""
    found = stored(suspected_units(rows, spec), "anchors")
    whole, units = [], []
    for width in (*spec.parts, 0):
        total = found.count()
        hot, hot_units = hot_keys(found, total)
        kinds = found.groupBy("h", "u").agg(F.count("*").alias("times"), F.min(F.xxhash64("rid", "s1")).alias("rep"))
        seeds = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("times").alias("places")).where("places > 1").select("h", "kinds")
        kinds = join_anchors(kinds, seeds, hot).where("times > 1 or kinds > 1")
        met = stored(join_units(found, kinds, hot_units).select("rid", "s1", "n", "h", "a", "kinds", (F.col("times") == 1).alias("single"), (F.xxhash64("rid", "s1") == F.col("rep")).alias("is_rep")), "met")
        whole.append(met.where("not single").select("rid", "s1", "n"))
        own = met.where("is_rep and kinds > 1").select("rid", "s1", "n", "h", "a", "single", "kinds")
        is_large = (F.col("kinds") > max_units) if width else F.lit(False)  # a part of one window is never large
        units.append(own.where(~is_large).drop("kinds"))
        large = own.where(is_large).drop("kinds")
        if large.isEmpty():
            break
        found = stored(split_units(with_rows(rows, large, total), spec, width), "parts")
    units = reduce(DataFrame.union, units)
    return reduce(DataFrame.union, whole).union(_sharded(contexts(with_rows(rows, units, units.count()), spec), spec.size))


def remove_repeats(docs: DataFrame, size: int = 400, gram: int = 16, id_col: str = "doc_id", text_col: str = "text", max_units: int = MAX_UNITS) -> DataFrame:
    """One row per document: ``id_col``, kept (bytes), n_bytes, n_removed, spans (byte runs removed)."""
    rows = docs.select(row_id(id_col, text_col).alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranges = repeated_ranges(rows, Windows(size, gram, False, (48, 1)), max_units)
    found = ranges.groupBy("rid").agg(F.collect_list(F.struct("s1", "n")).alias("ranges"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_bytes, n_removed, spans = [], [], [], []
            for t, r in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                data = (t or "").encode()
                gone = covered(r, size)
                cuts = [0, *(x for run in gone for x in run), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
                n_bytes.append(len(data))
                n_removed.append(sum(b - a for a, b in gone))
                spans.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(kept, pa.binary()), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=[id_col, "kept", "n_bytes", "n_removed", "spans"])

    return rows.join(found, "rid", "left").select("id", "text", "ranges").mapInArrow(tidy(task), f"`{id_col}` long, kept binary, n_bytes long, n_removed long, spans array<array<long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], size: int = 400) -> list[tuple[int, int, int, int, str]]:
    """The query's rows, every string looked up: for tests."""
    import hashlib
    from collections import Counter

    data = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + size] for _, b in data for i in range(len(b) - size + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = True
        runs = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])).hexdigest()))
    return out


#: The query's rows in SQL, every string looked up by its MD5 (hex digits stand for bytes).
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT rid, i, md5(substring(h, 2 * i + 1, 800)) AS k FROM (SELECT rid, h, unnest(range(0, n - 399)) AS i FROM d)),
g AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
r AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM g),
s AS (SELECT rid, min(i) AS a, max(i) + 400 AS z FROM (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM r) GROUP BY rid, run),
e AS (SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM s),
k AS (SELECT rid, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(z) AS rest FROM e JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(rest, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""
