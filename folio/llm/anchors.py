"""Winnowed anchors: which windows of a fixed size hold which anchor, the units they form, and repeated ones.

Elements are words or bytes. A window's anchor is its least k-gram by its whole 64-bit hash (the leftmost of equals),
which the window's content alone decides, so equal windows have equal anchors wherever they stand. The windows of one anchor start in one range; the
text they cover together is the anchor's unit, named by a 128-bit digest of its content (words joined by one space).
Equal units stand for all their windows at once; where units of one anchor differ, their contents meet in one task.

An anchor with too many different units for one task is parted (:func:`split_units`): windows with about the same anchor
place share a core of content, whose digest is the key of a smaller group. The last parting has one window a group, so
it ends whatever the input holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.blooms import bits_for, once_filter, passes, twice_filter
from folio.llm.common import BASE, BASE_INV, HOT_SHARE, mix64, powers, slices, spread, text_buffer, tidy, word_hashes, word_spans

#: Bytes of text that a step handles at a time: its arrays stay in the processor's cache.
SLICE = 1 << 18
UNITS = "rid binary, id long, s1 long, n long, h long, u binary, a int"


@dataclass(frozen=True)
class Windows:
    """``size`` elements a window, anchors of ``gram`` elements; elements are words or bytes. ``parts``: anchor places that share a core, by round."""

    size: int
    gram: int
    words: bool
    parts: tuple[int, ...] = (1,)


def row_id(id_col: str, text_col: str) -> Column:
    """A 128-bit digest of a row's id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit("|"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))))


class Elements:
    """The elements of some texts: ``x`` a hash of each, ``rows`` the texts' offsets in elements, and the bytes of any range."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, spec: Windows):
        self.words = spec.words
        self.raw = data.tobytes()
        if not spec.words:
            self.x, self.rows = data.astype(np.uint64) + np.uint64(1), offsets
            return
        self.starts, self.ends, self.rows = word_spans(data, offsets)
        self.x = word_hashes(data, self.starts, self.ends)
        odd = np.zeros(len(self.starts) + 1, np.int64)  # how many words so far follow on anything but one space
        if len(self.starts):
            odd[2:] = np.cumsum((self.starts[1:] - self.ends[:-1] != 1) | (data[self.ends[:-1]] != 32))
        self.odd = odd

    def content(self, a: np.ndarray, b: np.ndarray) -> Iterator[bytes]:
        """The bytes of the elements [a, b) for each pair; words are joined by one space."""
        raw = self.raw
        if not self.words:
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                yield raw[i:j]
            return
        for i, j, odd in zip(self.starts[a].tolist(), self.ends[b - 1].tolist(), (self.odd[b] > self.odd[a + 1]).tolist(), strict=True):
            yield b" ".join(raw[i:j].split()) if odd else raw[i:j]


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """For every i the place of the least of keys[i : i + width], the leftmost of equals: block-wise prefix and suffix minima.

    Whole keys are compared, so the place follows from the window alone, however long the text around it is.
    """
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    size = -(-len(keys) // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks, at = padded.reshape(-1, width), np.arange(size)
    before = np.minimum.accumulate(blocks, axis=1)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]
    fresh = np.ones(blocks.shape, bool)  # where a prefix gets a smaller minimum
    fresh[:, 1:] = before[:, 1:] != before[:, :-1]
    in_prefix = np.maximum.accumulate(np.where(fresh.ravel(), at, 0))
    in_suffix = np.minimum.accumulate(np.where((after == blocks).ravel(), at, size)[::-1])[::-1]
    left, right = after.ravel()[:n], before.ravel()[width - 1 : width - 1 + n]
    return np.where(left <= right, in_suffix[:n], in_prefix[width - 1 : width - 1 + n])


def gram_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ranges of ``size`` elements, independent of place. They choose anchors only; equal ones are not taken for equal content."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * powers(BASE, len(x)), out=sums[1:])
        out = sums[size:] - sums[:-size]
        out *= powers(BASE_INV, len(x) + 1)[: len(out)]
        return mix64(mix64(out) + np.uint64(size))


def units(x: np.ndarray, rows: np.ndarray, spec: Windows) -> tuple[np.ndarray, ...]:
    """For each unit: row, first window start (within the row), number of windows, anchor hash, anchor's place after the first start."""
    counts = np.maximum(0, np.diff(rows) - spec.size + 1)
    if not counts.sum():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    grams = gram_hashes(x, spec.gram)
    starts = spread(rows[:-1], counts)
    anchor = _least(grams, spec.size - spec.gram + 1)[starts]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    n = np.diff(np.concatenate([first, [len(starts)]]))
    s = starts[first]
    row = np.searchsorted(rows, s, "right") - 1
    return row, s - rows[row], n, grams[anchor[first]], anchor[first] - s


def _each(batch: pa.RecordBatch, spec: Windows) -> Iterator[tuple[int, Elements, tuple]]:
    data, offsets = text_buffer(batch.column(batch.schema.get_field_index("text")))
    for a, b in slices(offsets, SLICE):
        own = Elements(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], spec)
        yield a, own, units(own.x, own.rows, spec)


def _unit_batch(rid: pa.Array, ids: pa.Array, s: np.ndarray, n: np.ndarray, h: np.ndarray, u: list[bytes], a: np.ndarray) -> pa.RecordBatch:
    columns = [rid, ids, pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(h.view(np.int64)), pa.array(u, pa.binary()), pa.array(a, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["rid", "id", "s1", "n", "h", "u", "a"])


def suspected_units(docs: DataFrame, spec: Windows) -> DataFrame:
    """Units (rid, id, s1, n, h, u, a) of ``docs`` (rid, id, text) whose anchor passes the filter of anchors seen twice."""
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    guess = 2 * int(chars) // ((spec.size - spec.gram + 2) * (6 if spec.words else 1))

    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, found in _each(batch, spec):
            yield found[3]

    twice = docs.sparkSession.sparkContext.broadcast(twice_filter(docs.select("text"), bits_for(guess), anchors))
    name = xxhash.xxh3_128_digest

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, own, (row, s, n, h, place) in _each(batch, spec):
                keep = passes(twice.value, h)
                row, s, n, h, place = row[keep], s[keep], n[keep], h[keep], place[keep]
                a = own.rows[row] + s
                take = pa.array(at + row, pa.int64())
                yield _unit_batch(batch.column("rid").take(take), batch.column("id").take(take), s, n, h, [name(x) for x in own.content(a, a + n - 1 + spec.size)], place)

    return docs.select("rid", "id", "text").mapInArrow(tidy(task), UNITS)


def with_rows(docs: DataFrame, ranges: DataFrame, count: int) -> DataFrame:
    """``docs`` (rid, ...) joined with their ``ranges`` (rid, s1, n, ...) as an array; a filter of the rids keeps other texts out of the shuffle."""
    filt = docs.sparkSession.sparkContext.broadcast(once_filter(ranges.select("rid").distinct(), bits_for(count), lambda batch: iter([_low(batch.column(0))])))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(filt.value, _low(batch.column("rid")))))

    grouped = ranges.groupBy("rid").agg(F.collect_list(F.struct(*[c for c in ranges.columns if c != "rid"])).alias("ranges"))
    return docs.mapInArrow(tidy(task), docs.schema).join(grouped, "rid")


def _low(rids: pa.Array) -> np.ndarray:
    """The first eight bytes of each id."""
    return np.frombuffer(b"".join(rids.to_pylist()), "<u8")[::2] if len(rids) else np.zeros(0, np.uint64)


def _ranged(batch: pa.RecordBatch, spec: Windows) -> Iterator[tuple]:
    """For slices of a batch of :func:`with_rows`: elements, batch rows of the ranges, first elements, and the ranges' fields."""
    data, offsets = text_buffer(batch.column("text"))
    ranges = batch.column("ranges")
    bounds, flat = ranges.offsets.to_numpy() - ranges.offsets[0].as_py(), ranges.flatten()
    fields = {flat.type.field(i).name: flat.field(i) for i in range(flat.type.num_fields)}
    for i, j in slices(offsets, SLICE):
        own = Elements(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], spec)
        k = slice(int(bounds[i]), int(bounds[j]))
        row = np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1]))
        some = {c: v[k] for c, v in fields.items()}
        yield own, pa.array(i + row, pa.int64()), own.rows[row] + some["s1"].to_numpy(zero_copy_only=False), some


CONTEXTS = "h long, rid binary, id long, s1 long, n long, a int, single boolean, context binary"


def contexts(joined: DataFrame, spec: Windows) -> DataFrame:
    """The units' bytes of :func:`with_rows` (ranges of s1, n, h, a, single): h, rid, id, s1, n, a, single, context."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, rows, start, some in _ranged(batch, spec):
                n = some["n"].to_numpy(zero_copy_only=False)
                found = pa.array(list(own.content(start, start + n - 1 + spec.size)), pa.binary())
                columns = [some["h"], batch.column("rid").take(rows), batch.column("id").take(rows), some["s1"], some["n"], some["a"], some["single"], found]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "rid", "id", "s1", "n", "a", "single", "context"])

    return joined.select("rid", "id", "text", "ranges").mapInArrow(tidy(task), CONTEXTS)


def split_units(joined: DataFrame, spec: Windows, width: int) -> DataFrame:
    """Smaller units of :func:`with_rows`: windows of a unit whose anchor places fall into one bin of ``width``, keyed by what all windows of the bin share.

    Equal windows of one anchor have it at equal places, so they fall into one bin and share its core: none is lost.
    """
    name = xxhash.xxh3_128_digest

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, rows, start, some in _ranged(batch, spec):
                h, n, a, s1 = (some[c].to_numpy(zero_copy_only=False) for c in ("h", "n", "a", "s1"))
                low = (a - n + 1) // width
                bins = a // width - low + 1
                of = np.repeat(np.arange(len(n)), bins)
                k = spread(low, bins)
                s = np.maximum(0, a[of] - (k + 1) * width + 1)  # the bin's windows within the unit: from s to e
                e = np.minimum(n[of] - 1, a[of] - k * width)
                core = start[of] + a[of] - k * width
                key = [int.from_bytes(name(b"%d %d %b" % c)[:8], "little", signed=True) for c in zip(h[of].tolist(), k.tolist(), own.content(core, core - width + 1 + spec.size), strict=True)]
                u = [name(x) for x in own.content(start[of] + s, start[of] + e + spec.size)]
                take = rows.take(pa.array(of))
                yield _unit_batch(batch.column("rid").take(take), batch.column("id").take(take), s1[of] + s, e - s + 1, np.array(key, np.int64), u, a[of] - s)

    return joined.select("rid", "id", "text", "ranges").mapInArrow(tidy(task), UNITS)


def hot_keys(found: DataFrame, total: int) -> tuple[list[int], list[tuple[int, bytes]]]:
    """The anchors ``h`` and the units (h, u) with over the hot share of the rows; a hot unit's anchor is hot."""
    least = F.lit(max(total, HOT_SHARE * 100))
    hot = [r["h"] for r in found.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") * HOT_SHARE > least).select("h").collect()]
    if not hot:
        return [], []
    units = found.where(F.col("h").isin(hot)).groupBy("h", "u").agg(F.count("*").alias("n")).where(F.col("n") * HOT_SHARE > least)
    return hot, [(r["h"], bytes(r["u"])) for r in units.select("h", "u").collect()]


def join_anchors(kinds: DataFrame, seeds: DataFrame, hot: list[int]) -> DataFrame:
    """``kinds`` (h, ...) joined with ``seeds`` (one row an anchor). Rows of hot anchors stay where they are; their seeds are broadcast."""
    if not hot:
        return kinds.join(seeds, "h")
    is_hot = F.col("h").isin(hot)
    return kinds.where(~is_hot).join(seeds.where(~is_hot), "h").unionByName(kinds.where(is_hot).join(F.broadcast(seeds.where(is_hot)), "h"))


def join_units(found: DataFrame, kinds: DataFrame, hot: list[tuple[int, bytes]]) -> DataFrame:
    """``found`` (h, u, ...) joined with ``kinds`` (one row a unit). Copies of hot units stay where they are; their kinds are broadcast."""
    if not hot:
        return found.join(kinds, ["h", "u"])
    keys = F.broadcast(found.sparkSession.createDataFrame(hot, "h long, u binary"))

    def parted(how: str) -> tuple[DataFrame, DataFrame]:
        return found.join(keys, ["h", "u"], how), kinds.join(keys, ["h", "u"], how)

    cold, few = parted("left_anti"), parted("left_semi")
    return cold[0].join(cold[1], ["h", "u"]).unionByName(few[0].join(F.broadcast(few[1]), ["h", "u"]))


def covered(ranges: list, size: int) -> list[list[int]]:
    """Merged [from, to) runs of elements that windows starting in the ranges cover."""
    out: list[list[int]] = []
    for s, n in sorted((r["s1"], r["n"]) for r in ranges or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n - 1 + size)
        else:
            out.append([s, s + n - 1 + size])
    return out


def runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Firsts and lengths of the runs of following numbers."""
    first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1])) if len(at) else np.zeros(0, np.int64)
    return at[first], np.diff(np.concatenate([first, [len(at)]]))
