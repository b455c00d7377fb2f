"""SimHash near-dedup with a similarity: what SimHash links, and documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

All documents get the SimHash fingerprint of :mod:`folio.llm.simhash`, and fingerprints within ``radius`` bits are linked
by its bit-sliced buckets. These links stand as they are; what follows only adds links that no fingerprint shows.

At a similarity of 0.8 two fingerprints of 64 bits differ in about 10 bits, and those of very short texts in up to 30, so
that no bounded number of buckets keyed by fingerprint bits finds all pairs, and no radius alone parts them from others.
Blocks therefore hold the documents that share one of ``BANDS`` keys of ``ROWS`` least shingles each: a pair at 0.8
shares no block with a probability of (1 - 0.8**4)**32, below 5e-8, and less above. Whole sets decide on every link.

Equal sets are one node. Each block's members are first compared with its least one only, so a large group of near
copies makes no pairs. Blocks whose members are not all connected by that go to a task with their sets. There the
fingerprints' bit planes are compared as in :mod:`folio.llm.simhash`, shift by shift, in lanes that are still apart:
pairs within ``RADIUS`` bits come first, and most groups are joined by them. For members still apart after that, the
block's inverted lists of shingles count every common shingle, so the radius saves time and loses nothing.

A block of over ``max_block`` members is parted before: two sets at the similarity share a shingle among the rarest
n - ceil(0.8 n) + 1 of each of them, so members meet by those; groups that are still larger are compared tile by tile.

Defined results: texts without a word are one set; a text of fewer than five words is one shingle; words are lower-cased
in ASCII and split at ASCII white space; texts of any length are read whole; null ``doc_id`` rows link but never name a
component; other columns are not read, whatever their names; an empty table gives no row. Sets are named by 64 bits, and
shingles stand for 64-bit hashes of five words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from folio.llm.common import BASE, BASE_INV, hot_of, join_salted, mix64, powers, slices, spread, stored, text_buffer, tidy, word_hashes, word_spans
from folio.llm.components import components
from folio.llm.simhash import _lanes, _planes, fingerprint, links, near

SHINGLE, SIMILARITY = 5, 0.8
ROWS, BANDS = 4, 32
#: Pairs within so many bits are compared first.
RADIUS = 24
#: A larger block is parted before its members are compared.
MAX_BLOCK = 1000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEDS = np.random.default_rng(11).integers(0, 2**63, (2, ROWS * BANDS), np.uint64)
_FLIP, _ODD = _SEEDS[0], _SEEDS[1] * np.uint64(2) + np.uint64(1)


def window_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """Hash of x[i:i+size] for every i, from one prefix sum of x[j] * BASE**j modulo 2**64."""
    if len(x) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        c = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * powers(BASE, len(x)), out=c[1:])
        return mix64((c[size:] - c[:-size]) * powers(BASE_INV, len(x) - size + 1))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and their bounds; a row without a word has the one shingle 0."""
    data = _LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    n = np.diff(first)
    many = np.flatnonzero(n >= shingle)
    counts = n[many] - shingle + 1
    hashes = [window_hashes(words, shingle)[spread(first[many], counts)]]
    rows = [np.repeat(many, counts)]
    for k in range(shingle):
        few = np.flatnonzero(n == k)
        # the number of words is mixed in, so that a short text is never a shingle of a long one
        hashes.append(mix64(window_hashes(words, k)[first[few]] ^ np.uint64(k)) if k and len(few) else np.zeros(len(few), np.uint64))
        rows.append(few)
    h, r = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], np.searchsorted(r[new], np.arange(len(offsets)))


def set_names(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    with np.errstate(over="ignore"):
        return mix64(np.add.reduceat(mix64(h ^ _FLIP[0]), bounds[:-1]) + np.diff(bounds).astype(np.uint64)).view(np.int64)


def fingerprints(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 bits a set; bit i is set where more than half of the shingle hashes have it."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, bounds[:-1], axis=0, dtype=np.int32)
    return np.packbits(2 * ones > np.diff(bounds)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def band_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Keys (row, band) of the sets."""
    out = np.zeros((len(bounds) - 1, BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS * BANDS):
            least = np.minimum.reduceat((h ^ _FLIP[k]) * _ODD[k], bounds[:-1])
            out[:, k // ROWS] = mix64(out[:, k // ROWS] + least + np.uint64(k))
    return out.view(np.int64)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int64()))


def printed(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """id, ``text_hash``, ``fp`` (the set's name), ``print`` (the SimHash fingerprint) and ``bands``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(text_col))
            for a, b in slices(offsets, 1 << 18):
                h, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                keys = band_keys(h, bounds)
                prints = np.array([fingerprint(t, shingle) for t in batch.column(text_col).slice(a, b - a).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).slice(a, b - a), batch.column("text_hash").slice(a, b - a), pa.array(set_names(h, bounds)), pa.array(prints), _lists(keys.ravel(), np.arange(b - a + 1) * BANDS)],
                    names=[id_col, "text_hash", "fp", "print", "bands"],
                )

    rows = docs.select(id_col, F.xxhash64(text_col).alias("text_hash"), text_col)
    return rows.mapInArrow(tidy(task), rows.select(id_col, "text_hash").schema.add("fp", "long").add("print", "long").add("bands", ArrayType(LongType())))


def _sets(texts: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """``fp``, ``bits`` (the fingerprint) and ``s``, the sorted shingle hashes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(text_col))
            for a, b in slices(offsets, 1 << 18):
                h, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                yield pa.RecordBatch.from_arrays([pa.array(set_names(h, bounds)), pa.array(fingerprints(h, bounds).view(np.int64)), _lists(h.view(np.int64), bounds)], names=["fp", "bits", "s"])

    return texts.select(text_col).mapInArrow(tidy(task), "fp long, bits long, s array<long>")


def unite(roots: np.ndarray, bits: np.ndarray, flat: np.ndarray, bounds: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links (member, member) of ``similarity`` or more that join all members' groups (``roots``) that such links join."""
    label = np.unique(roots, return_inverse=True)[1]
    planes, sizes, out = _planes(bits), np.diff(bounds), []
    n = len(roots)

    def join(i: int, j: int) -> None:
        label[label == label[j]] = label[i]
        out.append((i, j))

    for d in range(1, n):
        apart = label[:-d] != label[d:]
        if not apart.any():
            continue
        hit = near(planes, d, int.from_bytes(np.packbits(apart, bitorder="little").tobytes(), "little"), RADIUS)
        for i in _lanes(n - d, hit).tolist() if hit else ():
            if label[i] == label[i + d]:
                continue
            x, y = sizes[i], sizes[i + d]
            if min(x, y) < similarity * max(x, y):
                continue
            both = len(np.intersect1d(flat[bounds[i] : bounds[i + 1]], flat[bounds[i + d] : bounds[i + d + 1]], assume_unique=True))
            if both + 1e-9 >= similarity * (x + y - both):
                join(i, i + d)
    # the rest without a radius: inverted lists count all common shingles of a member and the others at once
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(n), sizes)[order]
    first = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]])) if len(flat) else np.zeros(0, np.int64)
    many = np.diff(np.concatenate([first, [len(flat)]]))
    lists = np.empty(len(flat), np.int64)
    lists[order] = np.repeat(np.arange(len(first)), many)
    for i in range(n):
        if (label == label[0]).all():
            break
        own = lists[bounds[i] : bounds[i + 1]]
        own = own[many[own] > 1]
        both = np.bincount(owner[spread(first[own], many[own])], minlength=n)
        alike = (both > 0) & (both + 1e-9 >= similarity * (sizes[i] + sizes - both)) & (label != label[i])
        for j in np.flatnonzero(alike).tolist():
            if label[i] != label[j]:
                join(i, j)
    return out


def _large_blocks(members: DataFrame, sets: DataFrame, similarity: float, max_block: int) -> DataFrame:
    """``members`` (key, fp, root) of large blocks in smaller ones, so that members at ``similarity`` still meet: by their rarest shingles, then by tiles."""
    each = members.join(sets.select("fp", "s"), "fp").select("key", "fp", "root", F.size("s").alias("n"), F.explode("s").alias("t"))
    rare = each.groupBy("key", "t").agg(F.count("*").alias("f"))
    place = F.row_number().over(Window.partitionBy("key", "fp").orderBy("f", "t"))
    reach = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - F.lit(1e-9)) + 1
    met = each.join(rare, ["key", "t"]).withColumn("place", place).where((F.col("place") <= reach) & (F.col("f") > 1))
    met = met.select(F.xxhash64("key", "t").alias("key"), "fp", "root")
    apart = _apart(met).select("key", "n")
    tiles = F.ceil(F.col("n") / F.lit(max_block)).cast("int")
    met = met.join(apart, "key").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    pairs = met.select("key", "fp", "root", "tile", other)
    return pairs.select(F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other")).alias("key"), "fp", "root")


def _apart(rooted: DataFrame) -> DataFrame:
    """``key`` and ``n`` of the blocks ``rooted`` (key, fp, root) with members of more than one root; blocks with the same members count once."""
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("members")).where("low <> high")
    return mixed.groupBy("n", "members").agg(F.min("key").alias("key")).select("key", "n")


def _mixed_links(members: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of the blocks ``members`` (key, fp, root, bits, s)."""

    def links(rows: list[tuple[int, int, int, np.ndarray]]) -> list[tuple[int, int]]:
        bounds = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])])
        found = unite(np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.int64).view(np.uint64), np.concatenate([r[3] for r in rows]), bounds, similarity)
        return [(rows[i][0], rows[j][0]) for i, j in found]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            s = batch.column("s")
            flat, at = s.values.to_numpy(), s.offsets.to_numpy()
            for i, (key, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "fp", "root", "bits")), strict=True)):
                if key != last and rows:
                    out += links(rows)
                    rows = []
                last = key
                rows.append((*row, flat[at[i] : at[i + 1]].copy()))
            yield _pairs(out)
        if rows:
            yield _pairs(links(rows))

    dealt = members.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(tidy(task), "a long, b long")


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])


def _print_links(rows: DataFrame, radius: int, total: int) -> DataFrame:
    """Links (a, b) over sets that join all whose documents' fingerprints are equal or within ``radius`` bits."""
    pairs = rows.select("fp", "print").distinct()
    prints = stored(pairs.groupBy("print").agg(F.min("fp").alias("lead"), F.count("*").alias("n")), "prints")
    same = join_salted(pairs, prints.select("print", "lead"), "print", hot_of(prints, "print", "n", total), "fp").select(F.col("fp").alias("a"), F.col("lead").alias("b"))
    close = links(prints.select(F.col("print").alias("fp")), radius)
    for end in ("a", "b"):
        close = close.join(prints.select(F.col("print").alias(end), F.col("lead").alias(f"set_{end}")), end)
    return same.where("a <> b").unionByName(close.select(F.col("set_a").alias("a"), F.col("set_b").alias("b")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", max_block: int = MAX_BLOCK, radius: int = 2) -> DataFrame:
    """One row per document: ``id_col``, ``fp`` (the set's name), ``component_id`` (the least id reachable)."""
    if not SIMILARITY <= similarity <= 1:
        raise ValueError(f"blocks are made for a similarity of {SIMILARITY} or more")
    rows = stored(printed(docs, shingle, id_col, text_col), "shingles")
    own_id = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    least = rows.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("n"), F.min(F.struct(own_id.alias("id"), "text_hash")).alias("rep"), F.first("bands").alias("bands"))
    total = rows.count()
    hot_sets = hot_of(rows.groupBy("fp").agg(F.count("*").alias("n")), "fp", "n", total)
    dealt = least.select("fp", F.posexplode("bands").alias("band", "k")).select("fp", F.xxhash64("band", "k").alias("key"))
    hubs = stored(dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("hub")).where("n > 1"), "hubs")
    buckets = stored(join_salted(dealt, hubs.select("key", "hub"), "key", hot_of(hubs, "key", "n", total), "fp").select("key", "fp", "hub"), "buckets")
    # one row a set: copies of one text never meet here
    wanted = least.join(buckets.select("fp").distinct(), "fp", "left_semi").select("rep.id", "rep.text_hash")
    texts = docs.select(own_id.alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).join(wanted, ["id", "text_hash"], "left_semi")
    sets = stored(_sets(texts, shingle, "text").dropDuplicates(["fp"]), "sets")
    pairs = buckets.where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()
    half = pairs.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("x")), "a")
    hot_hubs = hot_of(hubs.groupBy("hub").agg(F.sum("n").alias("n")), "hub", "n", total)
    both = join_salted(half, sets.select(F.col("fp").alias("b"), F.col("s").alias("y")), "b", hot_hubs, "a")
    common = F.size(F.array_intersect("x", "y"))
    alike = both.where(common + F.lit(1e-9) >= F.lit(similarity) * (F.size("x") + F.size("y") - common)).select("a", "b")
    roots = components(_print_links(rows, radius, total).unionByName(alike))
    rooted = buckets.join(roots, F.col("fp") == F.col("node"), "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    mixed = stored(rooted.join(_apart(rooted), "key").select("key", "fp", "root", "n"), "mixed")
    blocks = mixed.where(F.col("n") <= max_block).select("key", "fp", "root")
    if not (large := mixed.where(F.col("n") > max_block)).isEmpty():
        blocks = blocks.unionByName(_large_blocks(large, sets, similarity, max_block))
    more = _mixed_links(blocks.join(sets, "fp").select("key", "fp", "root", "bits", "s"), similarity)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    named = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return join_salted(rows, named.join(firsts, "root").select("fp", "component_id"), "fp", hot_sets, id_col).select(id_col, "fp", "component_id")
