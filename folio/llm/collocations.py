"""Phrase collocations from compressed position bitmaps, in the manner of SPAM.

Documents become shards, one language each: every word of a shard has a number, and stands at a place. A word's bitmap
has a bit for each place; only its nonzero blocks of ``BITS`` places are kept. A phrase's bitmap has a bit where the
phrase ends. Shifted by one place, and'ed with the places that go on within a piece, and and'ed with a word's bitmap it
is the bitmap of a longer phrase, and its popcount is the shard's number of occurrences. Phrases grow depth-first, some
first words at a time; the bitmaps of a phrase's last word with each successor are what it is and'ed with. Popcounts of
the shards are summed. A phrase that always goes on in one way within a shard (as in copies of one text) has the longer
phrase's popcount, so only the longer one is told, with how many of its beginnings it stands for.

Which phrases can reach ``min_count`` over all shards is known beforehand, length by length: each shard adds its
phrases' hashes to saturating counters, which never count too few, and places whose phrase stays below are masked out
of all longer phrases. The counters of a length become a bit each and are broadcast, ``MAX_COUNTERS`` bits (8 MB) at
most; beyond that more phrases pass and are counted exactly all the same.

Defined results: null text has no words; null language is ``und``; words are the bytes between space, tab and the marks
``.,;:!?`` and line ends, lower-cased in A-Z, so they hold any other white space and are never empty; repeated rows
count each; texts of any length are read whole (a shard ends with the piece that fills it); equal ranks go by phrase;
other columns are ignored, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import documents, mix64, spread, stored, tidy

LONGEST = 5
BITS = 64
#: Words of a shard, and bitmap entries that are extended together (a pair's entry meets up to ``BITS`` words).
SHARD_WORDS, BATCH = 500_000, 20_000
#: Phrases that a task adds up before it tells them; words of the corpus for each bucket of told phrases, which has five times as many different ones at most.
HELD, BUCKET_WORDS = 300_000, 200_000
#: Counters of a length, and how many of them make a segment.
MAX_COUNTERS, SEGMENT = 1 << 26, 1 << 17
_MARKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(10 if c in _MARKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> tuple[list[bytes], list[int]]:
    """The words of a text, and how many each piece has."""
    pieces = [[w for w in p.split(b" ") if w] for p in (text or "").encode().translate(_TABLE).split(b"\n")]
    return [w for p in pieces for w in p], [len(p) for p in pieces if p]


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SHARD_WORDS) -> DataFrame:
    """lang, words (joined by line ends, by number), ids (a number for each place, bit-flipped where a piece begins)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Open:
            def __init__(self) -> None:
                self.known: defaultdict[bytes, int] = defaultdict()
                self.known.default_factory = self.known.__len__
                self.parts: list[np.ndarray] = []
                self.n = 0

            def add(self, words: list[bytes], lengths: list[int]) -> None:
                own = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
                first = np.cumsum([0, *lengths[:-1]])
                own[first] = ~own[first]
                self.parts.append(own)
                self.n += len(own)

        opened: dict[str, Open] = {}

        def told(lang: str) -> pa.RecordBatch:
            own = opened.pop(lang)
            return pa.record_batch([pa.array([lang]), pa.array([b"\n".join(own.known)], pa.binary()), pa.array([np.concatenate(own.parts).tobytes()], pa.binary())], names=["lang", "words", "ids"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, lengths = words_of(text)
                at = 0
                while lengths:  # a long text is dealt to several shards, at a piece's end
                    here = opened.setdefault(lang, Open())
                    k = int(np.searchsorted(np.cumsum(lengths), max(size - here.n, 1))) + 1
                    n = sum(lengths[:k])
                    here.add(words[at : at + n], lengths[:k])
                    at, lengths = at + n, lengths[k:]
                    if here.n >= size:
                        yield told(lang)
                while sum(x.n for x in opened.values()) >= 2 * size:
                    yield told(max(opened, key=lambda x: opened[x].n))
        for lang in list(opened):
            yield told(lang)

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(task), "lang string, words binary, ids binary")


class Shard:
    """A shard's words, places and the hash of the phrase of each length that ends at each place."""

    def __init__(self, lang: str, words: bytes, ids: bytes):
        self.words = words.split(b"\n")
        raw = np.frombuffer(ids, np.int32)
        self.inside = raw >= 0  # not a piece's first word
        self.ids = np.where(self.inside, raw, ~raw)
        self.seed = xxhash.xxh3_64_intdigest(lang.encode())
        self.hash = np.array([xxhash.xxh3_64_intdigest(w, self.seed) for w in self.words], np.uint64)

    def levels(self, filters: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1: which places end a phrase whose parts pass the filters, and the phrases' hashes; one length more than there are filters."""
        h = self.hash[self.ids]
        ok = np.ones(len(h), bool)
        for k in range(len(filters) + 1):
            if k:
                with np.errstate(over="ignore"):
                    h = np.concatenate([h[:1], mix64(h[:-1]) + self.hash[self.ids[1:]] * np.uint64(2 * k + 1)])
                ok = ok & np.concatenate([[False], ok[:-1]]) & self.inside
            if k < len(filters):
                ok = ok.copy()
                at = np.flatnonzero(ok)
                ok[at] = passing(filters[k], h[at])
            yield ok, h


def passing(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes' counters reached the count."""
    at = mix64(h) & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Shard]]:
    for batch in batches:
        for i in range(batch.num_rows):
            lang = batch.column(0)[i].as_py()
            yield lang, Shard(lang, batch.column(1)[i].as_py(), batch.column(2)[i].as_py())


def sparse(part: np.ndarray) -> bytes:
    """A segment's nonzero counters, compressed: the low bytes of their distances, the high ones, the counts."""
    at = np.flatnonzero(part)
    gap = np.diff(at, prepend=-1)
    return zlib.compress((gap & 255).astype(np.uint8).tobytes() + (gap >> 8).astype(np.uint16).tobytes() + part[at].tobytes(), 1)


def dense(counts: bytes, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The places of a segment's nonzero counters, and the counts."""
    raw = zlib.decompress(counts)
    n = len(raw) // (3 + np.dtype(kind).itemsize)
    gap = np.frombuffer(raw, np.uint8, n).astype(np.int64) + (np.frombuffer(raw, np.uint16, n, n).astype(np.int64) << 8)
    return np.cumsum(gap) - 1, np.frombuffer(raw, kind, n, 3 * n).astype(np.int64)


def next_filter(parts: DataFrame, filters: list[np.ndarray], counters: int, min_count: int) -> np.ndarray:
    """One bit a counter: whether phrases of the next length that fall on it may reach ``min_count``."""
    kind = np.uint8 if min_count < 256 else np.uint32
    size = min(SEGMENT, counters)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, shard in _each(batches):
            *_, (ok, h) = shard.levels(filters)
            at, n = np.unique(mix64(h[ok]) & np.uint64(counters - 1), return_counts=True)
            if total is None:
                total = np.zeros(counters, kind)
            total[at] = np.minimum(total[at] + n, min_count)
        for k in range(counters // size if total is not None else 0):
            part = total[k * size : (k + 1) * size]
            if part.any():
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([sparse(part)], pa.binary())], names=["segment", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, total = None, None  # rows come sorted by segment: one is held

        def told() -> pa.RecordBatch:
            return pa.record_batch([pa.array([segment], pa.int32()), pa.array([zlib.compress(np.packbits(total >= min_count, bitorder="little").tobytes(), 1)], pa.binary())], names=["segment", "bits"])

        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != segment:
                    if segment is not None:
                        yield told()
                    segment, total = k, np.zeros(size, np.int64)
                at, n = dense(c, kind)
                total[at] = np.minimum(total[at] + n, min_count)
        if segment is not None:
            yield told()

    built = parts.mapInArrow(tidy(build), "segment int, counts binary")
    merged = built.repartition("segment").sortWithinPartitions("segment").mapInArrow(tidy(merge), "segment int, bits binary")
    out = np.zeros(counters // 8, np.uint8)
    for r in merged.collect():  # compressed segments of one filter: bounded like it
        out[r["segment"] * size // 8 : (r["segment"] + 1) * size // 8] = np.frombuffer(zlib.decompress(bytes(r["bits"])), np.uint8)
    return out


def bitmaps(key: np.ndarray, place: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Compressed bitmaps: ``key * blocks + block``, sorted, and the block's bits. ``key``, ``place``: sorted by both."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = key.astype(np.int64) * blocks + place // BITS
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.bitwise_or.reduceat(np.uint64(1) << (place % BITS).astype(np.uint64), first)


def shifted(block: np.ndarray, bits: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries one place on, where ``mask`` (bits by block) lets them: (entry, block, bits); a block's last place moves to the next block."""
    stay = (bits << np.uint64(1)) & mask[block]
    over = (bits >> np.uint64(BITS - 1)) & mask[block + 1]
    a, b = np.flatnonzero(stay), np.flatnonzero(over)
    return np.concatenate([a, b]), np.concatenate([block[a], block[b] + 1]), np.concatenate([stay[a], over[b]])


def phrase_counts(shard: Shard, filters: list[np.ndarray]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(phrases, popcounts, covers) of one word and more that pass the filters; so many of a phrase's beginnings, one word shorter each, have its popcount and are not told themselves."""
    ids, n = shard.ids.astype(np.int64), len(shard.ids)
    blocks = n // BITS + 2
    ends = []  # by length: the places that may end a phrase, as bits by block
    for k, (ok, _) in enumerate(shard.levels(filters)):
        if k < len(filters):
            at = np.flatnonzero(ok)
            mask = np.zeros(blocks, np.uint64)
            b, bits = bitmaps(np.zeros(len(at), np.int64), at, blocks)
            mask[b] = bits
            ends.append(mask)
            if not k:
                places = at
    order = places[np.argsort(ids[places], kind="stable")]
    key, bits = bitmaps(ids[order], order, blocks)
    word, block = key // blocks, key % blocks
    own, at = np.unique(word, return_index=True)
    if not len(own):
        return
    yield [shard.words[w] for w in own.tolist()], np.add.reduceat(np.bitwise_count(bits).astype(np.int64), at), np.zeros(len(own), np.int64)
    # pairs: each word's bitmap, shifted, with those of all words of the block
    by_block = np.argsort(block, kind="stable")
    start = np.searchsorted(block[by_block], np.arange(blocks + 1))
    entry, to, moved = shifted(block, bits, ends[1])
    pairs = []
    for a in range(0, len(entry), BATCH):
        few = slice(a, a + BATCH)
        many = start[to[few] + 1] - start[to[few]]
        with_ = by_block[spread(start[to[few]], many)]
        both = np.repeat(moved[few], many) & bits[with_]
        hit = np.flatnonzero(both)
        left = np.repeat(entry[few], many)[hit]
        pairs.append((word[left], word[with_[hit]], block[with_[hit]], both[hit]))
    first, second, block, bits = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in range(4))
    if not len(first):
        return
    bits = bits.astype(np.uint64)
    order = np.lexsort((second, block, first))
    first, second, block, bits = first[order], second[order], block[order], bits[order]
    next_key = first * blocks + block  # a word's successors, block by block
    # depth-first: some first words' phrases at a time, all their lengths, before the next ones
    cut = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    at = 0
    while at < len(cut):
        to = max(at + 1, int(np.searchsorted(cut, cut[at] + BATCH, "right")) - 1)
        few = slice(int(cut[at]), int(cut[to]) if to < len(cut) else len(first))
        yield from _grown(shard, np.stack([first[few], second[few]], axis=1), block[few], bits[few], ends, next_key, second, bits, blocks)
        at = to


def _grown(shard: Shard, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray, ends: list[np.ndarray], next_key: np.ndarray, next_word: np.ndarray, next_bits: np.ndarray, blocks: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """The counts of the phrases of these entries (one row of word numbers an entry), and of all that go on from them."""
    words = len(shard.words)
    number = np.unique(phrase[:, 0] * words + phrase[:, 1], return_inverse=True)[1]
    rows, count, cover = np.zeros((0, 1), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)  # the length before
    parent = np.full(len(number), -1)

    def told(rows: np.ndarray, count: np.ndarray, cover: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        return [b" ".join([shard.words[w] for w in p]) for p in rows.tolist()], count, cover

    while True:
        now = np.bincount(number, np.bitwise_count(bits).astype(np.float64)).astype(np.int64)
        rep = np.zeros(len(now), np.int64)
        rep[number] = np.arange(len(number))
        above = parent[rep]
        stands = np.zeros(len(now), np.int64)
        if len(count):
            same = np.flatnonzero(count[above] == now)
            stands[same] = cover[above[same]] + 1
            alone = np.ones(len(count), bool)
            alone[above[same]] = False
            if alone.any():
                yield told(rows[alone], count[alone], cover[alone])
        rows, count, cover = phrase[rep], now, stands
        k = phrase.shape[1]
        if k == len(ends) or not len(bits):
            if len(count):
                yield told(rows, count, cover)
            return
        entry, to, moved = shifted(block, bits, ends[k])
        wanted = phrase[entry, -1] * blocks + to
        low, high = np.searchsorted(next_key, wanted), np.searchsorted(next_key, wanted, "right")
        many = high - low
        with_ = spread(low, many)
        both = np.repeat(moved, many) & next_bits[with_]
        hit = np.flatnonzero(both)
        left = np.repeat(entry, many)[hit]
        last = next_word[with_[hit]]
        parent = number[left]
        number = np.unique(parent * words + last, return_inverse=True)[1]
        phrase = np.column_stack([phrase[left], last])
        block, bits = np.repeat(to, many)[hit], both[hit]


def packed(held: dict[tuple[str, int, bytes], int], keys: list[tuple[str, int, bytes]]) -> bytes:
    """The counts of these phrases, compressed: in order, so that neighbours share their beginnings; a list for each language and cover."""
    groups = []
    for (lang, cover), own in groupby(sorted(keys), lambda k: k[:2]):
        phrases = [k[2] for k in own]
        groups.append([lang, cover, b"\n".join(phrases).decode(), [held[lang, cover, p] for p in phrases]])
    return zlib.compress(json.dumps(groups, ensure_ascii=False, separators=(",", ":")).encode(), 6)


def unpacked(counts: bytes) -> Iterator[tuple[tuple[str, int, bytes], int]]:
    for lang, cover, phrases, n in json.loads(zlib.decompress(counts)):
        yield from (((lang, cover, p), m) for p, m in zip(phrases.encode().split(b"\n"), n, strict=True))


def phrase_table(parts: DataFrame, min_count: int, longest: int = LONGEST, counters: int = MAX_COUNTERS, buckets: int = 1) -> DataFrame:
    """lang, phrase, f of the phrases of one to ``longest`` words with ``min_count`` occurrences.

    Counts are told in ``buckets`` by the phrase's hash, each packed by the telling task; a task that adds them up holds
    one bucket's different phrases.
    """
    filters: list[np.ndarray] = []
    for _ in range(longest):
        filters.append(next_filter(parts, filters, counters, min_count))
    told = parts.sparkSession.sparkContext.broadcast(filters)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, int, bytes]] = Counter()  # shards of one task are added up before they are told

        def done() -> pa.RecordBatch:
            dealt = defaultdict(list)
            for k in held:
                dealt[xxhash.xxh3_64_intdigest(k[2]) % buckets].append(k)
            out = pa.record_batch([pa.array(list(dealt), pa.int64()), pa.array([packed(held, keys) for keys in dealt.values()], pa.binary())], names=["bucket", "counts"])
            held.clear()
            return out

        for lang, shard in _each(batches):
            for phrases, n, cover in phrase_counts(shard, told.value):
                for phrase, c, m in zip(phrases, cover.tolist(), n.tolist(), strict=True):
                    held[lang, c, phrase] += m
            if len(held) > HELD:
                yield done()
        yield done()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, Counter()  # rows come sorted by bucket: one is held

        def done() -> pa.RecordBatch:
            lang, cover, phrase = zip(*held, strict=True)
            return pa.record_batch([pa.array(lang), pa.array([p.decode() for p in phrase]), pa.array(cover, pa.int32()), pa.array(list(held.values()), pa.int64())], names=["lang", "phrase", "cover", "n"])

        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != bucket and held:
                    yield done()
                    held.clear()
                bucket = k
                for key, n in unpacked(counts):
                    held[key] += n
        if held:
            yield done()

    told_rows = parts.mapInArrow(tidy(task), "bucket long, counts binary")
    counted = told_rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(add), "lang string, phrase string, cover int, n long")
    back = F.explode(F.sequence(F.lit(0), F.col("cover"))).alias("back")
    begin = F.when(F.col("back") == 0, F.col("phrase")).otherwise(F.expr("substring_index(phrase, ' ', size(split(phrase, ' ')) - back)"))
    each = counted.select("lang", "phrase", "n", back).select("lang", begin.alias("phrase"), "n")
    return each.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)


def mine(docs: DataFrame, min_count: int = 100, top: int = 2000, keep_share: int = 100, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", size: int = SHARD_WORDS, max_counters: int = MAX_COUNTERS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases; a phrase goes that a longer one holds with ``keep_share`` percent of its count or more."""
    parts = stored(shards(docs, text_col, lang_col, size), "shards", **{"parquet.block.size": str(16 << 20)})
    totals = parts.groupBy("lang").agg(F.sum(F.octet_length("ids") / 4).cast("long").alias("n"))
    words = parts.agg(F.sum(F.octet_length("ids") / 4).cast("long")).first()[0] or 0
    counters = min(max_counters, max(1 << 14, 1 << (max(words // 4, 1) - 1).bit_length()))
    table = stored(phrase_table(parts, min_count, longest, counters, words // BUCKET_WORDS + 1).withColumn("k", F.size(F.split("phrase", " "))), "phrases")
    candidates = table.where("k > 1").select("lang", "phrase", F.col("f").alias("a"), "k")
    # a phrase inside a longer one is also inside one of a word more, which is no rarer: its beginning or its end
    ends = F.explode(F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))).alias("phrase")
    longer = candidates.where("k > 2").select("lang", ends, F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < F.lit(keep_share) * F.col("a")))
    cuts = kept.drop("longer").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).withColumn("head", F.expr("substring_index(phrase, ' ', cut)")).withColumn("tail", F.expr("substring_index(phrase, ' ', cut - k)"))
    left, right = table.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), table.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "head"]).join(right, ["lang", "tail"]).join(totals, "lang")
    score = F.expr("cast(1000 * cast(a as decimal(18, 0)) * cast(n as decimal(16, 0)) as decimal(38, 0)) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    rows = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # each part of a language tells its own first ones, so that no task sorts a whole language
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "part")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(documents(spark, sf_dir))


#: The query's rows in SQL, every phrase of every place counted.
ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
w AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p WHERE len(ws) > 0),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, i, unnest(range(1, 6)) AS k FROM w) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
u AS (SELECT c.lang, c.phrase, c.a, n.n, x.cut, l.f AS l, r.f AS r, (1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) x JOIN c USING (lang, phrase) JOIN n USING (lang)
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.ws[:x.cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.ws[x.cut + 1:], ' ')),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2))) GROUP BY ALL),
s AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM q WHERE rank <= 2000
"""
