"""Token counts by a map-side two-tier lookup.

A byte-level vocabulary splits a text into pre-tokens and encodes each of them alone, so a text's number of tokens is a
sum over its pre-tokens. The first tier is a compact hash table of the most frequent pre-tokens of up to 16 bytes and
their numbers of tokens, broadcast to all tasks; the second is a bounded cache in each worker for what the table lacks,
which the tokenizers library fills. Pre-tokens are never shuffled: each task of a first scan tells at most
``SUMMARY`` of its most frequent ones, and their sums choose the table. The table only saves time; counts don't depend
on it. Both scans are map-only and read whole texts, a piece of about ``PIECE`` bytes at a time.

Which characters are letters, numbers or white space is asked of the library itself, once for each character met, so
the split is the library's own. Texts that hold an added token's string (``<|endoftext|>``, say) go to the library
whole, and so does every text where the vocabulary is of another kind.

Defined results: null text counts as empty (no bytes, no tokens); texts of any length are read whole; repeated rows are
counted each, and a null id is kept; other columns are ignored, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import documents, kept, mix64, slices, text_buffer, tidy
from folio.llm.tokens import UnitEncoder

#: Entries of the broadcast table (about 40 bytes each), and of what each task tells.
TABLE, SUMMARY = 1 << 15, 1 << 13
#: Pre-tokens that a worker's cache holds; those that come later are encoded anew each time.
CACHE = 300_000
PIECE = 1 << 18
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes after a space that are, or may begin, white space: no text is cut in front of that space.
_SPACY = np.zeros(256, bool)
_SPACY[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first eight and the next eight bytes of each range, as numbers."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    n = ends - starts
    low = eight[starts].view("<u8").ravel() & _MASK[np.minimum(n, 8)]
    high = np.zeros(len(starts), np.uint64)
    more = np.flatnonzero(n > 8)
    high[more] = eight[starts[more] + 8].view("<u8").ravel() & _MASK[np.minimum(n[more] - 8, 8)]
    return low, high


def _place(low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(low ^ mix64(high + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


class LengthTable:
    """Open addressing from pre-tokens of up to 16 bytes, compared whole, to their numbers of tokens."""

    def __init__(self, entries: list[bytes], tokens: list[int]):
        self.slots = 1 << max(4, (2 * len(entries)).bit_length())
        self.low, self.high = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        self.size, self.tokens = np.zeros(self.slots, np.uint8), np.zeros(self.slots, np.uint8)  # a slot of size 0 is free
        ends = np.cumsum([len(e) for e in entries], dtype=np.int64)
        starts = ends - np.array([len(e) for e in entries], np.int64)
        low, high = packed(np.frombuffer(b"".join(entries), np.uint8), starts, ends)
        slot = (_place(low, high, ends - starts) & np.uint64(self.slots - 1)).astype(np.int64)
        for i, s in enumerate(slot.tolist()):
            while self.size[s]:
                s = (s + 1) & (self.slots - 1)
            self.low[s], self.high[s], self.size[s], self.tokens[s] = low[i], high[i], ends[i] - starts[i], tokens[i]

    def find(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The number of tokens of each pre-token, 0 where the table lacks it."""
        out = np.zeros(len(n), np.int64)
        live = np.flatnonzero(n <= 16)
        slot = (_place(low[live], high[live], n[live]) & np.uint64(self.slots - 1)).astype(np.int64)
        while len(live):
            size = self.size[slot]
            hit = (size == n[live]) & (self.low[slot] == low[live]) & (self.high[slot] == high[live])
            out[live[hit]] = self.tokens[slot[hit]]
            go = (size > 0) & ~hit
            live, slot = live[go], (slot[go] + 1) & (self.slots - 1)
        return out


class PreTokens:
    """The split of a byte-level vocabulary file, and the library's counts of single pre-tokens with a bounded cache."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.splits = UnitEncoder._kind(spec) == "led"
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.limit, self.cache = cache, {}

    def _learn(self, points: np.ndarray) -> None:
        """The classes of characters, by what the library leaves together with a letter, a number or a sign."""
        pre = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for c in points.tolist():
            kind = SPACE
            for k, lead in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
                if len(pre(lead + chr(c))) == 1:
                    kind = k
                    break
            self.classes[c] = kind

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pre-tokens of all texts (one buffer) with a last bound, and the first pre-token of each text."""
        if not len(data):
            return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        points = data if len(at) == len(data) else np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        kind = self.classes[points]
        if (kind == UNKNOWN).any():
            self._learn(np.unique(points[kind == UNKNOWN]))
            kind = self.classes[points]
        n = len(points)
        first = np.zeros(n + 1, bool)  # where a text begins
        first[np.searchsorted(at, offsets)] = True
        space, blank = kind == SPACE, points == 32
        begin = first[:n].copy()
        begin[1:] |= kind[1:] != kind[:-1]
        led = np.zeros(n, bool)  # a space in front of anything else of its text
        led[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
        begin[1:] &= ~(led[:-1] & blank[:-1])  # one space belongs to what follows
        begin |= led  # and the last white space of a run is parted from those before
        mark = np.flatnonzero(begin[: n - 1] & (points[: n - 1] == 39) & ~first[1:n])
        if len(mark):
            # a short form after an apostrophe: one letter of s t m d, or re ve ll
            one = np.isin(points[mark + 1], np.frombuffer(b"stmd", np.uint8))
            two = np.zeros(len(mark), bool)
            room = np.flatnonzero(mark + 2 < n)
            room = room[~first[mark[room] + 2]]
            pair = points[mark[room] + 1].astype(np.int64) * 256 + points[mark[room] + 2]
            two[room] = np.isin(pair, [a * 256 + b for a, b in (b"re", b"ve", b"ll")])
            for m, size in ((mark[one], 2), (mark[two], 3)):
                begin[m + 1] = False
                after = m + size
                begin[after[after < n]] = True
        starts = np.concatenate([at[begin], [len(data)]])
        return starts, np.searchsorted(starts, offsets)

    def encoded(self, words: list[bytes]) -> list[int]:
        """The number of tokens of each pre-token: from the cache, else from the library."""
        new = list({w for w in words if w not in self.cache})
        counts = {}
        if new:
            counts = {w: len(e.ids) for w, e in zip(new, self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True)}
            for w in new[: max(0, self.limit - len(self.cache))]:
                self.cache[w] = counts[w]
        return [counts[w] if w in counts else self.cache[w] for w in words]

    def special(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """The texts that hold an added token's string."""
        raw, found = data.tobytes(), set()
        for t in self.added:
            k = raw.find(t)
            while k >= 0:
                row = int(np.searchsorted(offsets, k, "right")) - 1
                if k + len(t) <= offsets[row + 1]:
                    found.add(row)
                    k = raw.find(t, int(offsets[row + 1]))
                else:
                    k = raw.find(t, k + 1)
        return sorted(found)

    def counts(self, data: np.ndarray, offsets: np.ndarray, table: LengthTable | None) -> np.ndarray:
        """The number of tokens of each text."""
        out = np.zeros(len(offsets) - 1, np.int64)
        whole = self.special(data, offsets) if self.splits else range(len(out))
        raw = data.tobytes() if len(whole) else b""
        bounds, row = pieces(data, offsets)
        for a, b in slices(bounds, PIECE) if self.splits else ():
            own, base = data[bounds[a] : bounds[b]], bounds[a]
            starts, first = self.split(own, bounds[a : b + 1] - base)
            ends, starts = starts[1:], starts[:-1]
            low, high = packed(own, starts, ends)
            n = table.find(low, high, ends - starts) if table else np.zeros(len(starts), np.int64)
            missed = np.flatnonzero(n == 0)
            text = own.tobytes()
            n[missed] = self.encoded([text[i:j] for i, j in zip(starts[missed].tolist(), ends[missed].tolist(), strict=True)])
            total = np.concatenate([[0], np.cumsum(n)])
            np.add.at(out, row[a:b], total[first[1:]] - total[first[:-1]])
        for i in whole:
            out[i] = len(self.tokenizer.encode(raw[offsets[i] : offsets[i + 1]].decode(), add_special_tokens=False).ids)
        return out


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the texts and of pieces of the long ones, cut in front of a space that begins a pre-token; and each piece's text."""
    cuts, row = [], []
    for i in np.flatnonzero(np.diff(offsets) > 2 * limit).tolist():
        at, end = int(offsets[i]) + limit, int(offsets[i + 1])
        while at < end - 1:
            own = data[at : min(end, at + limit)]
            found = np.flatnonzero((own[:-1] == 32) & ~_SPACY[own[1:]])
            if len(found):
                cuts.append(at + int(found[0]))
                row.append(i)
            at += limit
    bounds = np.concatenate([offsets, np.array(cuts, np.int64)])
    order = np.argsort(bounds, kind="stable")
    of = np.concatenate([np.arange(len(offsets)), np.array(row, np.int64)])[order]
    return bounds[order], of[:-1]


def pre_tokens(path: str, cache: int = CACHE) -> PreTokens:
    """The worker's splitter for ``path``, made once."""
    return kept(("pre-tokens", path, cache), lambda: PreTokens(path, cache))


def frequent(docs: DataFrame, path: str, text_col: str = "text", size: int = TABLE) -> LengthTable:
    """The table of the ``size`` most frequent pre-tokens, as far as the tasks' summaries tell."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pre_tokens(path)
        known: dict[bytes, int] = {}
        for batch in batches if split.splits else ():
            data, offsets = text_buffer(batch.column(0))
            bounds, _ = pieces(data, offsets)
            for a, b in slices(bounds, PIECE):
                own = data[bounds[a] : bounds[b]]
                starts, _ = split.split(own, bounds[a : b + 1] - bounds[a])
                ends, starts = starts[1:], starts[:-1]
                short = ends - starts <= 16
                starts, ends = starts[short], ends[short]
                low, high = packed(own, starts, ends)
                _, at, n = np.unique(_place(low, high, ends - starts), return_index=True, return_counts=True)
                text = own.tobytes()
                for i, j, k in zip(starts[at].tolist(), ends[at].tolist(), n.tolist(), strict=True):
                    known[text[i:j]] = known.get(text[i:j], 0) + k
            if len(known) > 16 * SUMMARY:  # the rare ones go: they only choose the table
                known = dict(sorted(known.items(), key=lambda x: -x[1])[: 4 * SUMMARY])
        best = sorted(known.items(), key=lambda x: (-x[1], x[0]))[:SUMMARY]
        yield pa.record_batch([pa.array([w for w, _ in best], pa.binary()), pa.array([n for _, n in best], pa.int64())], names=["word", "n"])

    told = docs.select(text_col).mapInArrow(tidy(keeping(task)), "word binary, n long")
    best = told.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size).collect()
    words = [bytes(r["word"]) for r in best]
    counts = PreTokens(path, 0).encoded(words)
    fits = [(w, n) for w, n in zip(words, counts, strict=True) if n < 256]
    return LengthTable([w for w, _ in fits], [n for _, n in fits])


def keeping(task):
    """``task``, which keeps the worker's splitter."""
    task.keeps = True
    return task


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", size: int = TABLE, cache: int = CACHE) -> DataFrame:
    """One row per document: ``id_col``, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, text_col, size))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pre_tokens(path, cache)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            n = split.counts(data, offsets, table.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(tidy(keeping(task)), rows.select(id_col).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def brute_force(docs: list[tuple[int, str | None]], path: str, limit: int = 512) -> list[tuple[int, int, int, bool]]:
    """The query's rows by the library, text by text: for tests."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    out = []
    for d, t in docs:
        n = len(plain.encode(t or "", add_special_tokens=False).ids)
        out.append((d, len((t or "").encode()), n, n > limit))
    return out
