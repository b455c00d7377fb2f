"""Benchmark decontamination with a generalised suffix automaton.

The automaton is built over the normalised words of the test items (the state is reset between items, so no match
crosses from one into the next). Training words are streamed through it with the longest matching length tracked; where
that length reaches the window, the last words are an item window, and the state names the items that hold it.

Normalised: A-Z lower-cased, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. An automaton is built over ``max_words`` words of
items at most (an item is never cut, a longer one has its own), then kept as flat arrays with sorted transitions: about
60 bytes a word. A larger benchmark has several, built and stored by tasks. Documents pass them one after the other; those
that a worker holds together stay below ``max_bytes``, and the driver holds so many while it broadcasts them.

Defined results: null text has no words and an item without words never occurs; null ``item_id`` items are named
``null``; rows that repeat an item are each counted; repeated documents stay; texts of any length are read whole, word by
word; the columns that :func:`mark_hits` adds take the place of columns so named, :func:`decontaminate` keeps all columns;
empty tables give no row or no hit.
"""

from __future__ import annotations

import hashlib
import pickle
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import documents, stored, tidy

WINDOW = 8
#: Words of items that one automaton is built over, and bytes of automata that a worker holds together.
MAX_WORDS, MAX_BYTES = 250_000, 200 << 20
#: Bytes of a word and what follows it, by which items are dealt to tasks.
WORD_BYTES = 6
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class _Growing:
    """The automaton while words are added: a table of transitions for each state."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])

    def extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone


def _ints(values) -> array:
    return array("i", np.asarray(values, np.int32).tobytes())


class SuffixAutomaton:
    """Of all items' words, as flat arrays: what a match that ends in a state holds is found through the arrays too.

    ``first[v]`` to ``first[v + 1]`` are state v's transitions in ``word`` (sorted) and ``target``; ``root`` are those of
    the first state by word.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = k = window
        self.vocabulary: dict[bytes, int] = {}
        ids = [(name, array("i", [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws])) for name, ws in items if ws]
        self.names = [name for name, _ in ids]
        grown = _Growing()
        for _, ws in ids:
            last = 0
            for w in ws:
                last = grown.extend(last, w)
        counts = np.fromiter(map(len, grown.next), np.int64, len(grown.next))
        self.first = _ints(np.concatenate([[0], np.cumsum(counts)]))
        self.word, self.target = array("i"), array("i")
        for v, row in enumerate(grown.next):
            for w in sorted(row):
                self.word.append(w)
                self.target.append(row[w])
            grown.next[v] = None
        self.root = self.target[: len(self.vocabulary)]  # every word begins somewhere, so word w is the w-th
        self.link, self.length = grown.link, grown.length
        self._mark(ids, k)

    def step(self, v: int, w: int) -> int:
        """The state after ``w``, -1 where there is none."""
        if not v:
            return self.root[w]
        high = self.first[v + 1]
        j = bisect_left(self.word, w, self.first[v], high)
        return self.target[j] if j < high and self.word[j] == w else -1

    def _mark(self, ids: list[tuple[str, array]], k: int) -> None:
        link, length = self.link, self.length
        order = np.argsort(np.frombuffer(length, np.int32), kind="stable").tolist()
        #: The suffix-link ancestor that holds the last `window` words, where a state's longest string has them.
        self.base = array("i", [-1]) * len(length)
        ends: dict[int, set[int]] = {}
        for v in order[1:]:
            if length[v] >= k:
                self.base[v] = v if length[link[v]] < k else self.base[link[v]]
        state, item = array("i"), array("i")
        for i, (_, ws) in enumerate(ids):
            v = 0
            for at, w in enumerate(ws):
                v = self.step(v, w)
                if at + 1 >= k:
                    state.append(self.base[v])
                    item.append(i)
            if len(ws) < k:
                ends.setdefault(v, set()).add(i)
        # the items of each window: of state u, item[held[u]] to item[held[u + 1]]
        pairs = np.unique(np.frombuffer(state, np.int32).astype(np.int64) << 32 | np.frombuffer(item, np.int32)) if len(state) else np.zeros(0, np.int64)
        self.item = _ints(pairs & 0xFFFFFFFF)
        self.held = _ints(np.searchsorted(pairs >> 32, np.arange(len(length) + 1)))
        #: Whole short items that end a state's strings, and each state's nearest ancestor (itself first) with such.
        self.shorts = {v: (len(ids[min(who)][1]), sorted(who)) for v, who in ends.items()}
        self.short = array("i", [0]) * len(length)
        if ends:
            for v in order[1:]:
                self.short[v] = v if v in ends else self.short[link[v]]

    def nbytes(self) -> int:
        """Of the arrays and, roughly, of the words and names."""
        arrays = (self.first, self.word, self.target, self.root, self.link, self.length, self.base, self.item, self.held, self.short)
        return sum(x.itemsize * len(x) for x in arrays) + 150 * len(self.vocabulary) + 60 * len(self.names) + 300 * len(self.shorts)

    def scan(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit runs [from, to) of word places, and the items whose windows occur. Unknown words are negative."""
        first, word, target, root, link, length, base, k = self.first, self.word, self.target, self.root, self.link, self.length, self.base, self.window
        short, shorts = self.short, self.shorts
        v, m, who, runs, states = 0, 0, set(), [], set()
        for i, w in enumerate(ids):
            if w < 0:
                v = m = 0
                continue
            while v:
                high = first[v + 1]
                j = bisect_left(word, w, first[v], high)
                if j < high and word[j] == w:
                    v = target[j]
                    m += 1
                    break
                v = link[v]
                m = length[v]
            else:
                v, m = root[w], 1
            if m >= k:
                states.add(base[v])
                runs.append((i - m + 1, i + 1))
            u = short[v] if shorts else 0
            longest = m < k
            while u:
                n, items = shorts[u]
                if n <= m:
                    if longest:
                        runs.append((i - n + 1, i + 1))
                        longest = False
                    who.update(items)
                u = short[link[u]]
        for s in states:
            who.update(self.item[self.held[s] : self.held[s + 1]])
        return runs, who


def automata(benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS, id_col: str = "item_id", text_col: str = "text") -> Iterator[SuffixAutomaton]:
    """The benchmark's automata. Tasks build them over their items and store them; they come to the driver one at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    chars = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    tasks = max(1, -(-int(chars) // (WORD_BYTES * max_words)))  # about as many as automata, so that a small benchmark has one

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array([pickle.dumps(SuffixAutomaton(held, window))], pa.binary())], names=["automaton"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = words(t)
                if held and size + len(ws) > max_words:
                    yield done()
                    held, size = [], 0
                if ws:
                    held.append((i if i is not None else "null", ws))
                    size += len(ws)
        if held:
            yield done()

    dealt = items.coalesce(1) if tasks == 1 else items.repartition(tasks)
    made = stored(dealt.mapInArrow(tidy(build), "automaton binary"), "automata", **{"parquet.block.size": str(16 << 20)})
    for r in made.toLocalIterator():
        yield pickle.loads(bytes(r["automaton"]))


def _groups(made: Iterator[SuffixAutomaton], max_bytes: int) -> Iterator[list[SuffixAutomaton]]:
    """Automata that a worker holds together: below ``max_bytes``, one at least."""
    held, size = [], 0
    for one in made:
        if held and size + one.nbytes() > max_bytes:
            yield held
            held, size = [], 0
        held.append(one)
        size += one.nbytes()
    if held:
        yield held


def mark_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", max_words: int = MAX_WORDS, max_bytes: int = MAX_BYTES, cut_hits: bool = False,
    added: tuple[str, str, str] = ("n_words", "hits", "items"),
) -> DataFrame:
    """``docs`` with the columns ``added``: number of words, word runs [from, to) inside item windows (merged) and ids of the items.

    With ``cut_hits`` the texts lose the hit words.
    """
    columns = [c for c in docs.columns if c not in added]
    n_col, hits_col, items_col = added
    out = docs.select(*columns).withColumn(n_col, F.lit(0).cast("long")).withColumn(hits_col, F.array().cast("array<array<long>>")).withColumn(items_col, F.array().cast("array<string>"))
    spark = docs.sparkSession
    told = [spark.sparkContext.broadcast(group) for group in _groups(automata(benchmark, window, max_words), max_bytes)] or [spark.sparkContext.broadcast([SuffixAutomaton([], window)])]
    for k, one in enumerate(told):

        def task(batches: Iterator[pa.RecordBatch], one=one, last=k == len(told) - 1) -> Iterator[pa.RecordBatch]:
            made = [(sa, sa.vocabulary.get, sa.names) for sa in one.value]
            for batch in batches:
                n_words, hits, items = [], [], []
                texts = batch.column(text_col).to_pylist()
                for t, runs, who in zip(texts, batch.column(hits_col).to_pylist(), batch.column(items_col).to_pylist(), strict=True):
                    ws = words(t)
                    for sa, get, names in made:
                        found, whose = sa.scan([get(w, -1) for w in ws])
                        runs += found
                        who += [names[k] for k in whose]
                    merged: list[list[int]] = []
                    for s, e in sorted(map(tuple, runs)) if runs else ():
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    n_words.append(len(ws))
                    hits.append(merged)
                    items.append(who)
                own = {c: batch.column(c) for c in columns}
                if cut_hits and last:
                    own[text_col] = pa.array([cut(t, h) if h else t for t, h in zip(texts, hits, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*own.values(), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))], names=[*columns, *added])

        out = out.mapInArrow(tidy(task), out.schema)
    return out


def cut(text: str | None, hits: list[list[int]]) -> str:
    """``text`` without the hit words, white space around a cut left as one run."""
    data = (text or "").encode()
    flat = data.translate(_TABLE)
    buf = np.frombuffer(flat, np.uint8) != 32
    edge = np.diff(np.concatenate([[0], buf.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for s, e in hits:
        out.append(data[at : starts[s]])
        at = ends[e - 1]
    return b"".join([*out, data[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_items: int = 1, max_coverage: float = 0.5, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """Cuts every hit run out of the texts; drops documents with windows of more than ``max_items`` items, or with more than ``max_coverage`` of their words hit. Columns stay as they are."""
    n_words, hits, items = added = ("__folio_words", "__folio_hits", "__folio_items")
    marked = mark_hits(docs, benchmark, window, text_col, cut_hits=True, added=added)
    n_hit = F.aggregate(hits, F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    return marked.where((F.size(items) <= max_items) & (n_hit <= max_coverage * F.col(n_words))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = mark_hits(docs.select("doc_id", "text"), bench)
    names = F.array_sort("items")
    return marked.select(
        "doc_id", "n_words", F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0]).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"),
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The query's rows by comparing every window: for tests."""
    out = []
    for doc_id, text in docs:
        ws, hit, who = words(text), set(), []
        for item, t in items:
            iw = words(t)
            wins = {tuple(iw[i : i + min(window, len(iw))]) for i in range(len(iw) - min(window, len(iw)) + 1)} if iw else set()
            k = min(window, len(iw))
            at = [i for i in range(len(ws) - k + 1) if tuple(ws[i : i + k]) in wins] if iw else []
            if at:
                who.append(str(item))
                hit |= {j for i in at for j in range(i, i + k)}
        out.append((doc_id, len(ws), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), len(who) >= 2))
    return out


#: The query's rows in SQL, every window compared.
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, ws, least(8, len(ws)) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark) WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT item_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM b)),
u AS (SELECT DISTINCT n, k FROM w),
p AS (SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT rid, ws, unnest(range(1, 9)) AS n FROM d) WHERE n IN (SELECT n FROM u))),
m AS (SELECT rid, i, n, k FROM p SEMI JOIN u USING (n, k)),
h AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM m JOIN w USING (n, k)) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
