"""Edge cases of each operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from folio.llm import chat, decontaminate, language, lines, packing, quality, queries, simhash, substrings, suffixes, token_files, tokens
from folio.llm.common import scratch, text_buffer
from folio.llm.components import components
from folio.llm.tokens import UnitEncoder, encoded
from tests.oracle import compare

DOCS = "doc_id long, text string"


def path(name):
    return pytest.importorskip("public_tokenizers").path(name)


def words(n, seed, vocabulary=5000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


PASSAGE = words(70, 99)
HARD = [
    (1, f"start {PASSAGE} end one"), (2, None), (3, ""), (4, f"other {words(300, 4)} {PASSAGE} {words(80, 5)}"), (5, f"other {words(300, 4)} {PASSAGE} {words(80, 5)}"),
    (6, "é ü ß " * 200), (7, "a" * 3000), (8, words(20_000, 8)), (9, PASSAGE), (10, PASSAGE), (10, PASSAGE), (None, PASSAGE), (11, "!!! ... ???"), (12, "x\n" * 40 + "tail"),
    (13, words(300, 4) + " " + words(90, 13)), (14, (words(12, 14) + " ") * 30),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def table(spark, sf_dir, name):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    compare(spark, sf_dir, name, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("units", [20, 100_000])
def test_units_equal_the_library(file, units):
    from tokenizers import Tokenizer

    plain, enc = Tokenizer.from_file(path(file)), UnitEncoder(path(file), units)
    r = random.Random(1)
    texts = [t for _, t in HARD] + ["".join(r.choice(" \n\t abc'sA1é.!\x1ć\0 ") for _ in range(r.randrange(15))) for _ in range(2000)] + ["<|endoftext|> x", "don't  'S"]
    for a, b, ids, counts in encoded(enc, *text_buffer(pa.array(texts)), limit=2000):
        ends = np.concatenate([[0], np.cumsum(counts)])
        for i in range(a, b):
            assert ids[ends[i - a] : ends[i - a + 1]].tolist() == plain.encode(texts[i] or "", add_special_tokens=False).ids


@pytest.mark.parametrize("ids", [[], [5], [0, 2**32 - 1], list(range(1000)), [7] * 256 + [9] * 3, [1] * 250 + [2**31] * 6])
def test_blocks_round_trip(ids):
    x = np.array(ids, np.uint32)
    f = token_files.TokenFile(token_files.to_bytes([3, None], np.array([len(x), 0]), x))
    assert f.ids().tolist() == ids
    for a, b in [(0, 1), (200, 300), (255, 257), (5, 5)]:
        assert f.ids(a, b).tolist() == ids[a:b]


def test_a_broken_file_is_refused():
    data = bytearray(token_files.to_bytes([1], np.array([3]), np.array([1, 2, 3], np.uint32)))
    data[60] ^= 1
    with pytest.raises(ValueError):
        token_files.TokenFile(bytes(data))


def test_token_files(spark, hard, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path("word_bpe_49k.json"))
    rows = token_files.token_table(hard.withColumn("start", hard.doc_id), path("word_bpe_49k.json")).orderBy("start").collect()
    want, start = [], 0
    for d, t in sorted(HARD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == want
    assert token_files.token_table(empty, path("word_bpe_49k.json")).count() == 0


def check_packing(rows, capacity=1024):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for seq in by.values():
        at = 0
        for o, n in sorted(seq):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing(spark, hard, empty, sf_dir):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = packing.pack(hard, path("byte_bpe_50k.json")).collect()
    n = check_packing(rows)
    want = Counter()
    for d, t in HARD:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert n <= -(-sum(r.length for r in rows) // 1024) + 2
    assert packing.pack(empty, path("byte_bpe_50k.json")).count() == 0


def test_packing_shuffles_pieces_only_where_the_sums_are_many(spark, hard, empty):
    file = path("byte_bpe_50k.json")
    told, joined = packing.pack(hard, file), packing.pack(hard, file, told=0)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (told, joined)]
    assert "Exchange" not in plans[0] and "Exchange" in plans[1]
    both = [df.collect() for df in (told, joined)]
    assert check_packing(both[0]) == check_packing(both[1])
    assert len(both[0]) > len(HARD)
    pieces = [Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) for rows in both]
    assert pieces[0] == pieces[1]
    assert packing.pack(empty, file, told=0).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_are_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = (rng.lognormal(6.2, 1, 20_000).astype(int) % 1024) + 1
    hist = dict(zip(*np.unique(lengths, return_counts=True), strict=True))
    rows, n = packing.plan(hist)
    used = np.zeros(n, int)
    for length, _, items, first, _ in rows:
        used[first : first + items] += length
    assert used.max() <= 1024 and used.sum() == lengths.sum() and n <= 1.005 * (-(-lengths.sum() // 1024))


def test_simhash_fingerprints_and_links(spark, hard, empty):
    import xxhash

    def plain(text):
        ws = [w for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        if not ws:
            return 0
        s = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
        hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    rows = simhash.near_duplicates(hard).collect()
    assert len(rows) == len(HARD)
    fps = Counter((d, plain(t)) for d, t in HARD)
    assert Counter((r.doc_id, r.fp % 2**64) for r in rows) == fps
    groups = {}
    nodes = list({f for _, f in fps})
    root = {f: f for f in nodes}
    for _ in nodes:
        for a in nodes:
            for b in nodes:
                if (a ^ b).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    for d, f in fps:
        if d is not None:
            groups[root[f]] = min(groups.get(root[f], d), d)
    assert all(r.component_id == groups.get(root[r.fp % 2**64]) for r in rows)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_first(hard.withColumn("component_id", hard.doc_id)).select("doc_id").collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in rows if r.doc_id == r.component_id} | {None}


@pytest.mark.parametrize("radius", [0, 1, 2, 7, 8, 24])
def test_counters_find_the_radius(radius):
    r = random.Random(radius)
    fps = []
    for base in (r.getrandbits(64) for _ in range(4)):
        for k in (0, 1, 2, 3, 7, 8, 9, 24, 25, 40):
            x = base
            for j in r.sample(range(64), k):
                x ^= 1 << j
            fps.append(x)
    planes = simhash._planes(np.array(fps, np.uint64))
    for d in range(1, len(fps)):
        got = simhash._lanes(len(fps), simhash.near(planes, d, (1 << len(fps) - d) - 1, radius)).tolist()
        assert got == [i for i in range(len(fps) - d) if (fps[i] ^ fps[i + d]).bit_count() <= radius]


@pytest.mark.parametrize("split", [1024, 3])
def test_links_join_all_pairs_in_the_radius(spark, split):
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(60)}
    for _ in range(3):
        fps |= {f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for f in r.sample(sorted(fps), 50)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    got = {x.node % 2**64: x.root % 2**64 for x in components(simhash.links(df, split=split)).collect()}
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    classes = {}
    for f in fps:
        classes.setdefault(label[f], set()).add(got.get(f, f))
    assert all(len(v) == 1 for v in classes.values()) and len({next(iter(v)) for v in classes.values()}) == len(classes)


def test_line_dedup(spark, empty):
    rows = [(i, f" Same Line\t\nown {i}\n\nsame line") for i in range(12)] + [(None, "SAME LINE\nx"), (20, None), (21, "é same line"), (3, " Same Line\t\nown 3\n\nsame line")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_lines", pa_lit("clash"))
    got = {(r.doc_id, r.text): (r.n_lines, r.n_dropped) for r in lines.drop_lines(docs).collect()}
    assert got[(0, "own 0\n")] == (4, 2) and got[(None, "x")] == (2, 1) and got[(20, "")] == (1, 0) and got[(21, "é same line")] == (1, 0)
    first = {r.doc_id: r.text for r in lines.drop_lines(docs, keep_first=True).collect()}
    assert first[0] == " Same Line\t\nown 0\n" and first[1] == "own 1\n"
    full = {(r.doc_id, r.text) for r in lines.drop_lines(docs, max_bits=1 << 16).collect()}
    assert full == set(got)
    assert lines.drop_lines(empty).count() == 0


def plain_fingerprint(text):
    import xxhash

    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_query(spark, sf_dir):
    docs = [(r[0], r[1]) for r in table(spark, sf_dir, "documents")]
    fps = {d: plain_fingerprint(t) for d, t in docs}
    root = {f: f for f in fps.values()}
    for a in list(root):
        for b in list(root):
            if (a ^ b).bit_count() <= 2 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    least = {}
    for d, f in fps.items():
        least[root[f]] = min(least.get(root[f], d), d)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.query(spark, sf_dir).collect()}
    assert got == {(d, f"{f:016x}", least[root[f]]) for d, f in fps.items()}


def test_token_queries(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = sorted((r[0], r[1]) for r in table(spark, sf_dir, "documents"))
    plain = Tokenizer.from_file(path("word_bpe_49k.json"))
    want, start = [], 0
    for d, t in docs:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.query(spark, sf_dir).collect()) == want
    plain = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = []
    for d, t in docs:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rows = packing.query(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert check_packing(rows) <= -(-sum(r.length for r in rows) // 1024) + 3


def test_quality_query(spark, sf_dir):
    docs = dict((r[0], r[1]) for r in table(spark, sf_dir, "documents"))
    rows = quality.query(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id] or "")
        tri = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
        rep = len({j for i in range(len(ws) - 2) if tri[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})
        ls = [x for x in (docs[r.doc_id] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(ws), sum(map(len, ws)), len(ls) - len(set(ls)), rep)
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", docs[r.doc_id] or "")) and r.base_failed == (len(ws) < 50 or 100 * rep > 50 * len(ws))
        assert r.kept in (True, False) and not (r.kept and r.base_failed)


def test_copies_of_one_text_are_dealt_out(spark):
    rows = [(i, f"menu\nown {i % 3}\n" + ("copy" if i % 4 else str(i))) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    got = {r.doc_id: r.text for r in lines.drop_lines(docs).collect()}
    assert got == {i: t.split("\n")[2] if i % 4 == 0 else "" for i, t in rows}


def pa_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_chat(spark):
    texts = [chat.HARD, "", "a\\", "\\", "###", " </turn>", "x </turn>\n### user: y", "é"]
    rows = [(c, t, r, x) for c, xs in enumerate([texts, texts[::-1]]) for t, x in enumerate(xs) for r in [("user", "assistant", "as: s\\")[t % 3]]]
    rows += [(None, 0, "assistant", "lost"), (5, 1, None, None), (5, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert len(got) == 4
    for c in (0, 1, 5, None):
        turns = [(r or "", x or "") for k, t, r, x in sorted((row for row in rows if row[0] == c), key=lambda y: y[1])]
        assert chat.parse(got[c].formatted) == turns
        assert [chat.unescape(got[c].formatted[s:e]) for s, e in got[c].loss] == [x for r, x in turns if r == "assistant"]
        assert not got[c].rewrites
    assert chat.format_conversations(df.where("false")).count() == 0


def test_templates_that_rewrite_history_are_found():
    def forgets(turns):  # earlier answers are shortened
        return "".join(f"<{r}>{t if i == len(turns) - 1 or r != 'assistant' else t[:1]}|" for i, (r, t) in enumerate(turns))

    out, _, text, rewrites = chat.spans([("user", "q"), ("assistant", "long"), ("user", "r"), ("assistant", "last")], forgets)
    assert rewrites and out[slice(*text[3])] == "last" and out[slice(*text[0])] == "q"


ITEMS = [(1, words(20, 50)), (2, words(20, 50)), (3, "Short Item"), (4, None), (5, "..."), (None, words(9, 51)), (7, "item")]


def test_decontamination(spark, hard, empty):
    docs = HARD + [(30, f"x {words(20, 50)[8:]} y"), (31, f"a SHORT, item b {words(9, 51).upper()}"), (32, words(20, 50) * 2)]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame(docs, DOCS)
    plain = decontaminate.brute_force(docs, [("null" if i is None else i, t) for i, t in ITEMS])
    for limit in ({}, {"max_words": 10}, {"max_words": 10, "max_bytes": 1}):  # one automaton, one for each item, each in a pass of its own
        marked = decontaminate.mark_hits(df, bench, **limit).collect()
        got = [(r.doc_id, r.n_words, sum(e - s for s, e in r.hits), len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest(), len(r["items"]) >= 2) for r in marked]
        assert sorted(got, key=str) == sorted(plain, key=str)
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(df, spark.createDataFrame([(1, words(20, 50))], "item_id long, text string"), max_coverage=0.95).collect()}
    assert cut[1] == HARD[0][1] and words(20, 50)[30:] not in cut[30] and 32 not in cut
    clash = decontaminate.decontaminate(df.withColumn("hits", pa_lit("own")).withColumn("n_words", df.doc_id), bench)
    assert clash.columns == ["doc_id", "text", "hits", "n_words"] and {r.hits for r in clash.collect()} == {"own"}
    assert decontaminate.mark_hits(empty, bench).count() == 0
    assert decontaminate.mark_hits(hard, bench.where("false")).where("size(hits) > 0").count() == 0


@pytest.mark.parametrize("window", [3, 8])
def test_automaton_against_all_windows(window):
    r = random.Random(window)
    items = [(str(i), " ".join(r.choice("abc") for _ in range(r.randrange(14)))) for i in range(12)]
    texts = [(i, " ".join(r.choice("abcd") for _ in range(r.randrange(60)))) for i in range(60)]
    sa = decontaminate.SuffixAutomaton([(n, decontaminate.words(t)) for n, t in items], window)
    for row, (_, text) in zip(decontaminate.brute_force(texts, items, window), texts, strict=True):
        runs, who = sa.scan([sa.vocabulary.get(w, -1) for w in decontaminate.words(text)])
        assert len({j for s, e in runs for j in range(s, e)}) == row[2] and len(who) == row[3]


def test_automata_are_flat():
    """Some hundred thousand words of items, held in far fewer bytes than tables of Python objects take."""
    items = [(str(i), words(500, i, 20_000).encode().split()) for i in range(200)]
    sa = decontaminate.SuffixAutomaton(items)
    assert sa.nbytes() < 100 * 100_000 and len(__import__("pickle").dumps(sa)) < sa.nbytes()
    text = items[7][1][100:300] + [b"none"] + items[9][1][:20]
    runs, who = sa.scan([sa.vocabulary.get(w, -1) for w in text])
    assert {7, 9} <= who and {j for s, e in runs for j in range(s, e)} >= set(range(200)) | set(range(201, 221))


def test_benchmark_table(spark, sf_dir):
    docs, items = ([(r[0], r[1]) for r in table(spark, sf_dir, t)] for t in ("documents", "benchmark"))
    assert sorted(map(tuple, decontaminate.query(spark, sf_dir).collect())) == sorted(decontaminate.brute_force(docs, items))


def test_quality_counts(spark, hard, empty):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, None), (99, 0), (None, 1)], "doc_id long, quality int")
    out, rules = quality.judge(hard, labels)
    got = Counter(tuple(r[c] for c in ("doc_id", *quality.BASE, "base_failed")) for r in out.collect())
    want = Counter()
    for d, t in HARD:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        n = Counter(tri)
        rep = len({j for i, x in enumerate(tri) if n[x] > 1 for j in (i, i + 1, i + 2)})
        ls = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[(d, len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), rep, len(ws) < 50 or 100 * rep > 50 * len(ws))] += 1
    assert got == want and rules == []
    assert quality.judge(empty, labels)[0].count() == 0


def test_rules_are_learned(spark):
    r = random.Random(1)
    rows = [(i, " ".join(("#" if i % 4 == 0 and r.random() < 0.3 else "") + w for w in words(80, i).split())) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)], "doc_id long, quality int")
    out, rules = quality.judge(spark.createDataFrame(rows, DOCS), labels)
    assert rules and sum(x.kept == (x.doc_id % 4 != 0) for x in out.collect()) >= 390  # cut points are quantiles


def test_quality_is_native(spark, hard):
    plan = quality.statistics(hard)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_language(spark, sf_dir, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.query(spark, sf_dir).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    model = language.train(docs)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", None), (3, "12 ... !", "x"), (4, "²", "x"), (5, "a", "x"), (6, "the of " * 30_000, "x")], "doc_id long, text string, score string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 4)) and got[5][0] in model.languages and got[6][0] == "en"
    assert language.identify(empty, model).count() == 0
    none = language.train(docs.where("lang is null"))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}


def test_posteriors_equal_enumeration():
    rng = np.random.default_rng(2)
    crf = language.Crf(["a", "b", "c"])
    crf.trans = rng.normal(size=(3, 3))
    scores = rng.normal(size=(5, 3))
    crf.table = np.exp(scores).astype(np.float32)
    sums = np.zeros(3)
    total = 0.0
    for y in np.ndindex(*(3,) * 5):
        p = np.exp(scores[range(5), y].sum() + sum(crf.trans[i, j] for i, j in zip(y, y[1:], strict=False)))
        total += p
        sums += p * np.bincount(y, minlength=3)
    both = crf._posterior_sums([np.arange(5), np.arange(3)], np.array([5, 3]))
    assert np.allclose(both[0], sums / total, atol=1e-4)
    assert np.allclose(language.forward_backward(scores[:, None], crf.trans).sum(axis=0)[0], sums / total)


@pytest.mark.parametrize("operator", [substrings, suffixes])
def test_repeats(spark, sf_dir, hard, empty, operator):
    docs = [(r[0], r[1]) for r in table(spark, sf_dir, "documents")]
    assert sorted(map(tuple, operator.query(spark, sf_dir).collect())) == sorted(operator.brute_force(docs))
    assert operator.remove_repeats(empty).count() == 0
    known = [x for x in HARD if x[0] is not None]
    got = operator.remove_repeats(hard).where("doc_id is not null").collect()
    own = HARD if operator is suffixes else known
    want = Counter((r[0], r[1], r[2]) for r in operator.brute_force(own) if r[0] is not None)
    assert Counter((r.doc_id, r.n_words if operator is substrings else r.n_bytes, r.n_removed) for r in got) == want


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += other(s)
    return s


def other(s):
    return s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("weak", [False, True])
def test_units_whose_hashes_could_collide(file, weak, monkeypatch):
    """Long words of a pattern that cancels in polynomial hashes; and any words where all hashes collide."""
    from tokenizers import Tokenizer

    if weak:
        monkeypatch.setattr(tokens, "lane_hashes", lambda values, n, length: (length % 3).astype(np.uint64))
    texts = [f"x {thue_morse(n)} y {other(thue_morse(n))} the cat" for n in (512, 1024, 2048)] * 2 + ["the dog", "dog cat the"]
    plain, enc = Tokenizer.from_file(path(file)), UnitEncoder(path(file), 1000)
    for _ in range(2):
        for a, b, ids, counts in encoded(enc, *text_buffer(pa.array(texts)), limit=600):
            ends = np.concatenate([[0], np.cumsum(counts)])
            for i in range(a, b):
                assert ids[ends[i - a] : ends[i - a + 1]].tolist() == plain.encode(texts[i], add_special_tokens=False).ids


@pytest.mark.parametrize("max_units", [2000, 3, 0])
@pytest.mark.parametrize("operator", [substrings, suffixes])
def test_hot_anchors(spark, operator, max_units):
    """A passage in very many texts, near copies, rows that repeat, and words of colliding patterns; small limits part the groups."""
    r = random.Random(5)
    passage = words(90, 99)
    frame = [" ".join(f"{c}{i}" for i in range(40)) for c in "uv"]
    docs = [(i, f"{frame[0]} {x} {frame[1]}") for i, x in enumerate([thue_morse(1024), other(thue_morse(1024))])] + [(2, thue_morse(2048)), (3, "z" + other(thue_morse(2048)))]
    docs += [(100 + i, words(r.randrange(5, 60), i) + "\t " + passage + ("  " if i % 2 else "\n") + words(r.randrange(5, 60), i + 900)) for i in range(60)]
    docs += [(300 + i // 2, passage) for i in range(20)] + [(400, None), (401, ""), (402, (words(20, 5) + " ") * 40), (403, "z" * 2000)]
    for i in range(60):
        ws = passage.split() * 3
        for _ in range(r.randrange(4)):
            ws[r.randrange(len(ws))] = f"e{r.randrange(9)}"
        docs.append((500 + i, " ".join(ws)))
    df = spark.createDataFrame(docs, DOCS).repartition(5).withColumn("rid", pa_lit("clash")).withColumn("n_removed", pa_lit("clash"))
    got = Counter((x.doc_id, x.n_words if operator is substrings else x.n_bytes, x.n_removed) for x in operator.remove_repeats(df, max_units=max_units).collect())
    assert got == Counter(x[:3] for x in operator.brute_force(docs))


@pytest.mark.parametrize("buckets", [2048, 2, 5])
def test_suffix_arrays(buckets, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKETS", buckets)
    rng = np.random.default_rng(0)
    for n, k in [(1, 2), (2, 1), (60, 1), (60, 2), (400, 3), (3000, 2), (3000, 40)]:
        t = rng.integers(0, k, n)
        again = np.tile(t[: n // 10 + 1], 10)
        changed = np.where(rng.random(len(again)) < 0.002, 0, again)
        for x in (t, again, changed):
            b = bytes(x.astype(np.uint8))
            assert suffixes.suffix_array(x).tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    texts = [bytes(rng.integers(97, 100, rng.integers(0, 60)).astype(np.uint8)) for _ in range(200)]
    seen = Counter(x[i : i + 8] for x in texts for i in range(len(x) - 7))
    want = [[i for i in range(len(x) - 7) if seen[x[i : i + 8]] > 1] for x in texts]
    assert [g.tolist() for g in suffixes.repeated_starts(texts, 8)] == want


def test_every_suffix_is_induced(monkeypatch):
    """Any number of names goes through the recursion: the texts of a shard are sorted by nothing else."""
    sizes = []
    induce = suffixes._induce
    monkeypatch.setattr(suffixes, "_induce", lambda t, *rest: sizes.append((len(t), int(t.max()) + 1)) or induce(t, *rest))
    t = np.frombuffer(" ".join(words(12, i % 900) for i in range(3000)).encode(), np.uint8)
    sa = suffixes.suffix_array(t)
    b = t.tobytes()
    assert len(np.unique(sa)) == len(b) and all(b[i : i + 200] <= b[j : j + 200] for i, j in zip(sa, sa[1:]))
    assert sizes[0][0] == len(t) + 1 and len({n for n, _ in sizes}) > 2 and max(k for _, k in sizes) <= 2049


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(None, 3), (4, 4)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        if a is not None:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(60):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_stars_take_one_round(spark):
    """Found components and new links are cheap: stars settle in one round, and a round takes no job for its numbers alone (22 jobs before)."""
    stars = spark.range(1, 5000).selectExpr("id AS a", "id % 10 AS b")
    spark.sparkContext.setJobGroup("stars", "components of stars")
    try:
        roots = components(stars)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("stars"))
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(name, None)
    assert 0 < jobs <= 15
    assert {(r.node, r.root) for r in roots.collect()} == {(i, i % 10) for i in range(10, 5000)}


def test_scratch_is_shared(spark):
    assert scratch(spark, "x") != scratch(spark, "x")


def test_language_reads_long_runs_whole():
    run = "abcdefghij" * 4 + "klmnopqrst" * 5
    pieces = language.letters(f"Ab {run} x")
    assert "".join(pieces) == f"ab{run}x" and max(map(len, pieces)) == 40
    german, french = "derundistnicht" * 20, "lesetdansavec" * 20
    model = language.Crf(["de", "fr"]).fit([("de", "der und ist nicht " * 20), ("fr", "les et dans avec " * 20)] * 5, sequences=400)
    assert model.predict([german[:40] + french])[0][0] == "fr" and model.predict([french[:40] + german])[0][0] == "de"


@pytest.mark.parametrize("in_words", [False, True])
@pytest.mark.parametrize("distinct", [1, 3, 50, 1 << 40])
def test_anchors_follow_from_the_window_alone(in_words, distinct, monkeypatch):
    """Whatever hashes tie, in part or as a whole: a window alone has the anchor that it has in a long text."""
    from folio.llm import anchors

    spec = anchors.Windows(50, 8, True) if in_words else anchors.Windows(400, 16, False)
    whole = anchors.gram_hashes
    monkeypatch.setattr(anchors, "gram_hashes", lambda x, size: whole(x, size) % np.uint64(distinct))
    x = np.random.default_rng(3).integers(0, 90, 60_000).astype(np.uint64)
    row, s, n, h, place = anchors.units(x, np.array([0, 7000, len(x)]), spec)
    hashes = anchors.gram_hashes(x, spec.gram)
    at, of = {}, {}
    for k in range(len(row)):
        for j in range(n[k]):
            at[(row[k], s[k] + j)], of[(row[k], s[k] + j)] = s[k] + place[k] - (s[k] + j), h[k]
    assert len(at) == len(x) - 2 * (spec.size - 1)
    for start in range(0, len(x) - spec.size + 1, 97):
        r = int(start >= 7000)
        if not r and start + spec.size > 7000:
            continue
        own = hashes[start : start + spec.size - spec.gram + 1]
        assert at[(r, start - 7000 * r)] == own.argmin() and of[(r, start - 7000 * r)] == own.min()
        alone = anchors.units(x[start : start + spec.size], np.array([0, spec.size]), spec)
        assert (alone[3][0], alone[4][0]) == (own.min(), own.argmin())


def half_collision(size=400, gram=16, upper=39):
    """A text of ``size`` letters whose two least grams by hash agree in their upper bits, the later one the least."""
    from folio.llm import anchors

    rng = np.random.default_rng(7)
    letters = rng.integers(97, 123, (6_000_000, gram)).astype(np.uint8)
    with np.errstate(over="ignore"):
        h = anchors.mix64(anchors.mix64(((letters.astype(np.uint64) + np.uint64(1)) * anchors.powers(anchors.BASE, gram)).sum(axis=1)) + np.uint64(gram))
    order = np.argsort(h)
    top = h[order] >> np.uint64(64 - upper)
    for k in np.flatnonzero(top[1:] == top[:-1])[:3]:
        low, high = letters[order[k]], letters[order[k + 1]]
        for _ in range(5000):
            text = rng.integers(97, 123, size).astype(np.uint8)
            text[150 : 150 + gram], text[200 : 200 + gram] = high, low
            g = anchors.gram_hashes(text.astype(np.uint64) + np.uint64(1), gram)
            if g.argmin() == 200 and np.partition(g, 1)[1] == g[150]:
                return text.tobytes().decode()
    raise AssertionError("none found")


def test_anchors_in_short_and_long_texts(spark):
    text = half_collision()
    r = random.Random(3)
    tail = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=400))
    filler = "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=17_000_000))
    df = spark.createDataFrame([(1, text), (2, text + tail + filler), (3, tail)], DOCS).repartition(3)
    got = {x.doc_id: [list(s) for s in x.spans] for x in suffixes.remove_repeats(df).select("doc_id", "spans").collect()}
    assert got == {1: [[0, 400]], 2: [[0, 800]], 3: [[0, 400]]}


@pytest.mark.parametrize("operator", [substrings, suffixes])
def test_repeats_in_texts_over_several_slices(spark, operator):
    """Passages at the start, in the middle and at the end of texts over three slices, and alone."""
    parts = [words(70, 1000 + i, 10**6) for i in range(4)]
    long = [words(70_000, 50 + i, 10**6) for i in range(4)]  # 480 KB each
    docs = [(1, f"{parts[0]} {long[0]} {parts[1]} {long[1]} {parts[2]}"), (2, parts[0]), (3, f"{long[2]} {parts[2]} {long[3]} {parts[3]}"), (4, parts[3]), (5, parts[1] + " end")]
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    got = Counter((x.doc_id, x.n_words if operator is substrings else x.n_bytes, x.n_removed) for x in operator.remove_repeats(df).collect())
    assert got == Counter(x[:3] for x in operator.brute_force(docs))


@pytest.mark.parametrize("operator", [substrings, suffixes])
def test_one_text_in_half_of_all_rows(spark, operator, monkeypatch):
    """Its units are hot: their copies stay where they are, and the result is the same."""
    from folio.llm import anchors

    monkeypatch.setattr(anchors, "HOT_SHARE", 16)
    hot = words(120, 5)
    docs = [(i, hot if i % 2 else f"{words(60, 2000 + i)} {words(60, 77) if i % 3 else ''}") for i in range(800)]
    df = spark.createDataFrame(docs, DOCS).repartition(4)
    got = Counter((x.doc_id, x.n_words if operator is substrings else x.n_bytes, x.n_removed) for x in operator.remove_repeats(df).collect())
    assert got == Counter(x[:3] for x in operator.brute_force(docs))


def test_short_pairs_at_the_similarity_are_all_found(spark):
    """4 of 5, 8 of 10 and 8 common of 9 and 9 shingles: similarity 0.8 exactly, 10,000 pairs each."""
    r = random.Random(9)
    docs = []
    for a, b in ((slice(0, 8), slice(0, 9)), (slice(0, 12), slice(0, 14)), (slice(0, 13), slice(1, 14))):
        for _ in range(10_000):
            ws = [f"{r.randrange(10**6)}x" for _ in range(14)]
            docs += [(len(docs), " ".join(ws[a])), (len(docs) + 1, " ".join(ws[b]))]
    got = simhash.near_duplicates(spark.createDataFrame(docs, DOCS).repartition(4), shingle=5, similarity=0.8)
    assert got.where("component_id <> doc_id - doc_id % 2").count() == 0 and got.count() == 60_000


def jaccard_roots(sets):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return root


@pytest.mark.parametrize("seed", range(4))
def test_blocks_that_stay_apart_lose_no_link(seed):
    from folio.llm import shingles

    r = random.Random(seed)
    sets = []
    for _ in range(40):
        base = {r.randrange(40 if seed % 2 else 10**6) for _ in range(r.randrange(4, 14))}
        sets += [base, base | {r.randrange(10**6)}, set(list(base)[1:]) or base]
    flat = np.array([x for s in sets for x in sorted(s)], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    for bits in (np.random.default_rng(seed).integers(0, 2**63, len(sets)).astype(np.uint64), np.zeros(len(sets), np.uint64)):  # whatever the fingerprints say
        label = list(range(len(sets)))
        for i, j in shingles.unite(np.arange(len(sets)), bits, flat, bounds):
            both = len(sets[i] & sets[j])
            assert 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
        assert label == jaccard_roots(sets)


@pytest.mark.parametrize("max_block", [1000, 7])
def test_large_blocks_are_parted(spark, max_block, monkeypatch):
    """Texts with much in common that are mostly apart, in blocks that hold them all; and one text in very many rows."""
    r = random.Random(2)
    common = [f"c{i}" for i in range(30)]
    texts = []
    for _ in range(60):
        own = common + [f"o{r.randrange(10**6)}" for _ in range(r.randrange(6, 14))]
        texts += [" ".join(own), " ".join(own + ["z"] * r.randrange(3)), " ".join(own[: r.randrange(28, len(own))])]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    want = dict(enumerate(jaccard_roots(sets)))
    texts += [texts[0]] * 500
    want |= {i: 0 for i in range(180, 680)}
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(4).withColumn("fp", pa_lit("clash")).withColumn("rep", pa_lit("clash"))
    got = simhash.near_duplicates(docs, shingle=5, similarity=0.8) if max_block == 1000 else shingles_with(docs, max_block)
    assert {x.doc_id: x.component_id for x in got.collect()} == want


def shingles_with(docs, max_block):
    from folio.llm import shingles

    return shingles.near_duplicates(docs, max_block=max_block)


def test_token_counts(spark, sf_dir, hard, empty):
    from folio.llm import token_counts

    file = path("byte_bpe_50k.json")
    docs = [(r[0], r[1]) for r in table(spark, sf_dir, "documents")]
    assert sorted(map(tuple, token_counts.query(spark, sf_dir).collect())) == sorted(token_counts.brute_force(docs, file))
    odd = [*HARD, (70, "<|endoftext|>"), (71, "a <|endoftext|> b <|endoftext|>"), (72, ("word, don't stop.  " * 40_000) + "x"), (73, "y" * 700_000)]
    clash = spark.createDataFrame(odd, DOCS).repartition(3).withColumn("n_bytes", pa_lit("clash")).withColumn("word", pa_lit("clash"))
    for size in (0, 5, token_counts.TABLE):  # the table only saves time
        got = token_counts.count_tokens(clash, file, size=size, cache=3 if size else 0)
        assert Counter(map(tuple, got.collect())) == Counter(token_counts.brute_force(odd, file))
    assert token_counts.count_tokens(empty, file).count() == 0
    words_kind = path("word_bpe_49k.json")  # another kind of vocabulary: texts go to the library whole
    assert Counter(map(tuple, token_counts.count_tokens(hard, words_kind).collect())) == Counter(token_counts.brute_force(HARD, words_kind))


def test_token_counts_shuffle_no_text(spark, hard):
    from folio.llm import token_counts

    plan = token_counts.count_tokens(hard.coalesce(1), path("byte_bpe_50k.json"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == hard._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_pre_tokens_equal_the_library():
    from tokenizers import Tokenizer

    from folio.llm import token_counts

    file = path("byte_bpe_50k.json")
    plain, split = Tokenizer.from_file(file), token_counts.PreTokens(file)
    r = random.Random(3)
    letters = " \n\t\r\x0b\x1c\x85\xa0　​ abcstmdrevl'''''sA1é.!\0ćß中²ⅷ٣😀ª́<|endoftext|>"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(14))) for _ in range(8000)] + ["<|endoftext", "|>", None, "don't we'll they've I'm he'd we're  's 'S"]
    got = split.counts(*text_buffer(pa.array(texts)), token_counts.LengthTable([b" a", b"a", b"'s"], [1, 1, 1]))
    assert got.tolist() == [len(plain.encode(t or "", add_special_tokens=False).ids) for t in texts]
    data, offsets = text_buffer(pa.array(["a b  c\td   e " * 50, "x" * 90, " ' s" * 30]))
    bounds, row = token_counts.pieces(data, offsets, 16)
    assert len(row) > 20 and bounds[0] == 0 and bounds[-1] == len(data) and (np.diff(bounds) >= 0).all() and set(row) == {0, 1, 2}
    tokens_of = np.zeros(3, np.int64)
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        tokens_of[row[i]] += len(plain.encode(data[a:b].tobytes().decode()).ids)
    assert tokens_of.tolist() == [len(plain.encode(t).ids) for t in ("a b  c\td   e " * 50, "x" * 90, " ' s" * 30)]


VECTORS = "vec_id long, embedding array<float>"


def check_whitening(rows, docs):
    from folio.llm import whitening

    want, _ = whitening.brute_force(docs)
    assert Counter((r.vec_id, r.component) for r in rows) == Counter({k: sum(1 for i, _ in docs if i == k[0]) for k in want})
    for r in rows:
        n, dev, size, share = want[(r.vec_id, r.component)]
        assert (r.n, r.deviation) == (n, dev if dev < 2**63 else None) and r.explained == pytest.approx(share, rel=1e-9) and r.identity_error < 1e-8
        assert abs(r.whitened) == pytest.approx(size, abs=1e-7)


def test_whitening(spark, sf_dir):
    from folio.llm import whitening

    check_whitening(whitening.query(spark, sf_dir).collect(), [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()])
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 5)) * [9, 5, 3, 2, 1]
    docs = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)] + [(100 + i, [float(np.float32(c)) for c in base[0]]) for i in range(90)]  # copies count once in the fit
    docs += [(7, docs[7][1]), (200, None), (201, [1.0, None, 2.0, 3.0, 4.0]), (202, [float("nan"), 1.0, 1.0, 1.0, 1.0]), (203, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (204, [-0.0] * 5)]
    df = spark.createDataFrame(docs, VECTORS).repartition(3).withColumn("component", pa_lit("clash")).withColumn("x", pa_lit("clash"))
    check_whitening(whitening.whiten(df).collect(), docs)
    odd = spark.createDataFrame([*docs, (300, [1.0]), (301, [])], VECTORS)
    assert whitening.whiten(odd).where("vec_id >= 300").count() == 0
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], VECTORS)).count() == 0  # no variance
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.5]) for i in range(9)], VECTORS)).collect()
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1)


@pytest.mark.parametrize("kind", ["flat", "repeated", "low rank", "steep", "clustered"])
def test_lanczos(kind):
    from folio.llm import whitening

    rng = np.random.default_rng(4)
    dim = 90
    values = {"flat": np.ones(dim), "repeated": np.repeat([9.0, 4.0, 1.0], 30), "low rank": np.r_[5.0, 4.0, 3.0, np.zeros(dim - 3)], "steep": 0.5 ** np.arange(dim), "clustered": 1 + 1e-9 * np.arange(dim)[::-1]}[kind]
    q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    a = q * values @ q.T
    got, vectors, passes = whitening.block_lanczos(lambda v: a @ v, dim, 4)
    assert np.allclose(got, np.sort(values)[::-1][:4], atol=1e-11) and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)
    assert np.abs(a @ vectors - vectors * got).max() < 1e-11
    if kind in ("low rank", "steep"):
        assert passes < 8


def test_sums_past_63_bits(spark):
    from folio.llm import whitening

    big = [(i, [2.0**50 * (i + 1), -(2.0**50) * i]) for i in range(30)]
    df = spark.createDataFrame(big, VECTORS)
    packed = whitening._packed(df, "embedding", 2)
    n, sums = whitening.exact_sums(packed, 2)
    assert (n, sums) == (30, [sum(2**58 * (i + 1) for i in range(30)), -sum(2**58 * i for i in range(30))])
    assert {r.deviation for r in whitening.whiten(df).collect()} == {None}
    with_ends = whitening.whiten(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 0.5])], VECTORS)).collect()
    assert {r.vec_id for r in with_ends} == {1, 2, 3}


def phrases_by_hand(docs, min_count, top):
    from collections import defaultdict

    n, f = Counter(), defaultdict(Counter)
    for lang, text in docs:
        t = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(ws)
            for i in range(len(ws)):
                for k in range(1, min(5, len(ws) - i) + 1):
                    f["und" if lang is None else lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if a >= min_count and len(p) > 1}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("size,counters,bucket_words", [(1_000_000, 1 << 26, 200_000), (40, 1 << 26, 60), (100, 1 << 8, 7)])
def test_collocations(spark, empty, size, counters, bucket_words, monkeypatch):
    from folio.llm import collocations

    monkeypatch.setattr(collocations, "BUCKET_WORDS", bucket_words)  # tells the bucket count, which the results don't depend on
    r = random.Random(6)
    docs = []
    for i in range(120):
        ws = [r.choice(["the", "The", "of", "é", "a\x1cb", "new", "york", "\x00", "x"]) + r.choice(["", "", "", ",", ".", "\n", "\t", "!?"]) for _ in range(r.randrange(40))]
        docs.append((i, r.choice(["en", "de", None, "und", ""]), " ".join(ws)))
    docs += [(200, "en", None), (201, "en", ""), (202, "fr", "a " * 300), (203, None, "..,"), (204, "long", ("one two three four five six " * 30 + ". ") * 3)] + [(5, docs[5][1], docs[5][2])] * 3
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").repartition(3).withColumn("n", pa_lit("clash")).withColumn("phrase", pa_lit("clash"))
    got = collocations.mine(df, min_count=5, top=25, size=size, max_counters=counters)
    assert sorted(map(tuple, got.collect())) == phrases_by_hand([(x[1], x[2]) for x in docs], 5, 25)
    assert collocations.mine(empty.withColumn("lang", pa_lit("en"))).count() == 0


@pytest.mark.parametrize("kind", [np.uint8, np.uint32])
def test_counters_are_told_whole(kind):
    from folio.llm import collocations

    for places in ([], [0], [131071], [0, 255, 256, 257, 70000, 131071], range(131072)):
        part = np.zeros(collocations.SEGMENT, kind)
        part[list(places)] = np.arange(len(places)) % 100 + 1
        at, n = collocations.dense(collocations.sparse(part), kind)
        assert at.tolist() == list(places) and n.tolist() == part[at].tolist()


def test_bitmaps_are_and_ed_over_blocks():
    """One word only: bitmaps shift over the bounds of blocks, and occurrences overlap."""
    from folio.llm import collocations

    n = 1000
    ids = np.zeros(n, np.int32)
    ids[[0, 500]] = ~0
    shard = collocations.Shard("en", b"a", ids.tobytes())
    everything = [np.full(16, 255, np.uint8)] * 5
    got = {p: (int(c), int(v)) for told in collocations.phrase_counts(shard, everything) for p, c, v in zip(*told, strict=True)}
    assert got == {b" ".join([b"a"] * k): (n - 2 * (k - 1), 0) for k in range(1, 6)}


def test_phrases_that_go_on_in_one_way_are_told_once():
    from folio.llm import collocations

    ids = np.tile(np.array([~0, 1, 2, 3, 4, 5], np.int32), 7)
    shard = collocations.Shard("en", b"a\nb\nc\nd\ne\nf", ids.tobytes())
    told = [(p, int(c), int(v)) for got in collocations.phrase_counts(shard, [np.full(16, 255, np.uint8)] * 5) for p, c, v in zip(*got, strict=True)]
    assert all(c == 7 for _, c, _ in told)
    assert {(p, v) for p, _, v in told if b" " in p} == {(b"a b c d e", 3), (b"b c d e f", 3), (b"c d e f", 2), (b"d e f", 1), (b"e f", 0)}


def test_large_benchmarks_are_built_by_tasks(spark):
    """Several automata: as many as the words need, each item in one, the hits as with one."""
    r = random.Random(8)
    items = [(i, " ".join(f"w{r.randrange(400)}" for _ in range(r.choice([0, 3, 20, 60])))) for i in range(120)] + [(None, "w1 w2 w3"), (500, None)]
    docs = [(i, " ".join(f"w{r.randrange(400)}" for _ in range(30)) + " " + items[r.randrange(120)][1]) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(7)
    made = list(decontaminate.automata(bench, max_words=300))
    held = sorted(name for sa in made for name in sa.names)
    assert len(made) >= 5 and held == sorted("null" if i is None else str(i) for i, t in items if t)
    df = spark.createDataFrame(docs, DOCS)
    want = {x[0]: x[1:4] for x in decontaminate.brute_force(docs, items)}
    for max_words, max_bytes in ((250_000, 200 << 20), (300, 200 << 20), (300, 1)):
        got = decontaminate.mark_hits(df, bench, max_words=max_words, max_bytes=max_bytes).collect()
        assert {x.doc_id: (x.n_words, sum(e - s for s, e in x.hits), len(x["items"])) for x in got} == {k: v for k, v in want.items()}


def test_a_conversation_of_many_turns(spark):
    turns = [(1, i, "assistant" if i % 2 else "user", f"text {i} ### x\n") for i in range(2000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", pa_lit("clash")).withColumn("loss", pa_lit("clash"))
    at = time.time()
    row = chat.format_conversations(df).first()
    assert time.time() - at < 40  # a few seconds where the machine is free
    assert chat.parse(row.formatted) == [(x[2], x[3]) for x in turns] and not row.rewrites
    assert [chat.unescape(row.formatted[s:e]) for s, e in row.loss] == [x[3] for x in turns if x[2] == "assistant"]


def test_clashing_columns_and_long_texts(spark, hard):
    """Columns named as the operators' own, and texts of a million words, in the operators that read documents row by row."""
    long = spark.createDataFrame([(90, "a b c d e. " * 200_000)], DOCS)
    docs = hard.unionByName(long)
    clash = docs.withColumns({c: pa_lit("clash") for c in ("kept", "n_words", "piece", "start", "length", "fp", "component_id", "score")})
    counted = {(x.doc_id, x.n_words) for x in quality.statistics(clash.drop("n_words")).select("doc_id", "n_words").collect()}
    assert (90, 1_000_000) in counted
    rows = packing.pack(clash.where("doc_id = 90"), path("byte_bpe_50k.json"))
    plain = packing.pack(docs.where("doc_id = 90"), path("byte_bpe_50k.json"))
    assert rows.count() == plain.count() > 900 and check_packing(rows.collect()) > 900
