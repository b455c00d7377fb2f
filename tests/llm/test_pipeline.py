import random
import re

import corpus_pipeline as cp
from pyspark.sql import functions as F

from folio.llm import common, decontaminate, simhash
from folio.llm.common import stored


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    every = {r.doc_id for r in docs.collect()}
    kept = every
    for name, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "test")
        assert docs.columns == cp.COLUMNS, name
        now = {r.doc_id for r in docs.collect()}
        assert now <= kept and len(now) > 0.5 * len(every), name
        kept = now
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = decontaminate.brute_force([(r.doc_id, r.text) for r in docs.collect()], bench)
    assert max(r[2] for r in left) == 0
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    last = cp.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in last.collect()} == kept


def test_each_stage_holds_arrow_batches_short(spark, sf_dir):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40), spark.conf.get(key)
    try:
        for set_to, wanted in (("10000", "2000"), ("700", "700")):
            for name, stage in cp.STAGES:
                spark.conf.set(key, set_to)
                stage(spark, docs, sf_dir)
                assert spark.conf.get(key) == wanted, name
    finally:
        spark.conf.set(key, before)


def test_texts_of_several_languages_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*cp.COLUMNS)
    by = {}
    for r in docs.where("length(text) > 1000").orderBy("doc_id").collect():
        by.setdefault(r.lang, r.text)
    # a third of the words each, so that no language leads with half
    three = " ".join(" ".join(re.findall(r"[^\W\d_]+", by[k])[:60]) for k in sorted(by)[:3])
    mixed = spark.createDataFrame([(-1, three, None, "s", len(three))], docs.schema)
    got = cp.language_id(spark, docs.unionByName(mixed), sf_dir)
    assert got.where("doc_id = -1").count() == 1


def test_near_copies_go_and_firsts_stay(spark, sf_dir):
    text = "one two three four five six seven " * 5
    rows = [(i, text, "en", "s", len(text)) for i in range(5)] + [(9, "quite another text about other things " * 3, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in cp.near_dedup(spark, docs, sf_dir).collect()} == {0, 9}


def test_near_dedup_links_by_simhash(spark, sf_dir):
    """Texts that are mostly the same few shingles, repeated, have one fingerprint; their shingle sets are far below the similarity."""
    texts = ["one two three four five six seven " * 100 + " ".join(f"{k}{i}" for i in range(60)) for k in "ab"] + ["another text altogether " * 9]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    bits = simhash.fingerprint(texts[0], 5) ^ simhash.fingerprint(texts[1], 5)
    assert bits.bit_count() <= 2
    assert {r.doc_id for r in cp.near_dedup(spark, docs, sf_dir).collect()} == {0, 2}


def test_repeated_lines_stay_once(spark, sf_dir):
    rows = [(i, "boiler plate\n" + (f"own {i}" if i % 2 else ""), "en", "s", 1) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in cp.line_dedup(spark, docs, sf_dir).collect()}
    assert set(got) == {0, 1, 3, 5, 7, 9, 11} and sum("boiler" in t for t in got.values()) == 1
    assert all(re.search(r"\S", t) for t in got.values())


def test_rows_without_a_text_and_empty_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "the cat of the house is on the mat and it was good for all of them to see that day again " * 4
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, text, "en", "s", 1), (3, text, "en", "s", 1), (None, text, None, None, None)]
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*cp.COLUMNS)
    for docs, fixed in ((base.where("false"), set()), (base.unionByName(spark.createDataFrame([(r[0] and -r[0], *r[1:]) for r in rows], schema)), {-3})):
        for _, stage in cp.STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), "test")
            assert docs.columns == cp.COLUMNS
        assert {r.doc_id for r in docs.where("doc_id < 0").collect()} == fixed
        assert cp.STAGES[-1][1](spark, docs, sf_dir).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_the_whole_run(spark, sf_dir):
    rows = cp.run(spark, sf_dir).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for seq in by.values():
        at = 0
        for o, n in sorted(seq):
            assert o == at
            at += n
        assert at <= 1024
    every = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in rows} <= every


def test_edited_copies_go_as_brute_force_says(spark, sf_dir):
    rng = random.Random(5)
    texts = []
    for g in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 200))]
        texts.append(" ".join(words))
        for _ in range(6):  # copies of copies, so that chains come with ends under the similarity
            words = [f"x{rng.randrange(3000)}" if rng.random() < 0.012 else w for w in words]
            texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in cp.near_dedup(spark, docs, sf_dir).collect()}
    assert 30 < len(set(root)) < 200 and got == set(root)


def test_scratch_tables_go_when_told(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda s: str(tmp_path))
    assert not common.clear(spark)
    df = common.stored(spark.range(3), "mine")
    assert df.count() == 3 and list(tmp_path.glob("folio/llm-*/mine-*"))
    (tmp_path / "folio" / "other").mkdir()
    assert common.clear(spark) and not common.clear(spark)
    assert [p.name for p in (tmp_path / "folio").iterdir()] == ["other"]


def test_clashing_columns_null_ids_and_repeated_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60").select(*cp.COLUMNS)
    first = docs.orderBy("doc_id").limit(1)
    rows = docs.unionByName(first).unionByName(first.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars"))
    rows = rows.unionByName(spark.createDataFrame([(1001, None, None, None, None), (1002, "", "en", "s", 0), (1003, "... 12 !!", "en", "s", 9)], docs.schema))
    names = ("fp", "n_words", "n_dropped", "lang_pred", "confidence", "hits", "items", "piece", "rid", "text_hash")
    plain = clash = rows
    for n in names:
        clash = clash.withColumn(n, F.lit("clash"))
    for name, stage in cp.STAGES[:-1]:
        plain, clash = stored(stage(spark, plain, sf_dir), "plain"), stored(stage(spark, clash, sf_dir), "clash")
        assert clash.columns == cp.COLUMNS, name
        assert sorted(map(str, clash.collect())) == sorted(map(str, plain.collect())), name
        for n in names:
            clash = clash.withColumn(n, F.lit("clash"))
    kept = [r.doc_id for r in plain.collect()]
    assert None in kept and not {1001, 1002, 1003} & set(kept) and kept.count(first.first().doc_id) == 2
    assert cp.best_fit(spark, clash, sf_dir).count() == cp.best_fit(spark, plain, sf_dir).count()
