import bz2
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio import config
from folio.corpus import Corpus
from folio.model import MissingDataError, MissingFieldError
from folio.operators import analysis, tokens
from folio.sources import metadata, stores, volumes
from folio.streaming import ingest

URL = "https://example.org/features_v_3.0"  # any version but 2.0 and 3.0 is the linked-data one
LONG = "x" * 70


def section(begin, end):
    return {"tokenCount": 6, "lineCount": 3, "emptyLineCount": 1, "capAlphaSeq": 2, "sentenceCount": None, "tokenPosCount": {"The": {"DT": 2}, "the": {"DT": 1, "NN": 1}, LONG: {"NN": 2}}, begin: {"T": 2}, end: None}


def volume(version, i):
    begin, end = {"2.0": ("beginLineChars", "endLineChars"), "3.0": ("beginCharCounts", "endCharCount")}.get(version, ("beginCharCount", "endCharCount"))
    pages = [{"seq": "00000001", "header": None, "body": section(begin, end), "footer": None}, {"seq": "00000002", "header": {**section(begin, end), "tokenPosCount": {"the": {"DT": 5}}}, "body": section(begin, end), "footer": None}, {"seq": "00000003", "header": None, "body": None, "footer": None}]
    meta = {"title": f"T{i}", "language": "jpn" if i == 0 else "eng", "pubDate": "1900"}
    if version in ("2.0", "3.0"):
        return {"id": f"a.{i}", "metadata": meta | {"names": ["N, M "], "genre": ["fiction"]}, "features": {"schemaVersion": version, "pageCount": 3, "pages": pages}}
    meta |= {"contributor": [{"name": "A"}, {"x": 1}, {"name": "B"}], "genre": "http://id.loc.gov/vocabulary/marcgt/fic", "publisher": {"name": "P"}, "pubPlace": "bare", "id": "http://h/a"}
    return {"htid": f"a.{i}", "metadata": meta, "features": {"schemaVersion": version, "pageCount": 3, "pages": pages}}


VOLUMES = [("2.0", 0), ("3.0", 1), (URL, 2)]


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("vols")
    for v, i in VOLUMES:
        folder = top / "ark+=13960=x"  # encoded ids hold '='
        folder.mkdir(exist_ok=True)
        (folder / f"a.{i}.json.bz2").write_bytes(bz2.compress(json.dumps(volume(v, i)).encode()))
    return volumes.read_files(spark, str(top))


@pytest.fixture(scope="module")
def corpus(raw):
    return Corpus.from_raw(raw).persist()


def test_tables(corpus):
    assert corpus.tokens.count() == 3 * 9 and "ark+" not in corpus.tokens.columns
    assert {(r.page, r.section) for r in corpus.sections.collect()} == {(1, "body"), (2, "header"), (2, "body")}
    assert {(r.place, r.char, r["count"]) for r in corpus.chars.collect()} == {("begin", "T", 2)} and corpus.chars.count() == 9
    assert corpus.pages.count() == 9  # empty pages too
    assert corpus.page_features.columns == ["htid", "page", "languages", "calculatedLanguage", "version"]
    assert max(len(r.token) for r in corpus.tokens.collect()) == 70
    assert max(len(r.token) for r in volumes.tokens(corpus.raw, truncate=True).collect()) == 64
    assert corpus.jsons().dtypes[1][1] == "variant"


def test_narrow_scans(raw):
    plan = volumes.section_features(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert "tokenPosCount" not in plan


def test_metadata(raw):
    rows = {r.htid: r for r in metadata.volumes(raw, {"fic": "fiction"}).collect()}
    assert rows["a.0"].author == ["N, M "] and rows["a.0"].tokenization_warning and not rows["a.1"].tokenization_warning
    assert rows["a.2"].author == ["A", "B"] and rows["a.2"].genre == ["fiction"] and rows["a.1"].genre == ["fiction"]
    assert rows["a.2"].publisher == "P" and rows["a.2"].pub_place == "bare" and rows["a.2"].year == "1900" and rows["a.2"].page_count == 3
    assert rows["a.2"].source_institution is None and rows["a.2"].handle_url == "http://h/a"


def test_metadata_is_parsed_once(raw):
    plan = metadata.volumes(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(StructField(id") + plan.count("from_json(StructField(htid") == 1
    assert "get_json_object(value" not in plan and "pages" not in plan


def test_texts_that_are_no_volume(spark):
    rows = [("a", "no json"), ("b", None), ("c", "{}"), ("d", json.dumps({"id": 7, "metadata": {"title": ["x", {"y": 1.50}], "language": None, "pubDate": 1900}, "features": {"schemaVersion": "3.0", "pageCount": "12"}}))]
    got = {r.htid: r for r in metadata.volumes(spark.createDataFrame(rows, "htid string, value string")).collect()}
    assert [(got[k].title, got[k].author, got[k].genre) for k in "abc"] == [(None, [], [])] * 3
    d = got["d"]
    assert (d.id, json.loads(d.title), d.language, d.year, d.page_count) == ("7", ["x", {"y": 1.5}], None, "1900", 12)


def test_missing_genre_is_empty(spark):
    df = spark.createDataFrame([("a", json.dumps({"htid": "a", "metadata": {}, "features": {"schemaVersion": "x", "pages": []}}))], "htid string, value string")
    row = metadata.volumes(df).first()
    assert row.genre == [] and row.author == []


def test_genre_list(raw):
    rows = {r.htid: r.genre for r in metadata.volumes(raw).collect()}
    assert rows["a.2"] == ["fiction"]  # a code of the list by default
    assert {r.htid: r.genre for r in metadata.volumes(raw, {}).collect()}["a.2"] == ["http://id.loc.gov/vocabulary/marcgt/fic"]


def test_bibliographic(spark, tmp_path):
    marc = "<collection xmlns='http://www.loc.gov/MARC21/slim'><record><controlfield tag='001'>77</controlfield><datafield tag='245' ind1='1'><subfield code='a'>A title</subfield><subfield code='c'>N</subfield></datafield><datafield tag='245'><subfield code='a'>Another</subfield></datafield></record></collection>"
    (tmp_path / "one.json").write_text(json.dumps({"items": [{"fromRecord": "77"}, {"fromRecord": "78"}], "records": {"78": {"marc-xml": "<x/>"}, "77": {"marc-xml": marc}}}))
    (tmp_path / "none.json").write_text(json.dumps({"items": [], "records": []}))
    one, none = f"file://{tmp_path}/one.json", f"file://{tmp_path}/none.json"
    rows = spark.createDataFrame([("a.1", one), ("a.2", one), ("a.3", none), ("a.4", None)], "htid string, ht_bib_url string")
    xml = F.col("marc_xml")
    got = metadata.bibliographic(rows, stores.url_fetcher("{url}")).select("htid", "record_id", metadata.marc_subfields(xml, "245", "a").alias("t"), metadata.marc_subfields(xml, "100", "a").alias("w"), metadata.marc_control(xml, "001").alias("c")).orderBy("htid").collect()
    assert [tuple(r) for r in got] == [("a.1", "77", ["A title", "Another"], [], "77"), ("a.2", "77", ["A title", "Another"], [], "77"), ("a.3", None, None, None, None)]
    with pytest.raises(MissingDataError):
        metadata.bibliographic(rows)


def test_sidecar(spark):
    row = metadata.sidecar(spark.createDataFrame([("a.1", "{}")], "htid string, value string")).first()
    assert (row.id, row.title, row.handle_url) == ("a.1", "a.1", "http://hdl.handle.net/2027/a.1")


def test_folds_keep_sums(corpus):
    t = corpus.tokens
    whole = t.where("section = 'body'").groupBy().sum("count").first()[0]
    for kw in ({}, {"case": False}, {"pos": False}, {"pages": False}, {"pages": False, "pos": False, "case": False}):
        assert tokens.tokenlist(t, **kw).groupBy().sum("count").first()[0] == whole
    assert not any(x in tokens.tokenlist(t)._jdf.queryExecution().optimizedPlan().toString() for x in ("Aggregate [",))
    one = {(r.lowercase, r["count"]) for r in corpus.volume("a.1").page(1).tokenlist(case=False, pos=False).collect()}
    assert one == {("the", 4), (LONG, 2)}
    assert corpus.volume("a.1").page(9).tokenlist().count() == 0


def test_capabilities(corpus, spark):
    t = corpus.tokens
    low = tokens.tokenlist(t, section="group", case=False, pos=False)
    assert tokens.tokenlist(low, case=False, pos=False).count() == low.count()
    for kw in ({}, {"case": False}, {"case": False, "pos": False, "section": "body"}):
        with pytest.raises(MissingFieldError):
            tokens.tokenlist(low, **kw)
    with pytest.raises(MissingFieldError):
        tokens.tokenlist(t.drop("page"))
    with pytest.raises(ValueError):
        tokens.tokenlist(t, section="margin")
    with pytest.raises(AssertionError):
        tokens.tokenlist(t, page_select=1, pages=False)


def test_save_and_read(corpus, spark, tmp_path):
    corpus.save(str(tmp_path / "c"), ("meta", "tokens", "chars", "section"), {"case": False})
    back = Corpus.from_tables(spark, str(tmp_path / "c"))
    assert back.tokenlist(case=False).groupBy().sum("count").first()[0] == corpus.tokenlist().groupBy().sum("count").first()[0]
    corpus.save(str(tmp_path / "d"), ("tokens",))
    part = Corpus.from_tables(spark, str(tmp_path / "d"))
    with pytest.raises(MissingDataError):
        part.chars
    assert part.tokens_per_page().count() == 6
    with pytest.raises(MissingDataError):
        stores.read_table(spark, str(tmp_path / "e"), "tokens")


@pytest.mark.parametrize("layout,compression", [("stubbytree", "bz2"), ("pairtree", "gz"), ("local", None), ("ziptree", None)])
def test_layouts_round_trip(raw, spark, tmp_path, layout, compression):
    assert stores.write_volumes(raw, str(tmp_path / layout), layout, compression).count() == 3
    back = stores.read_zips(spark, str(tmp_path / layout)) if layout == "ziptree" else volumes.read_files(spark, str(tmp_path / layout))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, raw.collect()))
    assert stores.read_raw(spark, str(tmp_path / layout)).count() >= 1


def test_archives_refuse_doubles(raw, tmp_path):
    with pytest.raises(Exception, match="twice"):
        stores.write_volumes(raw.union(raw), str(tmp_path), "ziptree").count()


def test_fallback(spark):
    wanted, cached = spark.createDataFrame([("a",), ("b",)], "htid string"), spark.createDataFrame([("a", "1"), ("c", "3")], "htid string, value string")
    asked = []
    got = stores.with_fallback(wanted, cached, lambda m: stores.fetched(m, lambda h: h * 2), lambda df: asked.append(df.count()))
    assert sorted(map(tuple, got.collect())) == [("a", "1"), ("b", "bb")] and asked == [1]
    with pytest.raises(MissingDataError):
        stores.fetched(wanted)
    assert stores.named_store("local_cached_http") == ("local", "http")
    with pytest.raises(KeyError):
        stores.named_store("attic")


def test_archives_grow(raw, spark, tmp_path):
    rows = raw.orderBy("htid").collect()
    one, rest = (spark.createDataFrame([tuple(r) for r in part], "htid string, value string") for part in (rows[:1], rows[1:]))
    assert stores.write_volumes(one, str(tmp_path), "ziptree").count() == 1
    own = stores._write_zips(one.select(F.concat(F.lit("b."), "htid").alias("htid"), "value"), str(tmp_path / "flat"), 0)
    assert own.count() == 1 and stores._write_zips(rest, str(tmp_path / "flat"), 0).count() == 2  # one bucket for all
    assert sorted(r.htid for r in stores.read_zips(spark, str(tmp_path / "flat")).collect()) == ["a.1", "a.2", "b.a.0"]
    stores.write_volumes(rest, str(tmp_path), "ziptree").count()
    with pytest.raises(Exception, match="twice"):
        stores.write_volumes(one, str(tmp_path), "ziptree").count()
    assert sorted(map(tuple, stores.read_zips(spark, str(tmp_path)).collect())) == sorted(map(tuple, rows))


def test_nothing_is_fetched_twice(spark, tmp_path):
    def fetch(htid):
        (tmp_path / "asked" / f"{htid}-{time.time_ns()}").write_text("")
        return htid * 2

    (tmp_path / "asked").mkdir()
    wanted = spark.createDataFrame([("a.1",), ("a.2",), ("a.3",)], "htid string")
    store = stores.open_store("stubbytree_cached_http", str(tmp_path / "cache"), fetch=fetch)
    stores.write_volumes(spark.createDataFrame([("a.1", "own")], "htid string, value string"), store.root).count()
    want = [("a.1", "own"), ("a.2", "a.2a.2"), ("a.3", "a.3a.3")]
    for _ in range(2):  # the second time all are in the cache
        assert sorted(map(tuple, store.get(wanted).collect())) == want
        assert len(list((tmp_path / "asked").iterdir())) == 2


@pytest.mark.parametrize("layout", ["stubbytree", "ziptree"])
def test_stores_by_name(raw, spark, tmp_path, layout):
    store = stores.open_store(layout, str(tmp_path))
    assert store.put(raw) == 3
    assert [r.htid for r in store.get(spark.createDataFrame([("a.1",), ("z.9",)], "htid string")).collect()] == ["a.1"]
    for bad in ((layout,), (f"{layout}_cached_local", "x")):
        with pytest.raises(TypeError):
            stores.open_store(*bad)


def test_url_fetcher(tmp_path):
    (tmp_path / "a.1.json.bz2").write_bytes(bz2.compress(b"{}"))
    assert stores.url_fetcher(f"file://{tmp_path}/{{clean}}.json.bz2")("a.1") == "{}"


def test_per_volume_tables(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for i in range(2):
        pq.write_table(pa.table({"page": pa.array([1, 2], pa.uint64()), "section": ["body"] * 2, "token": ["x", "y"], "pos": ["NN"] * 2, "count": pa.array([3, i], pa.uint32())}), tmp_path / f"a.v{i}.tokens.parquet")
    pq.write_table(pa.table({"page": [1]}), tmp_path / "a.v0.chars.parquet")
    df = stores.read_volume_tables(spark, str(tmp_path), "tokens")
    assert dict(df.dtypes) == {"htid": "string", "page": "int", "section": "string", "token": "string", "pos": "string", "count": "bigint"}
    assert {(r.htid, r.page, r["count"]) for r in df.collect()} == {("a.v0", 1, 3), ("a.v0", 2, 0), ("a.v1", 1, 3), ("a.v1", 2, 1)}


def test_open(raw, corpus, spark, tmp_path):
    corpus.save(str(tmp_path / "json"), format="json")
    path = str(next((tmp_path / "json").rglob("*.bz2")))
    assert Corpus.open(spark, path).tokens.count() == 9 and Corpus.open(spark, path, compression="bz2", format="json").tokens.count() == 9
    assert Corpus.open(spark, ids=["a.0", "a.2"], store=stores.open_store("stubbytree", str(tmp_path / "json"))).tokens.count() == 18
    assert Corpus.open(spark, ids=["a.0"], root=str(tmp_path / "json")).tokens.count() == 9
    upper = Corpus.from_handler(spark, path, lambda data: bz2.decompress(data).decode())
    assert upper.tokens.count() == 9
    for kw in ({}, {"paths": path, "ids": ["a.0"]}, {"paths": path, "compression": "gz"}, {"paths": path, "format": "parquet"}):
        with pytest.raises(TypeError):
            Corpus.open(spark, **kw)
    with pytest.raises(TypeError):
        corpus.save(str(tmp_path / "x"), ("meta",), format="json")


def test_first_random_and_pages(corpus):
    assert {r.htid for r in corpus.first().tokens.collect()} == {"a.0"}
    assert corpus.random_rows(4, seed=1).count() == 4
    page = corpus.volume("a.1").page(2)
    got = [getattr(page, m)().first()[2] for m in ("token_count", "line_count", "empty_line_count", "cap_alpha_seq", "sentence_count")]
    assert got == [6, 3, 1, 2, None] and page.line_count(section="header").count() == 1
    assert page.begin_line_chars().count() == 1 and page.end_line_chars().count() == 0 and page.page_features().count() == 1


def test_sort_orders(corpus, tmp_path):
    sizes = stores.sort_order_sizes(corpus.tokens, str(tmp_path), ("page", "token")).collect()
    assert {r["keys"] for r in sizes} == {"page,token", "token,page"} and all(r.bytes > 0 for r in sizes)


def test_settings(tmp_path):
    (tmp_path / "a.yaml").write_text("layout: pairtree  # theirs\ncompression: null\nroot: '/data'\n")
    (tmp_path / "b.json").write_text('{"format": "parquet"}')
    got = config.load_files(str(tmp_path / "none.yaml"), str(tmp_path / "a.yaml"), str(tmp_path / "b.json"), layout="local", root=None)
    assert got == {"default_section": "body", "format": "parquet", "compression": None, "layout": "local", "root": "/data"}
    assert config._plain_yaml((tmp_path / "a.yaml").read_text()) == {"layout": "pairtree", "compression": None, "root": "/data"}
    assert config.learn("x/a.1.json.bz2") == {"format": "json", "compression": "bz2"} and config.learn("a.json") == {"format": "json", "compression": None}
    with pytest.raises(ValueError):
        config.learn("a.txt")


def test_smoothing_equals_plain_regression():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 10, 60):
        x, y = np.sort(rng.choice(300, n, replace=False)).astype(float), rng.normal(size=n)
        k = min(n, max(2, int(np.ceil(0.3 * n))))
        for at, got in zip(x, analysis.smoothed(x, y), strict=True):
            d = np.abs(x - at)
            w = np.clip(1 - (d / max(np.sort(d)[k - 1], 1e-9)) ** 3, 0, 1) ** 3
            a = np.stack([np.ones(n), x - at], 1) * np.sqrt(w)[:, None]
            assert got == pytest.approx(np.linalg.lstsq(a, y * np.sqrt(w), rcond=None)[0][0], abs=1e-6)


def test_map_volumes(corpus):
    out = corpus.map_volumes(lambda pdf: pdf.groupby("htid", as_index=False)["count"].sum(), "htid string, count long")
    assert {r["count"] for r in out.collect()} == {12}


def test_stream(raw, spark, tmp_path):
    raw.select("value").write.text(str(tmp_path / "in"))
    q = ingest.pos_totals(ingest.volume_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("pos").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.pos, r["count"]) for r in spark.table("pos").collect()} == {("DT", 18), ("NN", 18)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_all_tables_from_one_parse(raw, corpus, spark, tmp_path):
    tagged = volumes.tagged(raw)
    plan = plan_of(tagged)
    assert plan.count("from_json(StructField") == 1 and plan.count("Scan text") == 1 and "Exchange" not in plan
    for kind, table in (("tokens", corpus.tokens), ("chars", corpus.chars), ("section", corpus.sections), ("pages", corpus.page_features)):
        assert rows_of(volumes.of_kind(tagged, kind).select(*table.columns)) == rows_of(table)
    assert "tokenPosCount" not in plan_of(volumes.tagged(raw, ("chars", "section")))
    stores.write_in_one_pass(raw, str(tmp_path / "w"))
    for kind, table in (("tokens", corpus.tokens), ("chars", corpus.chars), ("section", corpus.sections), ("pages", corpus.page_features)):
        assert rows_of(stores.read_table(spark, str(tmp_path / "w"), kind).select(*table.columns)) == rows_of(table)
    Corpus.from_raw(raw).save(str(tmp_path / "s"), ("meta", "tokens", "section"))
    back = Corpus.from_tables(spark, str(tmp_path / "s"))
    assert rows_of(back.tokens) == rows_of(corpus.tokens) and rows_of(back.sections) == rows_of(corpus.sections) and back.volumes.count() == 3
    with pytest.raises(MissingDataError):
        back.chars


def test_buckets_need_no_shuffle(corpus, spark, tmp_path):
    stores.write_buckets({"tokens": corpus.tokens, "section": corpus.sections}, "held", str(tmp_path / "b"), 3)
    before = {k: spark.conf.get(k) for k in ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        toks, secs = stores.read_buckets(spark, "held", "tokens"), stores.read_buckets(spark, "held", "section")
        totals = toks.groupBy("htid", "page").agg(F.sum("count").alias("total"))
        folded = tokens.tokenlist(toks, case=False, pos=False)
        joined = toks.join(totals, ["htid", "page"]).join(secs.where("section = 'body'").select("htid", "page", "tokenCount"), ["htid", "page"])
        for df in (totals, folded, joined, tokens.tokenlist(toks, pages=False)):
            assert "Exchange" not in plan_of(df)
        assert rows_of(folded) == rows_of(tokens.tokenlist(corpus.tokens, case=False, pos=False)) and joined.count() == corpus.tokens.count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        for k in ("tokens", "section"):
            spark.sql(f"DROP TABLE held_{k}")


@pytest.mark.parametrize("layout", ["local", "stubbytree", "pairtree"])
def test_tables_of_each_volume(corpus, spark, tmp_path, layout):
    wide = corpus.tokens.unionByName(corpus.tokens.withColumn("htid", F.lit("lib.a:c/d.1")).withColumn("count", F.col("count") + 1))
    paths = {(r.htid, r.path) for r in stores.write_volume_tables({"tokens": wide, "section": corpus.sections}, str(tmp_path / "v"), layout).collect()}
    assert len(paths) == 4 + 3 and all((tmp_path / "v" / p).is_file() for _, p in paths)
    assert not list((tmp_path / "v").rglob("*.part"))
    assert rows_of(stores.read_volume_tables(spark, str(tmp_path / "v"), "tokens").select(*wide.columns)) == rows_of(wide)
    assert rows_of(stores.read_volume_tables(spark, str(tmp_path / "v"), "section").select(*corpus.sections.columns)) == rows_of(corpus.sections)
    with pytest.raises(ValueError):
        stores.write_volume_tables({"other": wide}, str(tmp_path / "v"))


def test_archive_writes_may_be_repeated(spark, tmp_path):
    first = spark.createDataFrame([(f"a.{i}", f"text {i}") for i in range(40)], "htid string, value string")
    out = stores.write_volumes(first, str(tmp_path), "ziptree")
    one, size = rows_of(out), {p.name: p.stat().st_mtime_ns for p in tmp_path.glob("*.zip")}
    assert rows_of(out) == one and {p.name: p.stat().st_mtime_ns for p in tmp_path.glob("*.zip")} == size  # the same write: nothing is added
    with pytest.raises(Exception, match="twice in an archive"):  # another write with a volume that is there
        stores.write_volumes(first.limit(1), str(tmp_path), "ziptree").collect()
    more = stores.write_volumes(spark.createDataFrame([(f"b.{i}", "x") for i in range(40)], "htid string, value string"), str(tmp_path), "ziptree")
    assert len(more.collect()) == len(more.collect()) == 40
    assert rows_of(out) == one  # and the earlier write still knows its own
    assert stores.read_zips(spark, str(tmp_path)).count() == 80 and not list(tmp_path.glob("*.part"))
    with pytest.raises(Exception, match="twice in an archive"):
        stores.write_volumes(first.limit(3).union(first.limit(3)), str(tmp_path / "new"), "ziptree").collect()


def test_an_archive_task_that_is_lost_is_repeated(spark, tmp_path):
    """Its archive is in place and its result is lost: the retry finds its own write, and no other content passes for it."""
    root = str(tmp_path / "z")
    from folio.sources.stores import _Archive, _filesystem

    files, top = _filesystem(root)
    for _ in range(2):  # the same task twice, as the scheduler would run it
        archive = _Archive(files, top, "abc", "w1")
        for i in range(5):
            archive.add(f"{i}.json", f"v{i}")
        archive.close()
    changed = _Archive(files, top, "abc", "w1")
    with pytest.raises(KeyError):
        changed.add("0.json", "another text")
    assert sorted(p.name for p in (tmp_path / "z").iterdir()) == ["abc.zip"]


def test_sparse_rows_over_the_whole_vocabulary(corpus):
    long = tokens.tokenlist(corpus.tokens, pages=False, pos=False, section="group")
    words = tokens.vocabulary(long, parts=3)
    known = {r.token: r["index"] for r in words.collect()}
    assert sorted(known.values()) == list(range(len(known))) and set(known) == {r.token for r in long.collect()}
    rows = tokens.sparse_rows(long, words).collect()
    assert all(r.indices == sorted(r.indices) for r in rows)
    assert sorted((r.htid, i, v) for r in rows for i, v in zip(r.indices, r["values"], strict=True)) == sorted((r.htid, known[r.token], r["count"]) for r in long.collect())


def test_bitmaps_of_pages(spark):
    rows = [("v", p, s, w, "NN", 2) for p in (1, 63, 64, 65, 128, 129, 1000) for s in ("body", "header") for w in ("A", "a") if p % 2 or w == "a"]
    df = spark.createDataFrame(rows, "htid string, page int, section string, token string, pos string, count long")
    held = tokens.page_bitmaps(df)
    for kw in ({}, {"case": False}, {"section": "group"}, {"section": "all", "pos": False}, {"section": "group", "case": False, "pos": False}):
        assert rows_of(tokens.bitmap_page_freqs(held, **kw)) == rows_of(tokens.tokenlist(df, pages=False, page_freq=True, **kw))
    with pytest.raises(ValueError):
        tokens.bitmap_page_freqs(held, section="margin")


def test_printed_forms(spark, corpus):
    lines = {r.htid: r for r in corpus.printed().collect()}
    assert lines["a.0"].line == "<Volume: T0 (1900) by N, M>" and lines["a.2"].line == "<Volume: T2 (1900) by A>"
    assert lines["a.2"].html == "<strong><a href='http://h/a'>T2</a></strong> by <em>A, B</em> (1900, 3 pages) - <code>a.2</code>"
    rows = [("x", "t" * 29 + " tail", "1900", ["w" * 41]), ("y", " short ", None, []), ("z", None, "1", [" p "])]
    df = spark.createDataFrame(rows, "htid string, title string, year string, author array<string>").selectExpr("*", "htid as id", "htid as handle_url", "1 as page_count")
    got = {r.htid: r.line for r in metadata.printed(df).collect()}
    assert got == {"x": f"<Volume: {'t' * 29}... (1900) by {'w' * 40}...>", "y": "<Volume: short (None) without a listed author>", "z": "<Volume: None (1) by p>"}
    assert [r.line for r in corpus.volume("a.1").page(2).printed().collect()] == ["<page 2 of volume a.1>"]


class Flaky:
    """A local server: every address fails twice before it answers, some never do, some are not there."""

    def __init__(self):
        import threading
        from collections import Counter
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

        asked, lock = Counter(), threading.Lock()

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                with lock:
                    asked[self.path] += 1
                    n = asked[self.path]
                code = 404 if "gone" in self.path else 500 if "bad" in self.path or n < 3 else 200
                self.send_response(code)
                self.end_headers()
                if code == 200:
                    self.wfile.write(f"text of {self.path}".encode())

            def log_message(self, *args):
                pass

        self.asked, self.server = asked, ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}/"


def test_fetching_from_a_flaky_server(spark):
    flaky = Flaky()
    fetch = stores.url_fetcher(flaky.url + "{id}", timeout=10)
    wanted = spark.createDataFrame([(f"v{i}",) for i in range(30)] + [("bad",), ("gone",)], "htid string").repartition(2)
    rows = {r.htid: r for r in stores.fetch_rows(wanted, fetch, tries=4, wait=0.01).collect()}
    assert {k for k, r in rows.items() if r.value} == {f"v{i}" for i in range(30)} and rows["v3"].value == "text of /v3"
    assert all(flaky.asked[f"/v{i}"] == 3 == rows[f"v{i}"].tries for i in range(30))  # each is fetched once
    assert (rows["bad"].tries, flaky.asked["/bad"]) == (4, 4) and "500" in rows["bad"].error
    assert (rows["gone"].tries, flaky.asked["/gone"]) == (1, 1) and rows["gone"].error.startswith("not found")
    found = stores.fetched(wanted.where("htid <> 'bad'"), fetch, wait=0.01)
    assert found.count() == 30
    with pytest.raises(Exception, match="bad: HTTPError"):
        stores.fetched(wanted, fetch, wait=0.01).collect()
    flaky.server.shutdown()


def test_one_volume_is_in_few_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = spark.range(400_000).select(F.concat(F.lit("v."), F.lpad((F.col("id") % 500).cast("string"), 3, "0")).alias("htid"), (F.col("id") / 500).cast("int").alias("page"), F.lit("body").alias("section"), F.sha2(F.col("id").cast("string"), 256).alias("token"), F.lit("NN").alias("pos"), F.lit(1).cast("long").alias("count"))
    before = stores.LOOKUP_BYTES
    stores.LOOKUP_BYTES = 1 << 20
    try:
        stores.write_tables({"tokens": rows}, str(tmp_path), clustered=True)
    finally:
        stores.LOOKUP_BYTES = before
    bounds = []
    for f in (tmp_path / "tokens").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        bounds += [(c.statistics.min, c.statistics.max) for c in (meta.row_group(g).column(0) for g in range(meta.num_row_groups))]
    assert len(bounds) >= 8
    for i in range(0, 500, 7):
        assert sum(low <= f"v.{i:03d}" <= high for low, high in bounds) <= 2
    one = stores.read_table(spark, str(tmp_path), "tokens").where("htid = 'v.123'")
    assert one.count() == 800 and "EqualTo(htid,v.123)" in plan_of(one)


def plain_lowess(x, y, share, passes):
    """Point by point, by weighted least squares."""
    n, k = len(x), min(len(x), max(2, int(share * len(x) + 1e-10)))
    robust, out = np.ones(n), np.array(y, float)
    for turn in range(passes + 1):
        for i in range(n):
            near = np.sort(np.argsort(np.abs(x - x[i]), kind="stable")[:k])
            d = np.abs(x[near] - x[i])
            w = (1 - (d / d.max()) ** 3) ** 3 * robust[near]
            if w.sum() <= 0:
                out[i] = y[i]
                continue
            a = np.stack([np.ones(k), x[near]], axis=1) * np.sqrt(w)[:, None]
            out[i] = np.linalg.lstsq(a, y[near] * np.sqrt(w), rcond=None)[0] @ [1, x[i]]
        if turn < passes:
            left = np.abs(y - out)
            robust = np.clip(1 - (left / (6 * np.median(left))) ** 2, 0, 1) ** 2
    return out


def test_robust_smoothing(spark):
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.uniform(0.5, 1.5, 120))
    y = np.sin(x / 9) + rng.normal(0, 0.1, 120)
    y[[10, 50, 51, 90]] += 12  # outliers
    for share in (0.1, 0.25, 0.4):
        for passes in (1, 3):
            assert np.allclose(analysis.robustly_smoothed(x, y, share, passes), plain_lowess(x, y, share, passes), atol=1e-7)
    assert np.abs(analysis.robustly_smoothed(x, y, 0.2) - np.sin(x / 9)).max() < 0.4 < np.abs(analysis.smoothed(x, y, 0.2) - np.sin(x / 9)).max()
    assert analysis.robustly_smoothed(np.array([1.0]), np.array([4.0])).tolist() == [4.0]
    line = np.arange(30.0)
    assert np.allclose(analysis.robustly_smoothed(line, 2 * line + 1), 2 * line + 1)
    df = spark.createDataFrame([("v", i, i, float(v)) for i, v in enumerate(y)], "htid string, page int, seq int, sentiment double")
    got = [r.smooth for r in analysis.lowess(df, "sentiment", 0.25, 3, "seq").orderBy("page").collect()]
    assert np.allclose(got, analysis.robustly_smoothed(np.arange(120.0), y, 0.25))


def test_small_parts_of_queries(corpus, spark):
    """One page's line characters; chunks as places of a stored table; stop words of vectors; the order of chunks."""
    from folio.operators import features, vectors

    one = features.line_chars(corpus.chars, page_select=2, section="all")
    assert {r.page for r in one.collect()} == {2} and one.count() == 6
    chunked = tokens.tokenlist(corpus.tokens, chunk=True, chunk_target=5)
    assert "chunk" in chunked.columns and "page" not in chunked.columns
    again = tokens.tokenlist(chunked, pos=False)  # a table by chunk is folded by chunk
    assert "chunk" in again.columns and again.groupBy().sum("count").first()[0] == chunked.groupBy().sum("count").first()[0]
    ordered = [(r.htid, r.chunk, r.token, r.pos) for r in analysis.chunk_order(chunked.repartition(3)).select("htid", "chunk", "token", "pos").collect()]
    assert ordered == sorted(ordered)
    model = spark.createDataFrame([("The", [1.0, 0.0]), ("the", [0.0, 1.0])], "token string, vec array<double>")
    stop = spark.createDataFrame([("the",)], "token string")
    vecs = {r.htid: r.vec for r in vectors.document_vectors(corpus.tokens, model, 2, stop, log=False, min_ncount=0).collect()}
    assert all(v == [6.0, None] or v[0] > 0 and v[1] == 0.0 for v in vecs.values()) and len(vecs) == 3


def test_archives_are_split_and_take_filters(spark, tmp_path):
    import json
    from pyspark.sql import datasource as D

    from folio.sources import archives

    def text(i):
        section = {"tokenPosCount": {f"w{k}": {"NN": k + 1, "VB": 1} for k in range(i % 4)}}
        return json.dumps({"id": f"a.{i}", "features": {"pages": [{"seq": f"{p:08d}", "header": None, "body": section, "footer": section} for p in range(1, i % 5 + 1)]}})

    raw = spark.createDataFrame([(f"a.{i}", text(i)) for i in range(60)] + [("b.x:/1", "{}")], "htid string, value string")
    stores.write_volumes(raw, str(tmp_path / "many"), "ziptree").collect()
    stores._write_zips(raw, str(tmp_path / "one"), 0).collect()
    want = rows_of(volumes.tokens(raw))
    for place in ("many", "one"):
        df = archives.read_archives(spark, str(tmp_path / place), split_bytes=2000)
        assert rows_of(df) == rows_of(raw) and df.rdd.getNumPartitions() > 1  # one archive, several tasks
        own = archives.read_archives(spark, str(tmp_path / place), "tokens", split_bytes=2000)
        assert rows_of(own.select(*volumes.tokens(raw).columns)) == want
        few = own.where("page >= 2 and page < 4 and section in ('body', 'header') and htid like 'a.1%' and count > 1")
        plan = few._jdf.queryExecution().executedPlan().toString()
        condition = plan.split("BatchScan")[0].split("Filter")[-1]  # what is left for Spark
        assert "count" in condition and not any(c in condition for c in ("page", "section", "htid"))
        assert rows_of(few.select(*volumes.tokens(raw).columns)) == rows_of(volumes.tokens(raw).where("page >= 2 and page < 4 and section in ('body', 'header') and htid like 'a.1%' and count > 1"))
    one = archives.read_archives(spark, str(tmp_path / "many"), hashed=True).where("htid = 'b.x:/1'")
    assert [tuple(r) for r in one.collect()] == [("b.x:/1", "{}")]
    reader = archives.ArchiveReader(str(tmp_path / "many"), "texts", 1 << 20, True, None)
    assert list(reader.pushFilters([D.In(("htid",), ("a.1", "a.2")), kept := D.EqualTo(("value",), "x")])) == [kept]
    assert {p.split("/")[-1] for s in reader.partitions() for p, *_ in s.ranges} == {stores.ids.bucket_text(x) + ".zip" for x in ("a.1", "a.2")}
    (tmp_path / "none").mkdir()
    assert archives.read_archives(spark, str(tmp_path / "none")).count() == 0
