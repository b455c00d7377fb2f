import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folio.operators import vectors
from folio.operators.vectors import document_vectors
from folio.plans import queries


def test_document_vectors_use_every_vector(spark, sf_dir):
    counts, total = defaultdict(Counter), Counter()
    for r in queries._tokens(spark, sf_dir).where("section = 'body'").collect():
        counts[r.htid][r.token] += r["count"]
        total[r.token] += r["count"]
    vecs = [r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()]
    model = dict(zip(sorted(total, key=lambda t: (-total[t], t.encode())), vecs))
    assert len(model) == len(vecs) or len(model) == len(total)
    got = defaultdict(dict)
    for r in queries.QUERIES["doc_vectors"](spark, sf_dir).collect():
        got[r.htid][r.dim] = r.value
    got = {k: [v[i] for i in range(64)] for k, v in got.items()}
    assert set(got) == set(counts)
    for htid, words in counts.items():
        known = [(math.log1p(n), model[t]) for t, n in words.items() if t in model]
        want = [sum(w * v[i] for w, v in known) for i in range(64)] if len(known) > 10 else [None] * 64
        assert len(got[htid]) == 64 and got[htid] == (pytest.approx(want, abs=2e-6) if len(known) > 10 else want)


def vectors_by_hand(rows, model, dim, log, least):
    counts = defaultdict(Counter)
    for key, token, n in rows:
        counts[key][token] += n or 0
    out = {}
    for key, words in counts.items():
        known = [(math.log1p(n) if log else n, model[t]) for t, n in words.items() if model.get(t) is not None]
        out[key] = [sum(w * v[i] for w, v in known) for i in range(dim)] if len(known) > least else [None] * dim
    return out


@pytest.mark.parametrize("block_words,batch,log,dim", [(4096, "10000", True, 300), (7, "3", True, 300), (7, "10000", False, 300), (7, "10000", True, 5)])
def test_document_vectors_by_block(spark, block_words, batch, log, dim):
    """Blocks of few words, batches that cut blocks and keys, a word and a key with most rows, 300 dimensions, few as columns, and nulls."""
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["", "é"]
    model = {w: [r.random() - 0.5 for _ in range(dim)] for w in vocabulary[:50] + ["", "é"]} | {"w51": None}
    rows = [(r.choice(["a", "b", "c", None, "all"]), r.choice(vocabulary), r.randrange(1, 9)) for _ in range(600)]
    rows += [(f"k{i}", "w0", 1) for i in range(40)] + [("all", w, 2) for w in vocabulary] + [("few", "w1", 3), ("a", None, 4), ("none", "zz", 1), ("a", "w2", None)]
    tokens = spark.createDataFrame(rows, "htid string, token string, count long").repartition(5).selectExpr("*", "'clash' AS key", "1 AS cell", "2 AS vec", "3 AS n", "4 AS w")
    words = spark.createDataFrame(list(model.items()), "token string, vec array<double>").selectExpr("*", "'clash' AS key", "1 AS w")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {x.htid: x.vec for x in document_vectors(tokens, words, dim, log=log, min_ncount=2, block_words=block_words).collect()}
        stop = spark.createDataFrame([("w0",), ("é",), (None,)], "token string").withColumn("vec", F.lit(1))
        without = {x.htid: x.vec for x in document_vectors(tokens, words, dim, stop=stop, log=log, min_ncount=0, block_words=block_words).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for found, want in ((got, vectors_by_hand(rows, model, dim, log, 2)), (without, vectors_by_hand(rows, {k: v for k, v in model.items() if k not in ("w0", "é")}, dim, log, 0))):
        assert set(found) == set(want)
        for k, v in want.items():
            assert found[k] == (v if v[0] is None else pytest.approx(v, abs=1e-9))


@pytest.mark.parametrize("by_block,fails", [(True, "reshape"), (False, "INVALID_ARRAY_INDEX")])
def test_document_vectors_of_nothing(spark, by_block, fails):
    tokens = spark.createDataFrame([(1, "a", 2)], "htid long, token string, count long")
    words = spark.createDataFrame([], "token string, vec array<float>")
    assert [tuple(x) for x in document_vectors(tokens, words, 2, by_block=by_block).collect()] == [(1, [None, None])]
    assert document_vectors(tokens.limit(0), words, 2, by_block=by_block).count() == 0
    some = spark.createDataFrame([("a", [1.0, None])], "token string, vec array<double>")
    assert [tuple(x) for x in document_vectors(tokens, some, 2, log=False, min_ncount=0, by_block=by_block).collect()] == [(1, [2.0, 0.0])]
    with pytest.raises(Exception, match=fails):
        document_vectors(tokens, some.selectExpr("token", "array(1D) AS vec"), 2, min_ncount=0, by_block=by_block).collect()


def test_sums_of_documents_are_not_shuffled(spark, sf_dir):
    """Vectors are sent to the cells of documents that have their words; above that nothing is shuffled, with a bucketed table or without."""
    tokens = spark.createDataFrame([(f"d{i % 9}", f"w{i % 50}", i) for i in range(400)], "htid string, token string, count long")
    words = spark.createDataFrame([(f"w{i}", [1.0, float(i)]) for i in range(40)], "token string, vec array<double>")
    for df in (queries.QUERIES["doc_vectors"](spark, sf_dir), document_vectors(tokens, words, 2, min_ncount=0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("Union")]
        assert plan.count("Window [first(") == 1


@pytest.mark.parametrize("rows_a_cell", [1_000_000, 20])
def test_document_vectors_in_many_cells(spark, monkeypatch, rows_a_cell):
    """A word of all keys, keys in cells of their own, repeated rows and nulls give the sums that one cell gives."""
    monkeypatch.setattr(vectors, "CELL_ROWS", rows_a_cell)
    r = random.Random(5)
    rows = [(r.choice([None, *[f"k{i}" for i in range(30)]]), r.choice(["hot", None, *[f"w{i}" for i in range(40)]]), r.choice([None, 1, 2, 3])) for _ in range(900)]
    rows += [(f"k{i}", "hot", 5) for i in range(30)]
    model = {f"w{i}": [r.random(), r.random()] for i in range(30)} | {"hot": [0.5, -0.25]}
    tokens = spark.createDataFrame(rows, "htid string, token string, count long")
    words = spark.createDataFrame(list(model.items()), "token string, vec array<float>")
    model = {k: list(v) for k, v in words.collect()}
    got = {x.htid: x.vec for x in document_vectors(tokens, words, 2, min_ncount=3).collect()}
    counts = defaultdict(Counter)
    for key, token, n in rows:
        counts[key][token] += n or 0
    some = {(key, token) for key, token, n in rows if n is not None}
    assert set(got) == set(counts)
    for key, n in counts.items():
        known = [(math.log1p(x), model[t]) for t, x in n.items() if t in model and (key, t) in some]
        want = [sum(w * v[i] for w, v in known) for i in range(2)]
        assert got[key] == (pytest.approx(want, abs=1e-9) if len(known) > 3 else [None, None])
