"""Documents are dealt out by volume once, and what is folded by volume is not shuffled again."""

import pytest

from folio.plans import bridge
from folio.plans.queries import QUERIES
from folio.sources import volumes


def _shuffles(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


@pytest.mark.parametrize("name, most", [
    ("tokenlist_all", 1), ("tokenlist_group", 1), ("tokenlist_drop_section", 1), ("tokenlist_group_nocase_nopos_nopages", 1), ("page_freq_distinct", 1), ("page_freq_rows", 1),
    ("page_freq_bitmaps", 0), ("parquet_roundtrip", 0), ("chunk_tokenlist_page_ref", 2),
])
def test_texts_are_shuffled_and_words_are_not(spark, sf_dir, name, most):
    """The chunk query has its texts on both sides of a join; stored tables are read without a shuffle."""
    assert _shuffles(QUERIES[name](spark, sf_dir)) <= most


def test_nested_texts_are_made_with_one_shuffle(spark, sf_dir):
    assert _shuffles(bridge.to_json_volumes(bridge.by_volume(spark.read.parquet(f"{sf_dir}/documents.parquet")))) == 1


def test_cube_folds_before_it_multiplies_rows(spark, sf_dir):
    plan = QUERIES["tokenlist_cube"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Expand") :]
    assert below.count("Aggregate(keys=[page") == 2  # sums by the four keys, without volumes


def test_odd_texts_come_back(spark, sf_dir):
    texts = [None, "", "\n\n\n\n\n", "A a A 12 12 !?", "x " * 5000 + "y", "one\ntwo two\nThree. four!\n\nsix six six"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' as lang")
    want = sorted(map(tuple, bridge.tokens(docs).collect()))
    nested = bridge.to_json_volumes(bridge.by_volume(docs))
    assert nested.count() == len(texts)
    assert sorted(map(tuple, volumes.tokens(nested).collect())) == want
    assert sorted(map(tuple, bridge.tokens(bridge.by_volume(docs)).collect())) == want
    assert sorted(map(tuple, volumes.page_list(nested).collect())) == sorted(map(tuple, bridge.page_list(docs).collect()))


def test_repeated_and_null_ids_are_summed(spark):
    docs = spark.createDataFrame([(1, "a b\na"), (1, "a c"), (None, "a"), (None, "a a")], "doc_id long, text string")
    got = {(r.htid, r.token, r["count"]) for r in bridge.tokens(bridge.by_volume(docs)).where("section = 'header'").collect()}
    assert got == {("doc.1", "a", 2), ("doc.1", "b", 1), ("doc.1", "c", 1), (None, "a", 3)}
