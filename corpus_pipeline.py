"""A training-data pipeline over ``documents``: language, repeated lines, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Stages may be run one by one:
each holds the session's Arrow batches to 2,000 rows and 16 MB where they are Spark's defaults.

Defined results: a null or empty text, or one without a letter, has no language and goes in the first stage; texts of any
length are read whole; copies, ties and repeated rows of one ``doc_id`` go in near-dedup but for those with their group's
least id (rows that share a kept id stay together); rows with a null ``doc_id`` are no group's first and stay; other
columns than the table's five are left out, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import decontaminate, language, lines, packing, simhash
from folio.llm.common import documents, short_batches, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose language is not known, or whose words are of no language with this mean confidence, go; a text of several languages stays.
MIN_CONFIDENCE = 0.5


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    found = language.identify(docs.select(*COLUMNS), language.train(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("confidence") >= MIN_CONFIDENCE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 10 documents and more stay where they come first; documents that lose their last word go."""
    short_batches(spark)
    kept = lines.drop_lines(docs.select(*COLUMNS), keep_first=True)
    return _measured(kept.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group stays; groups connect documents whose SimHash fingerprints of five-word shingles differ in 2 bits or fewer, and those with a shingle similarity of 0.8 or more."""
    short_batches(spark)
    return simhash.keep_first(docs.select(*COLUMNS), shingle=5, radius=2, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of one test item are cut out; documents with passages of several, or made up of them, go."""
    short_batches(spark)
    return _measured(decontaminate.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    short_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the learned model, the components or the packing; the stages are tested one by one.
ORACLE_SQL = None
