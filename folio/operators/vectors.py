"""Count-weighted sums of word vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words of a vocabulary block; a task holds one block's vectors.
BLOCK_WORDS = 4096
#: Dimensions that are summed as columns: Spark generates code for up to 100 fields (its ``codegen.maxFields``).
COLUMNS = 90
#: Rows of counts in a cell of keys; a task sorts one cell's rows and the vectors of its words.
CELL_ROWS = 1_000_000


def _runs(column: pa.Array) -> np.ndarray:
    """Where runs of equal values (nulls are equal) begin, and the end."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1], [True]]))


def _rows(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dim)


def _sums(keys: pa.Array, n: np.ndarray, vec: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * vec.shape[1])
    return pa.record_batch([keys, pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(vec.reshape(-1)))], names=["key", "n", "vec"])


def _product(dim: int):
    """Rows of one block and part after another, its vectors first: a sum for each key and batch."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words, matrix = None, [], []
        for batch in batches:
            for a, b in zip((r := _runs(batch.column("cell"))), r[1:]):
                cell, rows = batch.column("cell")[a].as_py(), batch.slice(a, b - a)
                if cell != at:
                    at, words, matrix = cell, [], []
                of_model = rows.column("vec").is_valid()
                model, rows = rows.filter(of_model), rows.filter(pc.invert(of_model))
                if model.num_rows:
                    words.append(model.column("token"))
                    matrix.append(_rows(model.column("vec"), dim))
                if not words or not rows.num_rows:
                    continue
                if len(words) > 1:
                    words, matrix = [pa.concat_arrays(words)], [np.concatenate(matrix)]
                place = pc.index_in(rows.column("token"), value_set=words[0])
                rows, place = rows.filter(place.is_valid()), place.drop_null().to_numpy()
                if not rows.num_rows:
                    continue
                first = _runs(rows.column("key"))
                weighted = matrix[0][place] * rows.column("w").to_numpy()[:, None]
                yield _sums(rows.column("key").take(pa.array(first[:-1])), np.diff(first), np.add.reduceat(weighted, first[:-1]))

    return task


def _total(dim: int):
    """Sums of one key after another, added up; a null vector adds nothing."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last key's sums, which the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = np.zeros((batch.num_rows, dim))
            there = batch.column("vec").is_valid()
            vec[there.to_numpy(zero_copy_only=False)] = _rows(batch.column("vec").filter(there), dim)
            first = _runs(batch.column("key"))[:-1]
            keys, n, vec = batch.column("key").take(pa.array(first)), np.add.reduceat(batch.column("n").to_numpy(), first), np.add.reduceat(vec, first)
            if held is not None:
                if held[0][0].as_py() == keys[0].as_py():
                    n[0], vec[0] = n[0] + held[1][0], vec[0] + held[2][0]
                else:
                    yield _sums(*held)
            if len(keys) > 1:
                yield _sums(keys[:-1], n[:-1], vec[:-1])
            held = keys[-1:], n[-1:], vec[-1:]
        if held is not None:
            yield _sums(*held)

    return task


def _with_vectors(tokens: DataFrame, model: DataFrame, cells: int) -> DataFrame:
    """cell, key, token, count and vec (null where the model lacks the word), summed by key and word, of ``tokens`` dealt out into ``cells``.

    A vector is sent once to each cell that has its word, so keys stay in their cell.
    """
    of_cell = tokens.select("cell", "token").distinct().join(model, "token").select("cell", "token", F.col("vec").alias("own")).repartition(cells, "cell")
    counts = tokens.groupBy("cell", "key", "token").agg(F.sum("count").alias("count"))
    both = counts.withColumn("own", F.lit(None).cast(model.schema["vec"].dataType)).unionByName(of_cell, allowMissingColumns=True)
    first = Window.partitionBy("cell", "token").orderBy(F.col("own").isNull())  # a word's vector lies before its counts
    return both.withColumn("vec", F.first("own").over(first)).where(F.col("own").isNull()).drop("own")


def document_vectors(tokens: DataFrame, model: DataFrame, dim: int, stop: DataFrame | None = None, log: bool = True, min_ncount: int = 10, word: str = "token", key: str = "htid", by_block: bool | None = None, block_words: int = BLOCK_WORDS, cell: tuple[str, int] | None = None) -> DataFrame:
    """``key`` and ``vec``: the sum of ln(1 + count) (or count) times the vector, over the words that ``model`` (token, vec) has.

    ``dim`` nulls where no more than ``min_ncount`` distinct words are in the model. Up to ``COLUMNS`` dimensions are
    summed as columns: keys are dealt out into cells, each vector is sent to the cells that have its word, and no sum is
    shuffled. ``cell`` names a column that follows from the key and the parts into which ``tokens`` are dealt out by it
    already (a bucketed table); else they are counted and dealt out here, so give a stored table.

    Wider ones are a sparse-dense product by vocabulary block: words and vectors go to blocks of about ``block_words``, a
    block's counts to several parts by key, so that frequent words and keys are dealt out; a task reads a block's vectors,
    then streams its counts, and the sums of the blocks are added up by key. ``by_block`` chooses; both give the same
    sums. The model is never collected.

    Defined results: null is a key like any other; null words and counts, null vectors and entries, and words that the
    model lacks, add nothing; the model's words must be distinct; a vector shorter than ``dim`` fails; other columns are
    ignored, whatever their names.
    """
    spark, none = tokens.sparkSession, F.array_repeat(F.lit(None).cast("double"), dim)
    by_columns = dim <= COLUMNS if by_block is None else not by_block
    tokens = tokens.select(F.col(key).alias("key"), F.col(word).alias("token"), "count", *([F.col(cell[0]).alias("cell")] if cell and by_columns else []))
    weight = F.log1p("count") if log else F.col("count").cast("double")
    model = model.select("token", "vec").where(F.col("token").isNotNull() & F.col("vec").isNotNull())
    if stop is not None:
        model = model.join(stop.select("token"), "token", "left_anti")
    if by_columns:
        cells = cell[1] if cell else max(3 * spark.sparkContext.defaultParallelism, -(-tokens.count() // CELL_ROWS))
        if not cell:
            tokens = tokens.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells))).repartition(cells, "cell")
        found = _with_vectors(tokens, model, cells).withColumn("w", weight)
        known = F.count_if(F.col("w").isNotNull() & F.col("vec").isNotNull()).alias("n")
        sums = [F.coalesce(F.sum(F.col("w") * F.col("vec")[i].cast("double")), F.lit(0.0)).alias(f"v{i}") for i in range(dim)]
        found = found.groupBy("cell", "key").agg(known, *sums)
        return found.select(F.col("key").alias(key), F.when(F.col("n") > min_ncount, F.array(*[F.col(f"v{i}") for i in range(dim)])).otherwise(none).alias("vec"))
    counts = tokens.groupBy("key", "token").agg(F.sum("count").alias("count")).select("key", "token", weight.alias("w"))
    model = model.withColumn("vec", F.col("vec").cast("array<double>"))
    keys = tokens.select("key").distinct()
    counts = counts.where(F.col("token").isNotNull() & F.col("w").isNotNull())
    model = model.withColumn("vec", F.transform("vec", lambda x: F.coalesce(x, F.lit(0.0))))
    blocks = max(1, -(-model.count() // block_words))
    parts = max(4, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks))
    cell = F.pmod(F.xxhash64("token"), F.lit(blocks)) * parts
    no_key = F.lit(None).cast(tokens.schema["key"].dataType)
    dense = model.select(F.explode(F.sequence(cell, cell + (parts - 1))).alias("cell"), no_key.alias("key"), "token", F.lit(None).cast("double").alias("w"), "vec")
    sparse = counts.select((cell + F.pmod(F.xxhash64("key"), F.lit(parts))).alias("cell"), "key", "token", "w", F.lit(None).cast("array<double>").alias("vec"))
    dealt = sparse.unionByName(dense).repartition("cell").sortWithinPartitions("cell", F.col("vec").isNull(), "key")
    sums = f"key {tokens.schema['key'].dataType.simpleString()}, n long, vec array<double>"
    found = dealt.mapInArrow(_product(dim), sums)
    keys = keys.select("key", F.lit(0).cast("long").alias("n"), F.lit(None).cast("array<double>").alias("vec"))
    total = found.unionByName(keys).repartition("key").sortWithinPartitions("key").mapInArrow(_total(dim), sums)
    return total.select(F.col("key").alias(key), F.when(F.col("n") > min_ncount, F.col("vec")).otherwise(none).alias("vec"))
