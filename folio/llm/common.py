"""Helpers shared by the training-data operators: scratch tables and Arrow text buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white space characters that split words and surround line keys.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of text that one vectorised step handles at a time (a longer document is handled alone).
SLICE_BYTES = 4 << 20


_OWN: dict[str, str] = {}


# What Arrow frees goes back to the system at once; its own pools would keep it in every Python worker.
pa.set_memory_pool(pa.system_memory_pool())


def trim() -> None:
    """Hands freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


#: One cache per Python worker: what one kind of task keeps goes when another kind comes.
_KEPT: dict = {}


def kept(key: tuple, make: Callable):
    """The worker's object for ``key``, made once; objects of other keys are dropped."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task`` for mapInArrow or mapInPandas; its freed memory goes back at the end, so idle workers stay small."""

    def run(batches: Iterator) -> Iterator:
        if not getattr(task, "keeps", False):
            _KEPT.clear()
        yield from task(batches)
        trim()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset and everything runs in one process (tests)."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="folio-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


#: What Arrow batches are held to where a session has Spark's defaults: setting, default, bound.
BATCH_BOUNDS = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(16 << 20)))


def short_batches(spark: SparkSession) -> None:
    """Arrow batches are held to 2,000 rows and 16 MB where the session has Spark's defaults, for long texts."""
    for key, default, bound in BATCH_BOUNDS:
        if spark.conf.get(key) == default:
            spark.conf.set(key, bound)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, for short batches."""
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """The application's own folder for this subpackage, in the shared folder."""
    return f"{shared_dir(spark)}/folio/llm-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> bool:
    """Deletes the application's scratch tables of this subpackage: once the results that read them are stored. False where there are none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with over this share of the rows is hot: there are fewer than HOT_SHARE of them whatever the input holds.
HOT_SHARE = 4096
#: Parts that a hot key's rows are dealt to.
SALTS = 64


def hot_of(counts: DataFrame, key: str, n: str, total: int) -> list:
    """The keys of ``counts`` (one row a key) whose count ``n`` is over the hot share of ``total`` rows, and over 100."""
    return [r[0] for r in counts.where((F.col(n) * HOT_SHARE > F.lit(max(total, HOT_SHARE * 100))) & F.col(key).isNotNull()).select(key).collect()]


def join_salted(many: DataFrame, one: DataFrame, key: str, hot: list, by: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` (one row a key). Rows of hot keys are dealt out by ``by``, and their partners repeated once a part."""
    if not hot:
        return many.join(one, key, how)
    salt, is_hot = "__folio_salt", F.col(key).isin(hot)
    left = many.withColumn(salt, F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0))
    right = one.withColumn(salt, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, salt], how).drop(salt)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer row comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of unsigned 64-bit integers (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; up to 6 million are kept."""
    out = _POWERS.get(base)
    if out is None or len(out) < n:
        out = np.full(max(n, 1), base & (2**64 - 1), np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            out = np.multiply.accumulate(out)
        if n <= 6_000_000:
            _POWERS[base] = out
    return out[:n]


#: An odd multiplier and its inverse modulo 2**64, for polynomial hashes over prefix sums.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 2**64)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the index of the first word of each row (with a last bound)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = np.ones(256, bool)
    word[list(ASCII_SPACE)] = False
    w = word[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    start = w.copy()
    start[1:] &= ~w[:-1] | first[1:n]
    end = w.copy()
    end[:-1] &= ~w[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each range as numbers of eight bytes (the last one filled up with zeros), and how many numbers each has."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    length = ends - starts
    if len(length) and length.max() <= 8:  # most words by far
        at, left, n = starts, length, np.ones(len(starts), np.int64)
    else:
        n = np.maximum(1, (length + 7) >> 3)
        step = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * 8
        at, left = np.repeat(starts, n) + step, np.repeat(length, n) - step
    return eight[at].view("<u8").ravel() & _MASK[np.minimum(left, 8)], n


#: The low k bytes, for k from 0 to 8.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def lane_hashes(values: np.ndarray, n: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` lanes: every lane is mixed with its place before it is added, so that no pattern of places cancels."""
    with np.errstate(over="ignore"):
        first = np.cumsum(n) - n
        if len(values) > len(n):
            place = (np.arange(len(values)) - np.repeat(first, n)).astype(np.uint64)
            values = np.add.reduceat(mix64(mix64(values + place * np.uint64(BASE)) ^ place), first)
        else:
            values = mix64(mix64(values))
        return mix64(values ^ (length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, independent of where it stands."""
    return lane_hashes(*lanes(data, starts, ends), ends - starts) if len(starts) else np.zeros(0, np.uint64)


def spread(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """arange(values[i], values[i] + counts[i]) for all i, concatenated."""
    counts = np.asarray(counts, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(np.asarray(values, np.int64) - (ends - counts), counts)
