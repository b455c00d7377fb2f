"""Token-ID files: patched frame-of-reference blocks.

A file holds the ids of consecutive documents (ascending ``doc_id``) in blocks of 256. A block stores its minimum,
the differences to it packed at the width that a chosen percentile of them needs, and the wider ones as exceptions
(position, whole difference). Block starts are indexed, so any range of ids is read without decoding the rest.

Layout, little-endian: magic ``FOLIOPF1``; u32 documents, u32 blocks, u64 ids, u64 words of payload, u64 exceptions;
document ids (i64) and their validity (u8), ids per document (u64); block minima (u32), widths (u8), exceptions per
block (u16), block starts in the payload (u64); payload (u32); exception positions (u8) and differences (u32); crc32.
Within a block, value i lies in lane i % 8 and a lane's values follow each other in 32-bit words.

Defined results: null text counts as empty and gives one end id; a null ``doc_id`` sorts first and stays null; rows
that repeat a ``doc_id`` stay separate documents, ordered by text; other columns are ignored; an empty table gives
no file and no row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import documents, scratch, text_buffer, tidy
from folio.llm.tokens import encoded, encoder

BLOCK, LANES = 256, 8
ROWS = BLOCK // LANES
MAGIC = b"FOLIOPF1"
#: Ids after which a task starts its next file (a longer document still goes whole into one file).
FILE_IDS = 2_000_000


def pack(ids: np.ndarray, percentile: float = 0.95) -> dict[str, np.ndarray]:
    """Blocks of ``ids``; ``percentile`` of a block's differences fit its width. The last block is padded."""
    nb = -(-len(ids) // BLOCK)
    x = np.zeros((nb, BLOCK), np.uint32)
    x.reshape(-1)[: len(ids)] = ids
    if len(ids) % BLOCK:
        x[-1, len(ids) % BLOCK :] = x[-1, 0]
    low = x.min(axis=1) if nb else np.zeros(0, np.uint32)
    x -= low[:, None]
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    top = np.partition(x, at, axis=1)[:, at] if nb else low
    width = np.ceil(np.log2(top.astype(np.float64) + 1)).astype(np.uint8)
    over = x > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    rows, cols = np.nonzero(over)
    starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * LANES)])
    payload = np.zeros(int(starts[-1]), np.uint32)
    for w in np.unique(width):
        if not w:
            continue
        w, which = int(w), np.flatnonzero(width == w)
        v = (x[which] & np.uint32(2**w - 1 if w < 32 else 0xFFFFFFFF)).reshape(len(which), ROWS, LANES)
        out = np.zeros((len(which), w, LANES), np.uint32)
        for r in range(ROWS):
            word, shift = divmod(r * w, 32)
            out[:, word] |= v[:, r] << np.uint32(shift)
            if shift + w > 32:
                out[:, word + 1] |= v[:, r] >> np.uint32(32 - shift)
        payload[starts[which][:, None] + np.arange(w * LANES)] = out.reshape(len(which), -1)
    return {"low": low, "width": width, "n_over": np.bincount(rows, minlength=nb).astype(np.uint16), "starts": starts[:-1].astype(np.uint64), "payload": payload, "over_at": cols.astype(np.uint8), "over": x[rows, cols]}


def unpack(p: dict[str, np.ndarray], first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` to ``last`` (exclusive), padding included."""
    last = len(p["low"]) if last is None else last
    width, starts = p["width"][first:last], p["starts"][first:last].astype(np.int64)
    x = np.zeros((len(width), BLOCK), np.uint32)
    for w in np.unique(width):
        if not w:
            continue
        w, which = int(w), np.flatnonzero(width == w)
        words = p["payload"][starts[which][:, None] + np.arange(w * LANES)].reshape(len(which), w, LANES)
        v = np.empty((len(which), ROWS, LANES), np.uint32)
        for r in range(ROWS):
            word, shift = divmod(r * w, 32)
            v[:, r] = words[:, word] >> np.uint32(shift)
            if shift + w > 32:
                v[:, r] |= words[:, word + 1] << np.uint32(32 - shift)
        x[which] = (v & np.uint32(2**w - 1 if w < 32 else 0xFFFFFFFF)).reshape(len(which), BLOCK)
    n = p["n_over"].astype(np.int64)
    a, b = int(n[:first].sum()), int(n[:last].sum())
    x[np.repeat(np.arange(len(width)), n[first:last]), p["over_at"][a:b]] = p["over"][a:b]
    return (x + p["low"][first:last][:, None]).reshape(-1)


def to_bytes(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A whole file."""
    p = pack(ids)
    parts = [
        MAGIC, struct.pack("<IIQQQ", len(doc_ids), len(p["low"]), len(ids), len(p["payload"]), len(p["over"])),
        np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is not None for d in doc_ids], np.uint8), counts.astype("<u8"),
        p["low"], p["width"], p["n_over"], p["starts"], p["payload"], p["over_at"], p["over"],
    ]
    out = b"".join(x if isinstance(x, bytes) else x.tobytes() for x in parts)
    return out + struct.pack("<I", zlib.crc32(out))


class TokenFile:
    """Reads a file's bytes: document table, whole documents, or any range of ids through the block index."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a whole token file")
        nd, nb, self.n, nw, nx = struct.unpack_from("<IIQQQ", data, 8)
        at = 8 + 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.valid, self.counts = take("<i8", nd), take("u1", nd), take("<u8", nd).astype(np.int64)
        self.blocks = {k: take(t, n) for k, t, n in (("low", "<u4", nb), ("width", "u1", nb), ("n_over", "<u2", nb), ("starts", "<u8", nb), ("payload", "<u4", nw), ("over_at", "u1", nx), ("over", "<u4", nx))}

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n if stop is None else min(stop, self.n)
        if stop <= start:
            return np.zeros(0, np.uint32)
        a = start // BLOCK
        return unpack(self.blocks, a, -(-stop // BLOCK))[start - a * BLOCK : stop - a * BLOCK]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes all texts and writes them in ascending id order; returns the manifest (file, n_docs, n_ids).

    The rows are range-partitioned by id; each task writes its files under names that follow from its place, by a
    temporary name and a rename, so a repeated attempt leaves the same files. Memory is bounded by one file's ids.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _filesystem(folder)
        files.create_dir(top, recursive=True)
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        made, held_ids = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal made, held, held_ids
            name = f"ids-{part:07d}-{made:05d}.pfor"
            doc_ids = [d for h in held for d in h[0]]
            data = to_bytes(doc_ids, np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
            temp = f"{top}/_{name}.{TaskContext.get().taskAttemptId()}"
            with files.open_output_stream(temp) as f:
                f.write(data)
            files.move(temp, f"{top}/{name}")
            n, made, held, held_ids = held_ids, made + 1, [], 0
            return pa.record_batch({"file": [name], "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_ids": pa.array([n], pa.int64())})

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b, ids, counts in encoded(enc, *text_buffer(batch.column(1))):
                ends = np.cumsum(counts + 1) - 1
                out = np.empty(len(ids) + b - a, np.uint32)
                own = np.ones(len(out), bool)
                own[ends] = False
                out[own], out[ends] = ids, end_id
                held.append((doc_ids[a:b], counts + 1, out))
                held_ids += len(out)
                if held_ids >= FILE_IDS:
                    yield flush()
        if held:
            yield flush()

    task.keeps = True  # the encoder, for the worker's next task
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    spark = docs.sparkSession
    rows.mapInArrow(tidy(task), "file string, n_docs long, n_ids long").write.parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents read back from the files: file, place in it, doc_id, start in the file, n_tokens, ids (array)."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                f = TokenFile(bytes(content))
                ids, ends = f.ids(), np.cumsum(f.counts)
                starts = ends - f.counts
                for a in range(0, len(starts), 2000):
                    b = min(len(starts), a + 2000)
                    yield pd.DataFrame({
                        "file": path.rsplit("/", 1)[-1], "place": np.arange(a, b), "doc_id": pd.Series(f.doc_ids[a:b]).astype("Int64").where(f.valid[a:b] > 0),
                        "file_start": starts[a:b], "n_tokens": f.counts[a:b], "ids_crc32": [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(starts[a:b], ends[a:b], strict=True)],
                    })

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select("path", "content")
    return files.mapInPandas(tidy(task), "file string, place long, doc_id long, file_start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Writes the files and reads them back: doc_id, start (ids of all documents before), n_tokens, ids_crc32, file.

    The manifest has one row a file (about two million ids); its running sum is the only single-task step.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "token-ids")
    manifest = write_files(docs, folder, tokenizer, end_id)
    base = manifest.select("file", (F.sum("n_ids").over(Window.orderBy("file")) - F.col("n_ids")).alias("base"))
    if not manifest.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
    return read_files(spark, folder).join(base, "file").select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32", "file")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_table(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 1)
