"""Line dedup with two Bloom filters.

Every task adds the hashes of its documents' distinct line keys to a filter of hashes seen once and, where one was
there already, to a filter of hashes seen twice. The tasks' filters travel as compressed segments and merge segment by
segment (a bit set by two tasks counts as seen twice), so no hash is shuffled. Only lines whose hash passes the merged
twice-filter, the suspected repeats, are shuffled and counted exactly by a 128-bit digest of the key. A key is a line
stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased.

Filter size: 16 bits a line, a power of two, at most ``max_bits`` (2**29: 64 MB, the bound of what is broadcast). Beyond
that the filters let more lines through to the exact count; the result stays the same.

Defined results: null text counts as empty (one empty line); texts of any length are read whole; a row is a document, also where a ``doc_id`` repeats;
other columns are kept by :func:`drop_lines`; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.blooms import MAX_BITS, bits_for, passes, twice_filter
from folio.llm.common import documents, stored, tidy

OF, KEYS, SALT = "__folio_of", "__folio_keys", "__folio_salt"
HOT_SHARE, SALTS = 4096, 32


def keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Lines and their keys, as UTF-8."""
    lines = (text or "").encode().split(b"\n")
    return lines, [x.strip().lower() for x in lines]


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _digests(text: str | None) -> list[bytes]:
    return [digest(k) for k in dict.fromkeys(keys(text)[1]) if k]


def _hash(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8")[::2] if digests else np.zeros(0, np.uint64)


def _line_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    texts = batch.column(0).to_pylist()
    for a in range(0, len(texts), 1000):
        yield _hash([d for t in texts[a : a + 1000] for d in _digests(t)])


def drop_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with the lines left in ``text_col``, and ``n_lines`` (before) and ``n_dropped``.

    With ``keep_first`` a repeated line's first occurrence stays, in the document with the smallest id (a null id is last;
    rows that share the id each keep it).
    """
    spark = docs.sparkSession
    lines = docs.agg(F.sum(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = bits_for(int(lines), max_bits=max_bits)
    twice = spark.sparkContext.broadcast(twice_filter(docs.select(text_col), bits, _line_hashes))  # at most max_bits / 8 bytes

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = twice.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(texts), 1000):
                rows, found, owner = [], [], []
                for i, t in zip(ids[a : a + 1000], texts[a : a + 1000], strict=True):
                    d = _digests(t)
                    if d and (keep := passes(filt, _hash(d))).any():
                        d = [x for x, k in zip(d, keep, strict=True) if k]
                        rows += [digest((t or "").encode())] * len(d)
                        owner += [i] * len(d)
                        found += d
                yield pa.record_batch({"of": pa.array(rows, pa.binary()), "key": pa.array(found, pa.binary()), "id": pa.array(owner, pa.int64())})

    # Equal texts lose the same lines, so a text's digest stands for its rows; each still counts as a document.
    found = stored(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(tidy(suspects), "of binary, key binary, id long"), "suspect-lines")
    frequent = found.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("owner")).where(F.col("n") >= min_docs)
    frequent = stored(frequent, "frequent-lines")
    # Keys with over a HOT_SHARE-th of the suspects' rows, fewer than HOT_SHARE keys by that count, are joined by broadcast;
    # a join on the key would deal all rows of such a line to one task.
    is_hot = F.col("n") * HOT_SHARE > F.lit(found.count())
    hot = F.broadcast(frequent.where(is_hot).select("key", "owner"))
    pairs = found.select("of", "key").distinct()
    cold = pairs.join(hot, "key", "left_anti").join(frequent.where(~is_hot).select("key", "owner"), "key")
    # Copies of a text come here as one row, so a text holds as many rows as it has lines at most.
    hits = pairs.join(hot, "key").unionByName(cold).groupBy(F.col("of").alias(OF)).agg(F.collect_list(F.struct("key", "owner")).alias(KEYS))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # Copies of one text with over a HOT_SHARE-th of the suspects' rows are dealt to SALTS tasks, and so are its hits.
    hot_texts = [r["of"] for r in found.groupBy("of").agg(F.count("*").alias("n")).where(is_hot).select("of").collect()]
    keyed = docs.select(*columns).withColumn(OF, _text_digest(text_col))
    if hot_texts:
        keyed = keyed.withColumn(SALT, F.when(F.col(OF).isin(hot_texts), F.spark_partition_id() % SALTS).otherwise(0))
        salts = F.when(F.col(OF).isin(hot_texts), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        joined = keyed.join(hits.withColumn(SALT, F.explode(salts)), [OF, SALT], "left").drop(OF, SALT)
    else:
        joined = keyed.join(hits, OF, "left").drop(OF)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n_lines, n_dropped = [], [], []
            for i, t, hit in zip(*(batch.column(c).to_pylist() for c in (id_col, text_col, KEYS)), strict=True):
                if not hit:
                    out.append(t or "")
                    n_lines.append((t or "").count("\n") + 1)
                    n_dropped.append(0)
                    continue
                own, ks = keys(t)
                first = {r["key"] for r in hit if keep_first and r["owner"] == i}
                gone = {r["key"] for r in hit}
                left = []
                for x, k in zip(own, ks, strict=True):
                    d = digest(k) if k else None
                    if d not in gone or d in first:
                        left.append(x)
                        first.discard(d)
                out.append(b"\n".join(left).decode())
                n_lines.append(len(own))
                n_dropped.append(len(own) - len(left))
            arrays = [pa.array(out, pa.string()) if c == text_col else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*columns, "n_lines", "n_dropped"])

    return joined.mapInArrow(tidy(apply), docs.select(*columns).schema.add("n_lines", "long").add("n_dropped", "long"))


def _text_digest(text_col: str):
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([digest((t or "").encode()) for t in texts.to_pylist()], pa.binary())

    return of(F.col(text_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.rid, k.doc_id
"""
