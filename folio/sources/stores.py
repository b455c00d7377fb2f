"""Feature tables and volume files in storage: Parquet sinks and scans, layouts, archives, caches."""

from __future__ import annotations

import itertools
import os
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import ids
from folio.model import MissingDataError
from folio.sources import volumes

#: Row groups of clustered tables.
LOOKUP_BYTES = 8 << 20
KINDS = ("meta", "tokens", "chars", "section")


def write_tables(tables: dict[str, DataFrame], folder: str, compression: str = "snappy", mode: str = "errorifexists", order: tuple[str, ...] | None = None, clustered: bool = False) -> None:
    """Each kind of table as one Parquet dataset below ``folder``, sorted within files (by ``order``, or for pruning by volume and page).

    ``clustered``: volumes are dealt out by ranges of their ids, with a Bloom filter of the ids in each row group of
    ``LOOKUP_BYTES``, so that a query for one volume reads the few row groups that hold it.
    """
    for kind, df in tables.items():
        if kind not in KINDS:
            raise ValueError(f"no such kind of table: {kind}")
        keys = [c for c in order or ("htid", "page", "chunk", "section", "token", "lowercase", "pos") if c in df.columns]
        own = {}
        if clustered and "htid" in df.columns:
            df = df.repartitionByRange("htid", *[c for c in ("page", "chunk") if c in df.columns])
            own = {"parquet.bloom.filter.enabled#htid": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.block.size": str(LOOKUP_BYTES), "parquet.enable.dictionary#htid": "true"}
        df.sortWithinPartitions(*keys).write.mode(mode).options(**own).option("compression", compression).parquet(f"{folder}/{kind}")


def write_in_one_pass(raw: DataFrame, folder: str, kinds: tuple[str, ...] = ("tokens", "chars", "section", "pages"), compression: str = "snappy", mode: str = "errorifexists") -> None:
    """Several tables of ``raw`` (htid, value) from one parse of each text, as partitions ``kind=...`` of one dataset; :func:`read_table` finds them."""
    rows = volumes.tagged(raw, kinds)
    keys = [c for c in ("kind", "htid", "page", "section", "token", "pos") if c in rows.columns]
    rows.sortWithinPartitions(*keys).write.mode(mode).partitionBy("kind").option("compression", compression).parquet(folder)


def write_buckets(tables: dict[str, DataFrame], prefix: str, folder: str, buckets: int, mode: str = "errorifexists") -> None:
    """Each kind of table as the catalog's table ``<prefix>_<kind>``, hashed by volume into ``buckets`` files a task: folds and joins by volume need no shuffle."""
    for kind, df in tables.items():
        keys = [c for c in ("page", "section", "token", "lowercase", "pos") if c in df.columns]
        df.repartition(buckets, "htid").write.mode(mode).bucketBy(buckets, "htid").sortBy("htid", *keys).option("path", f"{folder}/{kind}").saveAsTable(f"{prefix}_{kind}")


def read_buckets(spark: SparkSession, prefix: str, kind: str) -> DataFrame:
    """A table of :func:`write_buckets`. Joins by volume and page count as joins by volume in this session, which is how the tables are dealt."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark.table(f"{prefix}_{kind}")


def write_volume_tables(tables: dict[str, DataFrame], root: str, layout: str = "local", compression: str = "snappy") -> DataFrame:
    """htid, path of one Parquet file ``<id>.<kind>.parquet`` per volume and kind in a layout, written when the result is used; :func:`read_volume_tables` reads them.

    A volume's rows stream into its file, batch by batch; files appear by rename, so a repeated task leaves whole files.
    """
    out = []
    for kind, df in tables.items():
        if kind not in KINDS:
            raise ValueError(f"no such kind of table: {kind}")
        columns = [c for c in df.columns if c != "htid"]

        def task(batches: Iterator[pa.RecordBatch], columns=columns) -> Iterator[pa.RecordBatch]:
            import pyarrow.compute as pc
            import pyarrow.parquet as pq

            files, top = _filesystem(root)
            path, part, writer, done = None, None, None, []

            def close() -> None:
                if writer:
                    writer.close()
                    files.move(part, f"{top}/{path}")

            for batch in batches:  # sorted by volume: one file is open at a time
                for own in pc.unique(batch.column("path")).to_pylist():
                    rows = batch.filter(pc.equal(batch.column("path"), own))
                    if own != path:
                        close()
                        path, part = own, _part(f"{top}/{own}")
                        files.create_dir(os.path.dirname(part), recursive=True)
                        writer = pq.ParquetWriter(part, rows.select(columns).schema, filesystem=files, compression=compression)
                        done.append((rows.column("htid")[0].as_py(), own))
                    writer.write_batch(rows.select(columns))
            close()
            yield pa.record_batch([pa.array([h for h, _ in done], pa.string()), pa.array([p for _, p in done], pa.string())], names=["htid", "path"])

        place = ids.LAYOUTS[layout]("htid", "parquet", None, kind)
        keys = [c for c in ("page", "chunk", "section", "token", "lowercase", "pos") if c in columns]
        rows = df.withColumn("path", place).repartition("htid").sortWithinPartitions("htid", *keys)
        out.append(rows.mapInArrow(task, "htid string, path string"))
    return reduce(DataFrame.unionByName, out)


def sort_order_sizes(tokens: DataFrame, folder: str, keys: tuple[str, ...] = ("page", "section", "token", "pos"), compression: str = "snappy") -> DataFrame:
    """``keys`` (joined by commas) and ``bytes``: the size of the token table written in each order of its keys within a volume."""
    spark, rows = tokens.sparkSession, []
    for order in itertools.permutations(keys):
        path = f"{folder}/{'-'.join(order)}"
        write_tables({"tokens": tokens}, path, compression, order=("htid", *order))
        sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
        rows.append((",".join(order), sizes.agg(F.sum("length")).first()[0] or 0))
    return spark.createDataFrame(rows, "keys string, bytes long")


def read_table(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """One kind of table; unsigned page and count columns come back signed. A missing one raises MissingDataError."""
    df = None
    for place in (kind, f"kind={kind}"):  # as its own dataset, or as a part of one
        try:
            df = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/{place}")
            break
        except Exception as e:
            if not ("PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e)):
                raise
    if df is None:
        raise MissingDataError(f"{folder}/{kind}")
    if place != kind:
        df = df.select(*volumes.KIND_COLUMNS[kind])
    for c, kind_ in (("page", "int"), ("chunk", "int"), ("count", "bigint")):
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast(kind_))
    return df


def read_volume_tables(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Per-volume Parquet files ``<id>.<kind>.parquet`` anywhere below ``folder``, with htid from their names."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kind}.parquet").option("mergeSchema", "true").parquet(folder)
    columns = [c for c in df.columns if c != "htid"]
    df = df.withColumn("htid", ids.extract_htid(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)))
    return df.select("htid", *[F.col(c).cast("int").alias(c) if c in ("page", "chunk") else F.col(c).cast("bigint").alias(c) if c == "count" else F.col(c) for c in columns])


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _part(path: str) -> str:
    """A name of its own for each attempt, so that speculative or repeated tasks never share a file."""
    return f"{path}.{uuid.uuid4().hex}.part"


def write_volumes(raw: DataFrame, root: str, layout: str = "stubbytree", compression: str | None = "bz2") -> DataFrame:
    """One nested file per volume of ``raw`` (htid, value) in a layout, written when the result (htid, path) is used.

    Files appear by rename, so a repeated task leaves whole files. ``ziptree`` adds to the archives that are there and
    refuses doubles; a task that repeats after it has put its archive in place, or a result that is used twice, finds its
    own write in the archive's manifest and adds nothing.
    """
    if layout == "ziptree":
        return _write_zips(raw, root)
    place = ids.LAYOUTS[layout]("htid", "json", compression)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import bz2
        import gzip

        pack: Callable[[bytes], bytes] = {"bz2": bz2.compress, "gz": gzip.compress, None: bytes}[compression]
        files, top = _filesystem(root)
        for pdf in batches:
            for path, value in zip(pdf["path"], pdf["value"], strict=True):
                files.create_dir(os.path.dirname(f"{top}/{path}"), recursive=True)
                with files.open_output_stream(part := _part(f"{top}/{path}"), compression=None) as f:
                    f.write(pack(value.encode()))
                files.move(part, f"{top}/{path}")
            yield pdf[["htid", "path"]]

    return raw.select("htid", place.alias("path"), "value").mapInPandas(task, "htid string, path string")


class _Archive:
    """A bucket's archive while one write adds volumes: what is there already is copied, entry by entry, and nothing is held.

    It is staged beside its place and put there by one rename. Its comment is the manifest: the writes that made it. A
    task that finds its own write there has been here before (its result was lost), so it only checks that each of its
    volumes is there with the same content.
    """

    def __init__(self, files, top: str, bucket: str, write: str):
        self.files, self.path = files, f"{top}/{bucket}.zip"
        files.create_dir(top, recursive=True)
        self.names: dict[str, tuple[int, int]] = {}
        self.out, writes = None, []
        if files.get_file_info(self.path).is_file:
            with files.open_input_file(self.path) as f, zipfile.ZipFile(f) as old:
                writes = old.comment.decode().split()
                self.names = {i.filename: (i.file_size, i.CRC) for i in old.infolist()}
                self.done = write in writes
                if not self.done:
                    self._stage()
                    for name in old.namelist():
                        self.out.writestr(name, old.read(name))
        else:
            self.done = False
            self._stage()
        if self.out:
            self.out.comment = " ".join([*writes, write][-WRITES:]).encode()

    def _stage(self) -> None:
        self.part = _part(self.path)
        self.stream = self.files.open_output_stream(self.part, compression=None)
        self.out = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_DEFLATED)

    def add(self, name: str, value: str) -> None:
        data = value.encode()
        if self.done:
            if self.names.get(name) != (len(data), zlib.crc32(data)):
                raise KeyError(f"an archive of this write lacks a volume, or has another text of it: {name}")
            return
        if name in self.names:
            self.out.close()
            self.stream.close()
            self.files.delete_file(self.part)
            raise KeyError(f"a volume is twice in an archive: {name}")
        self.names[name] = (len(data), zlib.crc32(data))
        self.out.writestr(name, data)

    def close(self) -> None:
        if self.done:
            return
        self.out.close()
        self.stream.close()
        self.files.move(self.part, self.path)


#: Writes that an archive's manifest remembers.
WRITES = 500


def _write_zips(raw: DataFrame, root: str, hash_chars: int = 3) -> DataFrame:
    write = uuid.uuid4().hex

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, top = _filesystem(root)
        bucket, archive = None, None
        for pdf in batches:  # sorted by bucket: one archive is open at a time, and its volumes stream into it
            for b, name, value in zip(pdf["bucket"], pdf["name"], pdf["value"], strict=True):
                if b != bucket:
                    if archive:
                        archive.close()
                    bucket, archive = b, _Archive(files, top, b, write)
                archive.add(name, value)
            yield pd.DataFrame({"htid": pdf["htid"], "path": pdf["bucket"] + ".zip"})
        if archive:
            archive.close()

    rows = raw.select("htid", ids.zip_bucket("htid", hash_chars).alias("bucket"), ids.file_name("htid", "json", None).alias("name"), "value")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "name").mapInPandas(pack, "htid string, path string")


def read_zips(spark: SparkSession, root: str) -> DataFrame:
    """htid, value of all volumes in the archives of ``root``; see :mod:`folio.sources.archives`."""
    from folio.sources.archives import read_archives

    return read_archives(spark, root)


def read_raw(spark: SparkSession, root: str) -> DataFrame:
    """htid, content: the stored bytes of every file, not decompressed."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return df.select(ids.extract_htid(F.element_at(F.split("path", "/"), -1)).alias("htid"), "content")


def read_ids(wanted: DataFrame, root: str, layout: str = "stubbytree", compression: str | None = "bz2") -> DataFrame:
    """htid, value of the wanted ids that a layout below ``root`` has; each task opens its own ids' files, nothing is listed."""
    place = F.concat(ids.zip_bucket("htid"), F.lit(".zip")) if layout == "ziptree" else ids.LAYOUTS[layout]("htid", "json", compression)
    rows = wanted.select("htid", place.alias("path"), ids.file_name("htid", "json", None).alias("name"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import bz2
        import gzip

        unpack = {"bz2": bz2.decompress, "gz": gzip.decompress, None: bytes}[None if layout == "ziptree" else compression]
        files, top = _filesystem(root)
        for pdf in batches:
            found = []
            for htid, path, name in zip(pdf["htid"], pdf["path"], pdf["name"], strict=True):
                if not files.get_file_info(f"{top}/{path}").is_file:
                    continue
                with files.open_input_file(f"{top}/{path}") as f:
                    if layout == "ziptree":
                        with zipfile.ZipFile(f) as z:
                            if name in z.NameToInfo:
                                found.append((htid, z.read(name).decode()))
                    else:
                        found.append((htid, unpack(f.read()).decode()))
            yield pd.DataFrame(found, columns=["htid", "value"])

    return rows.mapInPandas(task, "htid string, value string")


def fetch_rows(wanted: DataFrame, fetch: Callable[[str], str] | None = None, workers: int = 8, tries: int = 4, wait: float = 0.5) -> DataFrame:
    """htid, value, error, tries: each id through a fetcher on executors, ``workers`` at a time in a task.

    A call that fails is repeated after ``wait`` seconds, twice as long each time and with a share of chance, up to
    ``tries`` calls; an id that stays without an answer is a row with its error. A fetcher that raises KeyError or
    FileNotFoundError (an address answered with 404, say) says that there is no such volume, and isn't asked again.
    """
    if fetch is None:
        raise MissingDataError("no fetcher is set for remote volumes")

    def one(htid: str) -> tuple[str, str | None, str | None, int]:
        import random
        import time

        for k in range(1, tries + 1):
            try:
                return htid, fetch(htid), None, k
            except (KeyError, FileNotFoundError) as e:
                return htid, None, f"not found: {e}", k
            except Exception as e:
                if k == tries:
                    return htid, None, f"{type(e).__name__}: {e}", k
            time.sleep(wait * 2 ** (k - 1) * (0.5 + random.random()))
        raise AssertionError

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(workers) as pool:
            for pdf in batches:
                for a in range(0, len(pdf), 4 * workers):  # so many answers are held at once
                    yield pd.DataFrame(list(pool.map(one, pdf["htid"][a : a + 4 * workers])), columns=["htid", "value", "error", "tries"])

    return wanted.select("htid").mapInPandas(task, "htid string, value string, error string, tries int")


def fetched(wanted: DataFrame, fetch: Callable[[str], str] | None = None, **kw) -> DataFrame:
    """htid, value of the ids that :func:`fetch_rows` finds; those that there aren't are left out, and one that gives no answer fails the query with its error."""
    rows = fetch_rows(wanted, fetch, **kw)
    lost = F.col("error").isNotNull() & ~F.col("error").startswith("not found")
    return rows.select("htid", F.when(lost, F.raise_error(F.concat("htid", F.lit(": "), "error"))).otherwise(F.col("value")).alias("value")).where(F.col("value").isNotNull())


def url_fetcher(template: str, timeout: float = 60) -> Callable[[str], str]:
    """A fetcher of ``template`` with ``{id}`` (the quoted id), ``{url}`` (what is asked for is an address itself) or ``{clean}`` (its file name form); .bz2 and .gz answers are unpacked."""

    def fetch(htid: str) -> str:
        import bz2
        import gzip
        import urllib.error
        import urllib.parse
        import urllib.request

        url = htid if template == "{url}" else template.format(id=urllib.parse.quote(htid, safe=""), clean=urllib.parse.quote(ids.path_text(htid, "local", "json", None).removesuffix(".json")))
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:
                data = r.read()
        except urllib.error.HTTPError as e:
            if e.code in (404, 410):
                raise FileNotFoundError(url) from e
            raise
        return (bz2.decompress(data) if url.endswith(".bz2") else gzip.decompress(data) if url.endswith(".gz") else data).decode()

    return fetch


def with_fallback(wanted: DataFrame, cached: DataFrame, fallback: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], DataFrame | None] | None = None) -> DataFrame:
    """htid, value of the wanted ids: from ``cached`` where it has them, else from ``fallback`` (called with the missing ids).

    ``write`` stores what was fetched and may return it as stored; otherwise the fetched rows are kept on the executors'
    disks, so that none is fetched twice.
    """
    hits = cached.join(wanted.select("htid"), "htid", "left_semi")
    missed = fallback(wanted.select("htid").join(cached.select("htid"), "htid", "left_anti"))
    if write:
        from pyspark import StorageLevel

        kept = missed.persist(StorageLevel.DISK_ONLY)
        back = write(kept)
        missed = kept if back is None else back
    return hits.unionByName(missed)


def available(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """htid, exists."""
    have = stored.select("htid").distinct().withColumn("exists", F.lit(True))
    return wanted.select("htid").join(have, "htid", "left").select("htid", F.coalesce("exists", F.lit(False)).alias("exists"))


def copy_volumes(spark: SparkSession, source: DataFrame, root: str, layout: str = "stubbytree", compression: str | None = "bz2") -> int:
    """Writes the volumes of one store (htid, value) into another, once; returns how many."""
    return write_volumes(source, root, layout, compression).count()


def transfer_list(wanted: DataFrame, layout: str = "stubbytree") -> DataFrame:
    """htid, path: what to hand to a file transfer tool."""
    place: Column = ids.LAYOUTS[layout]("htid")
    return wanted.select("htid", place.alias("path"))


def layouts() -> dict[str, str]:
    """Store nicknames and what they are."""
    return {"local": "one folder", "pairtree": "two-character folders", "stubbytree": "every third character", "ziptree": "archives by hash", "path": "given paths", "http": "a fetcher"}


def named_store(name: str) -> tuple[str, str | None]:
    """(cache, store) of a nickname: a store's name alone, or ``a_cached_b`` for b with a as its cache."""
    known = layouts()
    store, _, cache = name.partition("_cached_")
    if store not in known or (cache and cache not in known):
        raise KeyError(name)
    return store, cache or None


@dataclass(frozen=True)
class Store:
    """Where volumes are: a layout below ``root``, or ``http`` through ``fetch``; ``behind`` is asked for what is missing, and what it gives is kept here."""

    layout: str
    root: str | None = None
    compression: str | None = "bz2"
    fetch: Callable[[str], str] | None = None
    behind: Store | None = None

    def get(self, wanted: DataFrame) -> DataFrame:
        """htid, value of the wanted ids (htid) that are found."""
        if self.layout == "http":
            return fetched(wanted, self.fetch)
        own = read_ids(wanted, self.root, self.layout, self.compression)
        if self.behind is None:
            return own
        return with_fallback(wanted, own.persist(), self.behind.get, self._keep)

    def put(self, raw: DataFrame) -> int:
        """Stores ``raw`` (htid, value); returns how many."""
        if self.layout == "http":
            raise ValueError("this store can only be read")
        return write_volumes(raw, self.root, self.layout, self.compression).count()

    def _keep(self, fetched_rows: DataFrame) -> None:
        self.put(fetched_rows)


def open_store(name: str, root: str | None = None, compression: str | None = "bz2", fetch: Callable[[str], str] | None = None, behind_root: str | None = None) -> Store:
    """The store of a nickname: ``stubbytree`` and so on below ``root``, ``http`` through ``fetch``, ``a_cached_b`` for a below ``root`` in front of b (below ``behind_root``)."""
    first, second = named_store(name)
    store = Store(first, root, compression, fetch)
    if first not in ("http",) and root is None:
        raise TypeError(f"{first} needs a root")
    if second is None:
        return store
    if second != "http" and behind_root is None:
        raise TypeError(f"{second} needs a root")
    return replace(store, behind=Store(second, behind_root, compression, fetch))
