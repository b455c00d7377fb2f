"""Archives of nested volume files as a data source: planned splits and pushed filters.

A split is a byte range of one archive, or some small archives together; a task reads an archive's list of entries and
takes those that begin in its range, so a large archive is read by several tasks and planning opens no archive. Filters on
``htid`` choose entries by name before anything is decompressed (and, where archives are named by their ids' hash,
archives before anything is opened). Filters on ``page`` and ``section`` choose what becomes rows.

Defined results: an archive without nested files, or none, gives no row; a volume without pages or token maps gives no
token rows; ids come from entry names.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from folio.functions import ids
from folio.model import SECTIONS

SPLIT_BYTES, OPEN_COST = 64 << 20, 4 << 20
SCHEMAS = {"texts": "htid string, value string", "tokens": "htid string, page int, section string, token string, pos string, count bigint"}
_PUSHED = {"texts": ("htid",), "tokens": ("htid", "page", "section")}
_TESTS: dict[type, Callable[[object, object], bool]] = {
    D.EqualTo: lambda x, v: x == v,
    D.In: lambda x, v: x in v,
    D.GreaterThan: lambda x, v: x > v,
    D.GreaterThanOrEqual: lambda x, v: x >= v,
    D.LessThan: lambda x, v: x < v,
    D.LessThanOrEqual: lambda x, v: x <= v,
    D.StringStartsWith: lambda x, v: x.startswith(v),
    D.IsNotNull: lambda x, v: True,
}


@dataclass
class Split(D.InputPartition):
    """(path, first byte, byte behind the last) of each archive's part; by where entries begin."""

    ranges: list[tuple[str, int, int]]


class ArchiveReader(D.DataSourceReader):
    def __init__(self, root: str, kind: str, split: int, hashed: bool, schema: pa.Schema):
        self.root, self.kind, self.split, self.hashed, self.schema = root, kind, split, hashed, schema
        self.filters: dict[str, list[tuple[type, object]]] = {}

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute[0] in _PUSHED[self.kind]:
                self.filters.setdefault(f.attribute[0], []).append((type(f), getattr(f, "value", None)))
            else:
                yield f

    def _wants(self, column: str, value: object) -> bool:
        tests = self.filters.get(column)
        return not tests or (value is not None and all(_TESTS[kind](value, v) for kind, v in tests))

    def _may_hold(self, archive: str) -> bool:
        wanted = next(([v] if kind is D.EqualTo else list(v) for kind, v in self.filters.get("htid", ()) if kind in (D.EqualTo, D.In)), None)
        if not self.hashed or wanted is None:
            return True
        return any(ids.bucket_text(x, len(archive)) == archive for x in wanted if x is not None)

    def partitions(self) -> list[Split]:
        from pyarrow import fs

        from folio.sources.stores import _filesystem

        files, top = _filesystem(self.root)
        scheme = self.root[: self.root.index(top)] if top in self.root else ""
        out, held = [], 0
        for info in sorted(files.get_file_info(fs.FileSelector(top)), key=lambda i: i.path):
            if not info.is_file or not info.path.endswith(".zip") or not self._may_hold(info.base_name.removesuffix(".zip")):
                continue
            for start in range(0, max(info.size, 1), self.split):
                size = min(self.split, info.size - start)
                if not out or held + size > self.split:
                    out.append(Split([]))
                    held = 0
                out[-1].ranges.append((scheme + info.path, start, start + self.split))
                held += size + OPEN_COST
        return out

    def read(self, split: Split | None) -> Iterator[pa.RecordBatch]:
        from folio.sources.stores import _filesystem

        for path, start, end in split.ranges if split else ():  # no split is given where there is none
            files, at = _filesystem(path)
            with files.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                for entry in z.infolist():
                    if start <= entry.header_offset < end and entry.filename.endswith(".json"):
                        htid = ids.extract_text(entry.filename)
                        if self._wants("htid", htid):
                            yield from self._texts(htid, z.read(entry)) if self.kind == "texts" else self._tokens(htid, z.read(entry))

    def _texts(self, htid: str, data: bytes) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array([htid]), pa.array([data.decode()], pa.string())], schema=self.schema)

    def _tokens(self, htid: str, data: bytes) -> Iterator[pa.RecordBatch]:
        """A batch a page: beside the parsed volume, a page's rows are held."""
        for page in (json.loads(data).get("features") or {}).get("pages") or ():
            number = None if page.get("seq") is None else int(page["seq"])
            if not self._wants("page", number):
                continue
            rows = [
                (section, token, pos, n)
                for section in SECTIONS
                if self._wants("section", section)
                for token, uses in ((page.get(section) or {}).get("tokenPosCount") or {}).items()
                for pos, n in (uses or {}).items()
            ]
            if rows:
                section, token, pos, n = zip(*rows, strict=True)
                yield pa.record_batch([pa.array([htid] * len(rows)), pa.array([number] * len(rows), pa.int32()), pa.array(section), pa.array(token), pa.array(pos), pa.array(n, pa.int64())], schema=self.schema)


class ArchiveSource(D.DataSource):
    """Options: ``path`` (folder of archives), ``kind`` (texts or tokens), ``splitBytes``, ``hashed`` (archives are named by their ids' hash)."""

    @classmethod
    def name(cls) -> str:
        return "folio_archives"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "texts")]

    def reader(self, schema) -> ArchiveReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = self.options.get("kind", "texts")
        return ArchiveReader(self.options["path"], kind, int(self.options.get("splitbytes", SPLIT_BYTES)), self.options.get("hashed", "false") == "true", to_arrow_schema(schema))


def read_archives(spark: SparkSession, root: str, kind: str = "texts", hashed: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The volumes (htid, value) or the token rows of all archives in ``root``. Allows data sources in Python to take filters, for the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("folio_archives").options(path=root, kind=kind, hashed=str(hashed).lower(), splitBytes=split_bytes).load()
