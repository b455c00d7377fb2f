"""Scans of nested volume files into the canonical tables.

Each table is parsed with its own narrow schema, so a query on section counts never builds token maps. Schemas are
explicit: inference would turn every token into a field.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.ids import extract_htid
from folio.model import SECTIONS

_CHARS = "map<string,bigint>"
_SECTION = {
    "tokens": "tokenPosCount:map<string,map<string,bigint>>",
    "line_chars": ",".join(f"{name}:{_CHARS}" for name in ("beginLineChars", "endLineChars", "beginCharCounts", "beginCharCount", "endCharCount")),
    "section_features": "tokenCount:int,lineCount:int,emptyLineCount:int,capAlphaSeq:int,sentenceCount:int",
}


def _schema(table: str) -> str:
    """What to parse for a table, and no more."""
    page = "seq:string"
    if table in _SECTION:
        page += "".join(f",{s}:struct<{_SECTION[table]}>" for s in SECTIONS)
    elif table == "page_features":
        page += ",languages:string,calculatedLanguage:string,version:string"
    return f"id string, htid string, features struct<schemaVersion:string,pageCount:int,pages:array<struct<{page}>>>"


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """htid (from the file name), value: one nested text per file; .gz and .bz2 are decompressed by name.

    Encoded ids hold ``=``, which would make partition columns, so folders are listed recursively instead.
    """
    df = spark.read.option("recursiveFileLookup", "true").text(paths, wholetext=True)
    return df.select(extract_htid(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).alias("htid"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_files` for text files with one volume a line: what to use for very many volumes."""
    df = spark.read.text(path).select("value", F.json_tuple("value", "htid", "id").alias("htid", "id"))
    return df.select(F.coalesce("htid", "id").alias("htid"), "value")


def read_with(spark: SparkSession, paths: str | list[str], parse: Callable[[bytes], str]) -> DataFrame:
    """As :func:`read_files`, with a caller's handler for each file's bytes."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"htid": pdf["htid"], "value": [parse(bytes(x)) for x in pdf["content"]]})

    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return df.select(extract_htid(F.element_at(F.split("path", "/"), -1)).alias("htid"), "content").mapInPandas(task, "htid string, value string")


def _pages(raw: DataFrame, table: str) -> DataFrame:
    v = F.from_json("value", _schema(table))
    rows = raw.select("htid", v.alias("v")).select("htid", F.col("v.features.schemaVersion").alias("version"), F.explode("v.features.pages").alias("p"))
    return rows.select("htid", "version", F.col("p.seq").cast("int").alias("page"), "p")


def _sections(raw: DataFrame, table: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.col(f"p.{s}").alias("s")) for s in SECTIONS])).alias("x")
    return _pages(raw, table).select("htid", "version", "page", each).where("x.s is not null").select("htid", "version", "page", "x.section", "x.s")


def tokens(raw: DataFrame, truncate: bool = False) -> DataFrame:
    """htid, page, section, token, pos, count. ``truncate`` cuts tokens at 64 characters, as fixed-width stores do."""
    rows = _sections(raw, "tokens").select("htid", "page", "section", F.explode("s.tokenPosCount").alias("token", "m"))
    rows = rows.select("htid", "page", "section", "token", F.explode("m").alias("pos", "count"))
    return rows.withColumn("token", F.substring("token", 1, 64)) if truncate else rows


def line_chars(raw: DataFrame) -> DataFrame:
    """htid, page, section, place, char, count; the maps' names differ by schema version."""
    s = F.col("s")
    begin: Column = F.coalesce(s["beginCharCounts"], s["beginCharCount"], s["beginLineChars"])
    end: Column = F.coalesce(s["endCharCount"], s["endLineChars"])
    rows = _sections(raw, "line_chars").select("htid", "page", "section", F.explode(F.array(F.struct(F.lit("begin").alias("place"), begin.alias("m")), F.struct(F.lit("end").alias("place"), end.alias("m")))).alias("x"))
    return rows.select("htid", "page", "section", "x.place", F.explode("x.m").alias("char", "count"))


def section_features(raw: DataFrame) -> DataFrame:
    return _sections(raw, "section_features").select("htid", "page", "section", "s.*")


def page_features(raw: DataFrame) -> DataFrame:
    return _pages(raw, "page_features").select("htid", "page", "p.languages", "p.calculatedLanguage", "p.version")


def page_list(raw: DataFrame) -> DataFrame:
    """All pages, also empty ones."""
    return _pages(raw, "pages").select("htid", "page")


_STATS = ("tokenCount", "lineCount", "emptyLineCount", "capAlphaSeq", "sentenceCount")
#: The columns of each kind of row that :func:`tagged` gives.
KIND_COLUMNS = {
    "tokens": ("htid", "page", "section", "token", "pos", "count"), "chars": ("htid", "page", "section", "place", "char", "count"),
    "section": ("htid", "page", "section", *_STATS), "pages": ("htid", "page", "languages", "calculatedLanguage", "version"),
}


def tagged(raw: DataFrame, kinds: tuple[str, ...] = ("tokens", "chars", "section", "pages")) -> DataFrame:
    """The rows of several tables from one parse of each text: ``kind`` and all tables' columns, null where a kind lacks them.

    The schema parsed covers the kinds asked for only. Rows are made page by page, so beside a volume's text and its
    parsed form a task holds one page's rows.
    """
    parts = ["tokens" if k == "tokens" else "line_chars" if k == "chars" else "section_features" for k in kinds if k != "pages"]
    page = "seq:string,languages:string,calculatedLanguage:string,version:string" if "pages" in kinds else "seq:string"
    page += "".join(f",{s}:struct<{','.join(_SECTION[p] for p in parts)}>" for s in SECTIONS) if parts else ""
    rows = raw.select("htid", F.from_json("value", f"features struct<pages:array<struct<{page}>>>").alias("v")).select("htid", F.explode("v.features.pages").alias("p"))
    columns = list(dict.fromkeys(c for k in kinds for c in KIND_COLUMNS[k] if c not in ("htid", "page")))
    types = {"count": "bigint"} | dict.fromkeys(_STATS, "int")

    def row(kind: str, **own: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), *[own.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c) for c in columns])

    made = []
    for name in SECTIONS if parts else ():
        x = F.col(f"p.{name}")
        if "tokens" in kinds:
            uses = F.flatten(F.transform(F.map_entries(x["tokenPosCount"]), lambda t: F.transform(F.map_entries(t["value"]), lambda c: F.struct(t["key"].alias("token"), c["key"].alias("pos"), c["value"].alias("count")))))
            made.append(F.transform(uses, lambda u: row("tokens", section=F.lit(name), token=u["token"], pos=u["pos"], count=u["count"])))
        if "chars" in kinds:
            for place, maps in (("begin", ("beginCharCounts", "beginCharCount", "beginLineChars")), ("end", ("endCharCount", "endLineChars"))):
                found = F.map_entries(F.coalesce(*[x[m] for m in maps]))
                made.append(F.transform(found, lambda c: row("chars", section=F.lit(name), place=F.lit(place), char=c["key"], count=c["value"])))
        if "section" in kinds:
            made.append(F.when(x.isNotNull(), F.array(row("section", section=F.lit(name), **{c: x[c] for c in _STATS}))))
    if "pages" in kinds:
        made.append(F.array(row("pages", **{c: F.col(f"p.{c}") for c in ("languages", "calculatedLanguage", "version")})))
    each = F.explode(F.flatten(F.filter(F.array(*made), lambda m: m.isNotNull()))).alias("r")
    return rows.select("htid", F.col("p.seq").cast("int").alias("page"), each).select("r.kind", "htid", "page", *[f"r.{c}" for c in columns])


def of_kind(rows: DataFrame, kind: str) -> DataFrame:
    """One table of :func:`tagged` rows."""
    return rows.where(F.col("kind") == kind).select(*KIND_COLUMNS[kind])


def variants(raw: DataFrame) -> DataFrame:
    """htid, doc: the whole nested text as VARIANT."""
    return raw.select("htid", F.parse_json("value").alias("doc"))
