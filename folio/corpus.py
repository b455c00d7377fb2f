"""A corpus of volumes, a volume and a page as views on the canonical tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import config
from folio.functions.ids import file_or_id
from folio.model import MissingDataError
from folio.operators import analysis
from folio.operators import features as feats
from folio.operators import tokens as toks
from folio.sources import metadata, stores, volumes


class Corpus:
    """Lazy tables of many volumes: ``tokens``, ``chars``, ``sections``, ``pages``, ``volumes``. Missing ones raise MissingDataError."""

    def __init__(self, tables: dict[str, DataFrame], default_section: str = "body", raw: DataFrame | None = None):
        self._tables, self.default_section, self.raw = tables, default_section, raw
        self._whole = False  # whether the tables are the nested texts' own

    @classmethod
    def from_raw(cls, raw: DataFrame, **kw) -> Corpus:
        """From nested texts (htid, value)."""
        made = {"tokens": volumes.tokens(raw), "chars": volumes.line_chars(raw), "sections": volumes.section_features(raw), "page_features": volumes.page_features(raw), "pages": volumes.page_list(raw), "volumes": metadata.volumes(raw)}
        out = cls(made, raw=raw, **kw)
        out._whole = True
        return out

    @classmethod
    def from_paths(cls, spark: SparkSession, paths: str | list[str], **kw) -> Corpus:
        """From volume files; the order of ``paths`` is not kept by queries, which carry the id instead."""
        paths = [paths] if isinstance(paths, str) else list(paths)
        if not paths:
            raise AssertionError("no paths")
        return cls.from_raw(volumes.read_files(spark, paths), **kw)

    @classmethod
    def from_handler(cls, spark: SparkSession, paths: str | list[str], parse: Callable[[bytes], str], **kw) -> Corpus:
        """From files of any format: ``parse`` makes a file's bytes a nested text, on the executors."""
        return cls.from_raw(volumes.read_with(spark, paths, parse), **kw)

    @classmethod
    def open(cls, spark: SparkSession, paths: str | list[str] | None = None, ids: list[str] | None = None, store: stores.Store | None = None, format: str | None = None, compression: str | None = None, **kw) -> Corpus:
        """From ``paths`` or from ``ids`` (in a ``store``, or below ``root`` in a layout), but not from both.

        What ``format`` and ``compression`` leave open is learnt from the first path's name; if they don't agree with it,
        TypeError is raised.
        """
        if (paths is None) == (ids is None):
            raise TypeError("either paths or ids")
        if ids is not None:
            if store is not None:
                return cls.from_raw(store.get(spark.createDataFrame([(i,) for i in ids], "htid string")), **kw)
            return cls.from_ids(spark, ids, **kw | ({"compression": compression} if compression else {}))
        if store is not None:
            raise TypeError("a store is asked for ids")
        paths = [paths] if isinstance(paths, str) else list(paths)
        own = config.learn(paths[0]) if paths and "." in paths[0].rsplit("/", 1)[-1] else {}
        for name, given in (("format", format), ("compression", compression)):
            if given is not None and own and own[name] != given:
                raise TypeError(f"{name} is {own[name]} by the first path's name, not {given}")
        if (format or own.get("format", "json")) == "parquet":
            if len(paths) > 1:
                raise TypeError("one folder of tables")
            return cls.from_tables(spark, paths[0], **kw)
        return cls.from_paths(spark, paths, **kw)

    @classmethod
    def from_ids(cls, spark: SparkSession, ids: list[str], root: str, layout: str = "stubbytree", compression: str | None = "bz2", **kw) -> Corpus:
        from folio.functions.ids import path_text

        for i in ids:
            if file_or_id(i) != "id":
                raise NameError(i)
        return cls.from_paths(spark, [f"{root}/{path_text(i, layout, 'json', compression)}" for i in ids], **kw)

    @classmethod
    def from_tables(cls, spark: SparkSession, folder: str, **kw) -> Corpus:
        """From Parquet tables as :meth:`save` writes them; those that are not there are missing."""
        made = {}
        for name, kind in (("tokens", "tokens"), ("chars", "chars"), ("sections", "section"), ("volumes", "meta")):
            try:
                made[name] = stores.read_table(spark, folder, kind)
            except MissingDataError:
                continue
        return cls(made, **kw)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise MissingDataError(name)
        return self._tables[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("tokens", "chars", "sections", "page_features", "pages", "volumes"):
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def ids(self) -> DataFrame:
        return next(iter(self._tables.values())).select("htid").distinct()

    def first(self) -> Volume:
        """The volume with the least id."""
        found = self.ids.orderBy("htid").first()
        if found is None:
            raise MissingDataError("the corpus has no volume")
        return self.volume(found["htid"])

    def random_rows(self, k: int = 10, seed: int | None = None) -> DataFrame:
        """Some rows of the token table, drawn at random."""
        return analysis.random_rows(self.tokens, k, seed)

    def persist(self) -> Corpus:
        """Keeps the tables once computed."""
        self._tables = {k: v.persist() for k, v in self._tables.items()}
        return self

    def register(self, prefix: str = "") -> None:
        """The tables as SQL views."""
        for k, v in self._tables.items():
            v.createOrReplaceTempView(f"{prefix}{k}")

    def jsons(self, parsed: bool = True) -> DataFrame:
        """htid and the nested document: VARIANT, or the text."""
        if self.raw is None:
            raise MissingDataError("nested texts")
        return volumes.variants(self.raw) if parsed else self.raw

    def tokenlist(self, **kw) -> DataFrame:
        return toks.tokenlist(self.tokens, **{"default_section": self.default_section} | kw)

    def term_page_freqs(self, **kw) -> DataFrame:
        return toks.term_page_freqs(self.tokens, **{"default_section": self.default_section} | kw)

    def term_volume_freqs(self, **kw) -> DataFrame:
        return toks.term_volume_freqs(self.tokens, **kw)

    def distinct_tokens(self, **kw) -> DataFrame:
        return toks.distinct_tokens(self.tokens, **kw)

    def tokens_per_page(self) -> DataFrame:
        return toks.tokens_per_page(self._tables.get("tokens"), self._tables.get("sections"), self.default_section)

    def section_features(self, **kw) -> DataFrame:
        return feats.section_features(self.sections, **{"default_section": self.default_section} | kw)

    def line_chars(self, **kw) -> DataFrame:
        return feats.line_chars(self.chars, **{"default_section": self.default_section} | kw)

    def begin_line_chars(self, **kw) -> DataFrame:
        return self.line_chars(place="begin", **kw)

    def end_line_chars(self, **kw) -> DataFrame:
        return self.line_chars(place="end", **kw)

    def map_volumes(self, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, **kw) -> DataFrame:
        """``fn`` on each volume's token list."""
        return self.tokenlist(**kw).groupBy("htid").applyInPandas(fn, schema)

    def save(self, folder: str, files: tuple[str, ...] | None = None, token_kwargs: dict | None = None, compression: str | None = None, mode: str = "errorifexists", format: str = "parquet", layout: str = "stubbytree") -> None:
        """Parquet tables (by default meta and tokens; tokens are folded by ``token_kwargs`` first, all sections unless it says otherwise), or with ``format='json'`` the nested texts in a layout."""
        if format == "json":
            if files or token_kwargs:
                raise TypeError("nested texts are saved whole")
            stores.copy_volumes(None, self.jsons(parsed=False), folder, layout, compression or "bz2")
            return
        if format != "parquet":
            raise ValueError(f"no such format: {format}")
        files, compression = files or ("meta", "tokens"), compression or "snappy"
        kinds = tuple(k for k in ("tokens", "chars", "section") if k in files or (k == "section" and "section_features" in files))
        if self.raw is not None and len(kinds) > 1 and not token_kwargs and self._whole:
            stores.write_in_one_pass(self.raw, folder, kinds, compression, mode)  # every text is parsed once
            if "meta" in files:
                stores.write_tables({"meta": self.volumes}, folder, compression, "append")
            return
        made = {}
        if "meta" in files:
            made["meta"] = self.volumes
        if "tokens" in files:
            made["tokens"] = self.tokenlist(**{"section": "all"} | (token_kwargs or {}))
        if "chars" in files:
            made["chars"] = self.chars
        if "section" in files or "section_features" in files:
            made["section"] = self.sections
        stores.write_tables(made, folder, compression, mode)

    def printed(self) -> DataFrame:
        """A line of text and of HTML for each volume."""
        return metadata.printed(self.volumes)

    def volume(self, htid: str) -> Volume:
        return Volume({k: v.where(F.col("htid") == htid) for k, v in self._tables.items()}, self.default_section, self.raw.where(F.col("htid") == htid) if self.raw is not None else None)


class Volume(Corpus):
    """One volume: the corpus tables, filtered."""

    def page(self, seq: int) -> Page:
        return Page(self, seq)

    @property
    def year(self) -> DataFrame:
        return self.volumes.select("year")

    @property
    def author(self) -> DataFrame:
        return self.volumes.select("author")


class Page:
    """One page of a volume."""

    def __init__(self, volume: Volume, seq: int):
        self.volume, self.seq = volume, seq

    def printed(self) -> DataFrame:
        """The page in one line of text."""
        return metadata.printed_pages(self.volume.pages.where(F.col("page") == self.seq))

    def tokenlist(self, **kw) -> DataFrame:
        return self.volume.tokenlist(page_select=self.seq, **kw)

    def tokens(self, **kw) -> DataFrame:
        return self.volume.distinct_tokens(page_select=self.seq, **kw)

    def line_chars(self, **kw) -> DataFrame:
        return self.volume.line_chars(page_select=self.seq, **kw)

    def section_features(self, **kw) -> DataFrame:
        return self.volume.section_features(page_select=self.seq, **kw)

    def token_count(self) -> DataFrame:
        return self.section_features(feature="tokenCount")

    def line_count(self, **kw) -> DataFrame:
        return self.section_features(feature="lineCount", **kw)

    def empty_line_count(self, **kw) -> DataFrame:
        return self.section_features(feature="emptyLineCount", **kw)

    def cap_alpha_seq(self) -> DataFrame:
        """Of the body: the count is kept for no other section."""
        return self.section_features(feature="capAlphaSeq", section="body")

    def sentence_count(self, **kw) -> DataFrame:
        return self.section_features(feature="sentenceCount", **kw)

    def begin_line_chars(self, **kw) -> DataFrame:
        return self.line_chars(place="begin", **kw)

    def end_line_chars(self, **kw) -> DataFrame:
        return self.line_chars(place="end", **kw)

    def page_features(self) -> DataFrame:
        return feats.page_features(self.volume.page_features, page_select=self.seq)
