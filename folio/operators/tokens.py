"""Folding token counts: by page or chunk, section, case and part of speech, for all volumes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.model import SECTIONS, MissingFieldError


def _require(df: DataFrame, column: str, what: str) -> None:
    if column not in df.columns:
        raise MissingFieldError(f"{what} needs the column {column}")


def tokenlist(
    tokens: DataFrame, *, pages: bool = True, section: str = "default", case: bool = True, pos: bool = True, page_freq: bool = False, page_select: int | None = None,
    drop_section: bool = False, htid: bool = True, chunk: bool = False, chunk_target: int = 10_000, overflow_strategy: str = "ends", page_ref: bool = False,
    default_section: str = "body", freq: str = "pages",
) -> DataFrame:
    """Sum of ``count`` by [htid, page or chunk, section, token or lowercase, pos].

    ``section``: a section name filters and stays a key, ``all`` keeps all as a key, ``group`` sums over them. ``page_freq``
    counts pages instead (1 where pages are keys); ``freq='rows'`` counts stored rows. ``page_select`` keeps one page (0 and
    None: all). ``drop_section`` drops the column without summing again. The result's schema does not depend on whether
    rows match. Missing dimensions raise MissingFieldError, unknown sections ValueError.
    """
    if page_select and not pages:
        raise AssertionError("page_select needs pages")
    place = "page" if "page" in tokens.columns else "chunk" if "chunk" in tokens.columns else None
    if pages or page_select or page_freq:
        if place is None:
            raise MissingFieldError("pages are folded in this table")
    word = "token" if case else "lowercase"
    if case:
        _require(tokens, "token", "case")
    elif "token" not in tokens.columns:
        _require(tokens, "lowercase", "folded case")
    if pos:
        _require(tokens, "pos", "pos")
    df = tokens
    keyed = False
    if "section" in df.columns:
        section = default_section if section == "default" else section
        if section in SECTIONS:
            df, keyed = df.where(F.col("section") == section), True
        elif section == "all":
            keyed = True
        elif section != "group":
            raise ValueError(f"no such section: {section}")
    elif section != "default":
        raise MissingFieldError("sections are folded in this table")
    if page_select:
        df = df.where(F.col(place) == page_select)
    if not case:
        df = df.withColumn("lowercase", F.lower("token")) if "token" in df.columns else df
    own = ["htid"] if "htid" in df.columns else []
    keys = [*own, *([place] if pages else []), *(["section"] if keyed else []), word, *(["pos"] if pos else [])]
    if page_freq and pages:
        out = df.select(*keys).distinct().withColumn("count", F.lit(1).cast("long"))
    elif page_freq:
        out = df.groupBy(*keys).agg((F.count("*") if freq == "rows" else F.count_distinct(place)).alias("count"))
    elif chunk or set(keys) == set(tokens.columns) - {"count"}:
        out = df.select(*keys, F.col("count").cast("long").alias("count"))  # nothing folds, or chunks do: no aggregate, no shuffle
    else:
        out = df.groupBy(*keys).agg(F.sum("count").cast("long").alias("count"))
    if chunk:
        from folio.operators.chunking import chunk_tokenlist

        if place != "page" or not pages:
            raise MissingFieldError("chunking needs pages")
        out = chunk_tokenlist(out, chunk_target, overflow_strategy, page_ref)
    if drop_section:
        _require(out, "section", "drop_section")
        out = out.drop("section")
    return out if htid else out.drop("htid")


def tokenlist_cube(tokens: DataFrame) -> DataFrame:
    """All foldings of (page, section, token, pos) at once, with ``grouping_id``: an addition."""
    base = tokens.groupBy("page", "section", "token", "pos").agg(F.sum("count").alias("count"))  # sixteen foldings of few rows
    return base.cube("page", "section", "token", "pos").agg(F.grouping_id().alias("grouping_id"), F.sum("count").alias("count"))


def page_bitmaps(tokens: DataFrame) -> DataFrame:
    """htid, section, token, pos, block, bits: which pages of each 64 have the word, to be stored and merged over any of the keys."""
    keys = [c for c in ("htid", "section", "token", "lowercase", "pos") if c in tokens.columns]
    bit = F.expr("shiftleft(1L, cast(pmod(page, 64) as int))")
    return tokens.groupBy(*keys, F.floor(F.col("page") / 64).alias("block")).agg(F.bit_or(bit).alias("bits"))


def bitmap_page_freqs(bitmaps: DataFrame, section: str = "default", case: bool = True, pos: bool = True, default_section: str = "body") -> DataFrame:
    """Distinct pages by [htid, section, token or lowercase, pos] from :func:`page_bitmaps`: bits are or'ed over what folds, then counted. No page row is read."""
    section = default_section if section == "default" else section
    df = bitmaps
    if section in SECTIONS:
        df = df.where(F.col("section") == section)
    elif section not in ("all", "group"):
        raise ValueError(f"no such section: {section}")
    if not case and "token" in df.columns:
        df = df.withColumn("lowercase", F.lower("token"))
    word = "token" if case else "lowercase"
    _require(df, word, "folded case" if not case else "case")
    keys = ["htid", *(["section"] if section != "group" else []), word, *(["pos"] if pos else [])]
    merged = df.groupBy(*keys, "block").agg(F.bit_or("bits").alias("bits"))
    return merged.groupBy(*keys).agg(F.sum(F.bit_count("bits")).cast("long").alias("count"))


def vocabulary(words: DataFrame, word: str = "token", parts: int = 256) -> DataFrame:
    """``word`` and ``index`` from 0: every distinct word numbered. Parts of the words are numbered side by side; only ``parts`` counts meet in one task."""
    part = F.pmod(F.xxhash64(word), F.lit(parts))
    dealt = words.select(word).distinct().withColumn("part", part)
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(word)) - 1
    return dealt.withColumn("own", own).join(F.broadcast(before), "part").select(word, (F.col("before") + F.col("own")).alias("index"))


def sparse_rows(long: DataFrame, words: DataFrame, keys: tuple[str, ...] = ("htid",), word: str = "token", count: str = "count") -> DataFrame:
    """A term matrix over a whole vocabulary (:func:`vocabulary`): ``keys``, ``indices`` (rising) and ``values``, one row a volume or page; words outside it are left out."""
    entry = F.struct("index", F.col(count).cast("long").alias("value"))
    rows = long.join(words, word).groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("x"))
    return rows.select(*keys, F.col("x.index").alias("indices"), F.col("x.value").alias("values"))


def term_page_freqs(tokens: DataFrame, page_freq: bool = True, case: bool = True, default_section: str = "body") -> DataFrame:
    """htid, page, term, count in long form: 1 or the number of uses."""
    section = "group" if default_section == "all" else "default"
    out = tokenlist(tokens, pos=False, case=case, page_freq=page_freq, section=section, default_section=default_section)
    return out.select("htid", "page", F.col("token" if case else "lowercase").alias("term"), "count")


def term_page_matrix(tokens: DataFrame, terms: list[str], page_freq: bool = True, case: bool = True) -> DataFrame:
    """htid, page and one column per given term, zero where it is missing; rows are the pages with any token."""
    long = term_page_freqs(tokens, page_freq, case)
    return long.groupBy("htid", "page").agg(*[F.coalesce(F.sum(F.when(F.col("term") == t, F.col("count"))), F.lit(0)).alias(t) for t in terms])


def term_volume_freqs(tokens: DataFrame, page_freq: bool = True, pos: bool = True, case: bool = True) -> DataFrame:
    """Per volume and term: number of pages, or of uses."""
    paged = tokenlist(tokens, pos=pos, case=case, page_freq=page_freq)
    keys = ["htid", "token" if case else "lowercase", *(["pos"] if pos else [])]
    return paged.groupBy(*keys).agg(F.sum("count").alias("count"))


def distinct_tokens(tokens: DataFrame, section: str = "default", case: bool = True, page_select: int | None = None, min_count: int = 1) -> DataFrame:
    """htid and its distinct terms; with ``min_count`` those with that many uses in the rows selected."""
    rows = tokenlist(tokens, section=section, case=case, pos=False, page_select=page_select)
    word = "token" if case else "lowercase"
    if min_count <= 1:
        return rows.select("htid", word).distinct()
    return rows.groupBy("htid", word).agg(F.sum("count").alias("n")).where(F.col("n") >= min_count).select("htid", word)


def tokens_per_page(tokens: DataFrame, section_features: DataFrame | None = None, section: str = "body") -> DataFrame:
    """htid, page, count: from the section features (pages without tokens are 0), else from the token table (they are absent)."""
    if section_features is not None:
        return section_features.where(F.col("section") == section).select("htid", "page", F.col("tokenCount").cast("long").alias("count"))
    return tokens.where(F.col("section") == section).groupBy("htid", "page").agg(F.sum("count").alias("count"))


def fold_pages(tables: list[DataFrame], chunk_name: str) -> DataFrame:
    """Several page token lists as one chunk."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    keys = [c for c in out.columns if c not in ("page", "count")]
    return out.groupBy(*keys).agg(F.sum("count").alias("count")).withColumn("chunk", F.lit(chunk_name))
