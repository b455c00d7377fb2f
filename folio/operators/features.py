"""Section, page and line-character features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.model import SECTION_STATS, SECTIONS


def section_features(features: DataFrame, feature: str = "all", section: str = "default", page_select: int | None = None, default_section: str = "body") -> DataFrame:
    """One section's rows (its column dropped), ``all`` sections, or their ``group`` sum per page (a sum of nulls is 0)."""
    section = default_section if section == "default" else section
    stats = list(SECTION_STATS) if feature == "all" else [feature]
    df = features.where(F.col("page") == page_select) if page_select else features
    if section in SECTIONS:
        return df.where(F.col("section") == section).select("htid", "page", *stats)
    if section == "group":
        return df.groupBy("htid", "page").agg(*[F.coalesce(F.sum(s), F.lit(0)).cast("long").alias(s) for s in stats])
    if section == "all":
        return df.select("htid", "page", "section", *stats)
    raise ValueError(f"no such section: {section}")


def page_features(features: DataFrame, feature: str = "all", page_select: int | None = None) -> DataFrame:
    df = features.where(F.col("page") == page_select) if page_select else features
    return df if feature == "all" else df.select("htid", "page", feature)


def line_counts(features: DataFrame, **kw) -> DataFrame:
    return section_features(features, "lineCount", **kw)


def empty_line_counts(features: DataFrame, **kw) -> DataFrame:
    return section_features(features, "emptyLineCount", **kw)


def cap_alpha_seqs(features: DataFrame) -> DataFrame:
    """Of the body: the count is kept for no other section."""
    return section_features(features, "capAlphaSeq", section="body")


def sentence_counts(features: DataFrame, **kw) -> DataFrame:
    return section_features(features, "sentenceCount", **kw)


def token_freqs(features: DataFrame) -> DataFrame:
    return features.select("htid", "page", "section", F.col("tokenCount").cast("long").alias("count"))


def line_chars(chars: DataFrame, section: str = "default", place: str = "all", page_select: int | None = None, default_section: str = "body") -> DataFrame:
    """Character counts by page, section and place; ``group`` sums over sections or places."""
    section = default_section if section == "default" else section
    df = chars
    if section in SECTIONS:
        df = df.where(F.col("section") == section)
    elif section not in ("all", "group"):
        raise ValueError(f"no such section: {section}")
    if place in ("begin", "end"):
        df = df.where(F.col("place") == place)
    elif place not in ("all", "group"):
        raise ValueError(f"no such place: {place}")
    if page_select:
        df = df.where(F.col("page") == page_select)
    keys = ["htid", "page", *(["section"] if section != "group" else []), *(["place"] if place != "group" else []), "char"]
    if "group" in (section, place):
        return df.groupBy(*keys).agg(F.sum("count").alias("count"))
    return df.select(*keys, "count")
