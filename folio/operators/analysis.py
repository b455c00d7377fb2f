"""Corpus analyses built on the folded tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.tokens import tokenlist


def pos_totals(tokens: DataFrame, section: str = "body") -> DataFrame:
    """Tokens by part of speech over all volumes."""
    return tokens.where(F.col("section") == section).groupBy("pos").agg(F.sum("count").alias("count"))


def proper_nouns(tokens: DataFrame, tags: tuple[str, ...] = ("NNP", "NNPS"), min_count: int = 2) -> DataFrame:
    """htid, token, count of proper nouns used at least ``min_count`` times in the volume."""
    rows = tokenlist(tokens, pages=False).where(F.col("pos").isin(*tags))
    return rows.groupBy("htid", "token").agg(F.sum("count").alias("count")).where(F.col("count") >= min_count)


def document_frequency(rows: DataFrame, word: str = "token") -> DataFrame:
    """Volumes by word."""
    return rows.groupBy(word).agg(F.count_distinct("htid").alias("volumes"))


def whitelist(tokens: DataFrame, min_total: int, min_length: int = 3) -> DataFrame:
    """Alphabetic words with a lower-case ASCII letter, longer than two characters, with more than ``min_total`` uses in the corpus."""
    totals = tokenlist(tokens, pages=False, pos=False).groupBy("token").agg(F.sum("count").alias("total"))
    return totals.where((F.col("total") > min_total) & F.col("token").rlike(r"^\p{L}+$") & F.col("token").rlike("[a-z]") & (F.length("token") >= min_length)).select("token")


def doc_term_whitelist(tokens: DataFrame, min_total: int) -> DataFrame:
    """htid, token, count of whitelisted words: a document-term matrix in long form."""
    counts = tokenlist(tokens, pages=False, pos=False).groupBy("htid", "token").agg(F.sum("count").alias("count"))
    return counts.join(whitelist(tokens, min_total), "token", "left_semi").select("htid", "token", "count")


def line_chars_tenths(chars: DataFrame, volumes: DataFrame) -> DataFrame:
    """Character counts by place and tenth of the volume, for volumes of ten pages and more."""
    n = F.col("page_count")
    band = F.least(F.lit(10), F.floor((F.col("page") - 1) / F.floor(n / 10)) + 1).cast("int")
    rows = chars.join(volumes.where(n >= 10).select("htid", "page_count"), "htid")
    return rows.groupBy("htid", "place", "char", band.alias("band")).agg(F.sum("count").alias("count"))


def long_pages(totals: DataFrame, share: float = 0.8) -> DataFrame:
    """htid, page, total of pages with more than ``share`` of their volume's mean."""
    mean = F.avg("total").over(Window.partitionBy("htid"))
    return totals.withColumn("mean", mean).where(F.col("total") > share * F.col("mean")).select("htid", "page", "total")


#: Up to so many words a lexicon also filters the tokens before they are summed.
LISTED_WORDS = 10_000


def page_sentiment(tokens: DataFrame, lexicon: DataFrame, section: str = "body") -> DataFrame:
    """htid, page, sentiment: the sum of count times valence of ``lexicon`` (token, valence) over a section's folded words."""
    words = [r["token"] for r in lexicon.select("token").distinct().limit(LISTED_WORDS + 1).collect()]
    rows = tokens.where(F.col("section") == section)
    if len(words) <= LISTED_WORDS:  # a filter on the words alone passes below the tokens' own aggregate
        rows = rows.where(F.lower("token").isin(words))
    rows = rows.select("htid", "page", F.lower("token").alias("token"), "count")
    return rows.join(lexicon, "token").groupBy("htid", "page").agg(F.sum(F.col("count") * F.col("valence")).alias("sentiment"))


def moving_average(rows: DataFrame, value: str, window: int = 20) -> DataFrame:
    """``rows`` with ``seq`` (place among the volume's rows) and ``average`` of the last ``window`` values."""
    w = Window.partitionBy("htid").orderBy("page")
    return rows.withColumn("seq", F.row_number().over(w)).withColumn("average", F.avg(value).over(w.rowsBetween(1 - window, 0)))


def smoothed(x: np.ndarray, y: np.ndarray, share: float = 0.3) -> np.ndarray:
    """Locally weighted linear regression at every x (sorted), with tricube weights over the nearest ``share`` of the points.

    The nearest points are a window of the sorted ones, which moves on with x; windows are handled in blocks.
    """
    n = len(x)
    k = min(n, max(2, int(np.ceil(share * n))))
    low, at = np.zeros(n, np.int64), 0
    for i in range(n):
        while at + k < n and x[at + k] - x[i] < x[i] - x[at]:
            at += 1
        low[i] = at
    out = np.zeros(n)
    for a in range(0, n, block := max(1, 1_000_000 // max(k, 1))):
        own = low[a : a + block, None] + np.arange(k)
        px, py, here = x[own], y[own], x[a : a + block, None]
        d = np.abs(px - here)
        w = np.clip(1 - (d / np.maximum(d.max(axis=1, keepdims=True), 1e-9)) ** 3, 0, 1) ** 3
        total = w.sum(axis=1)
        mx, my = (w * px).sum(axis=1) / total, (w * py).sum(axis=1) / total
        dx = px - mx[:, None]
        var = (w * dx**2).sum(axis=1) / total
        cov = (w * dx * (py - my[:, None])).sum(axis=1) / total
        out[a : a + block] = my + np.where(var > 1e-12, cov / np.where(var > 1e-12, var, 1), 0) * (here[:, 0] - mx)
    return out


def robustly_smoothed(x: np.ndarray, y: np.ndarray, share: float = 0.3, passes: int = 3) -> np.ndarray:
    """As :func:`smoothed`, with ``passes`` more fits, each weighting points by the bisquare of their residuals (six median residuals are the reach).

    A window holds ``share`` of the points, rounded down; where all of its weights vanish, the point itself stays.
    """
    n = len(x)
    k = min(n, max(2, int(share * n + 1e-10)))
    low, at = np.zeros(n, np.int64), 0
    for i in range(n):
        while at + k < n and x[at + k] - x[i] < x[i] - x[at]:
            at += 1
        low[i] = at
    weight, out = np.ones(n), y.astype(np.float64).copy()
    for turn in range(passes + 1):
        for a in range(0, n, block := max(1, 1_000_000 // max(k, 1))):
            own = low[a : a + block, None] + np.arange(k)
            px, py, here = x[own], y[own], x[a : a + block]
            d = np.abs(px - here[:, None])
            reach = d.max(axis=1, keepdims=True)
            w = np.clip(1 - (d / np.where(reach > 0, reach, 1)) ** 3, 0, 1) ** 3 * weight[own]
            total = w.sum(axis=1)
            fine = total > 0
            total = np.where(fine, total, 1)
            mx, my = (w * px).sum(axis=1) / total, (w * py).sum(axis=1) / total
            dx = px - mx[:, None]
            var, cov = (w * dx**2).sum(axis=1) / total, (w * dx * (py - my[:, None])).sum(axis=1) / total
            sloped = var > 1e-12 * np.maximum(reach[:, 0], 1e-9) ** 2
            fit = my + np.where(sloped, cov / np.where(sloped, var, 1), 0) * (here - mx)
            out[a : a + block] = np.where(fine, fit, y[a : a + block])
        if turn < passes:
            left = np.abs(y - out)
            middle = np.median(left)
            if middle < 1e-12 * max(1.0, np.abs(y).max()):  # at least half of the points lie on the curve
                break
            weight = np.clip(1 - (left / (6 * middle)) ** 2, 0, 1) ** 2
    return out


def lowess(rows: DataFrame, value: str, share: float = 0.3, passes: int = 0, by: str = "page") -> DataFrame:
    """``rows`` (htid, page and ``by``) with ``smooth`` over ``by``; one volume a group. ``passes`` over zero: :func:`robustly_smoothed`, else :func:`smoothed`."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by)
        x, y = pdf[by].to_numpy(float), pdf[value].to_numpy(float)
        return pd.DataFrame({"htid": pdf["htid"], "page": pdf["page"], "smooth": robustly_smoothed(x, y, share, passes) if passes else smoothed(x, y, share)})

    return rows.select(*dict.fromkeys(["htid", "page", by, value])).groupBy("htid").applyInPandas(fit, "htid string, page int, smooth double")


def chunk_quality(chunks: DataFrame, target: float) -> DataFrame:
    """Error statistics of chunk totals (htid, chunk, total): mean, deviation, least, largest, median."""
    error = F.col("total") - F.lit(float(target))

    def r(x: Column) -> Column:
        return F.round(x, 6)

    return chunks.agg(r(F.avg(error)).alias("mean"), r(F.stddev_samp(error)).alias("std"), F.min(error).alias("min"), F.max(error).alias("max"), F.median(error).alias("median"))


def top(rows: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    """The first ``k`` rows by falling ``by``; ties go by the other columns given."""
    return rows.orderBy(F.desc(by), *ties).limit(k)


def random_rows(rows: DataFrame, k: int, seed: int | None = None) -> DataFrame:
    """``k`` rows drawn at random."""
    return rows.orderBy(F.rand(seed)).limit(k)


def chunk_order(chunks: DataFrame) -> DataFrame:
    """A chunked token list in the order of its keys."""
    return chunks.orderBy(*[c for c in ("htid", "chunk", "pstart", "pend", "section", "token", "lowercase", "pos") if c in chunks.columns])
