"""Quality rules: base statistics of each text and a learned decision list, all in DataFrame expressions.

The list is learned by sequential covering. A rule is a conjunction of thresholds on the statistics; it grows literal by
literal on two thirds of the labelled rows by information gain, is pruned on the last third to the prefix of best worth,
and is taken if it is precise enough there; the rows it covers leave and the next rule is grown. Each step is one
aggregate of class counts by (statistic, bin), so the driver sees a few hundred counts however many rows are labelled.
The result is an ordered conditional expression.

Defined results: null text has no words; documents with no word or line have zero shares; labels that are null, of
unknown documents or repeated count as they join (each row of them); with no labels the list is empty and only the base
rule decides; rows that repeat a ``doc_id`` are judged each by its own text; an empty table gives no row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import stored

SPACE = r"[\x20\x09-\x0D]+"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that rules may test, each from the base and raw counts.
SHARES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share"]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the base counts and the shares. Nothing is exploded: each text's words stay in its row."""
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("w", F.filter(F.split("t", SPACE), lambda x: x != ""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("lines", lines)
    rows = rows.select(
        id_col, "w", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("t", F.lit("[A-Z]")).alias("uppers"), F.regexp_count("t", F.lit("[0-9]")).alias("digits"), F.regexp_count("t", F.lit("[!?;:]")).alias("marks"),
    )
    # three-word windows as (hash, place), sorted by hash: equal neighbours are repeats
    window = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")))
    rows = rows.withColumn("s", F.when(F.size("w") >= 3, F.sort_array(window)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = F.filter("s", lambda e, k: (e["h"] == F.get("s", k - 1)["h"]) | (e["h"] == F.get("s", k + 1)["h"]))
    rows = rows.withColumn("p", F.transform(twice, lambda e: e["i"])).drop("w", "s")
    repeat = F.size(F.array_distinct(F.concat("p", F.transform("p", lambda x: x + 1), F.transform("p", lambda x: x + 2)))).cast("long")

    def share(x: str | Column, of: str) -> Column:
        return F.when(F.col(of) > 0, (F.col(x) if isinstance(x, str) else x) / F.col(of)).otherwise(0.0).cast("double")

    rows = rows.withColumn("n_repeat_words", repeat)
    return rows.select(
        id_col, *BASE, share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("uppers", "word_chars").alias("upper_share"), share("digits", "word_chars").alias("digit_share"), share("marks", "word_chars").alias("mark_share"),
    )


@dataclass(frozen=True)
class Literal:
    stat: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.stat) > self.threshold if self.above else F.col(self.stat) <= self.threshold

    def __str__(self) -> str:
        return f"{self.stat} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Literal, ...]


def _all(rule: Rule) -> Column:
    out = F.lit(True)
    for x in rule:
        out = out & x.column()
    return out


def thresholds(rows: DataFrame, count: int = 24) -> dict[str, list[float]]:
    """Cut points of each statistic: quantiles within either class."""
    shares = [i / (count + 1) for i in range(1, count + 1)] + [0.99, 0.999]
    got = rows.groupBy("bad").agg(*[F.percentile_approx(F.col(s).cast("double"), shares, 10_000).alias(s) for s in SHARES]).collect()
    return {s: sorted({v for r in got for v in r[s] or ()}) for s in SHARES}


def learn(rows: DataFrame, max_rules: int = 6, max_literals: int = 3, min_precision: float = 0.9, min_cover: int = 3) -> list[Rule]:
    """Rules for ``bad`` rows from ``rows`` (the statistics and ``bad``, ``grow``: booleans), in the order found."""
    cuts = thresholds(rows)
    if not any(cuts.values()):
        return []

    def below(stat: str) -> Column:
        """How many cut points are below the value."""
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts[stat]]), lambda x: x < F.col(stat)))

    bins = F.array(*[F.struct(F.lit(i).alias("stat"), below(s).alias("bin")) for i, s in enumerate(SHARES)])
    rows = stored(rows.select(*SHARES, "bad", "grow", bins.alias("bins")), "labelled")
    rules: list[Rule] = []
    left = F.lit(True)
    for _ in range(max_rules):
        rule: Rule = ()
        while len(rule) < max_literals:
            # class counts by (statistic, bin) of the rows that the rule so far covers
            got = rows.where(left & F.col("grow") & _all(rule)).select(F.explode("bins").alias("b"), "bad").groupBy("b.stat", "b.bin").agg(F.sum(F.col("bad").cast("int")).alias("p"), F.count("*").alias("n")).collect()
            best = _best(got, cuts)
            if best is None:
                break
            rule += (best[0],)
            if best[1] == 0:
                break
        if not rule:
            break
        tests = [_all(rule[: k + 1]) for k in range(len(rule))]
        sums = [F.sum((t & b).cast("int")) for t in tests for b in (F.col("bad"), ~F.col("bad"))]
        got = rows.where(left & ~F.col("grow")).agg(*sums).first()
        worth = [((p or 0) / max(1, (p or 0) + (n or 0)), p or 0, -k) for k, (p, n) in enumerate(zip(got[::2], got[1::2], strict=True))]
        precision, cover, k = max(worth, key=lambda x: ((2 * x[0] - 1) * (1 if x[1] else 0), x[1], x[2]))
        if precision < min_precision or cover < min_cover:
            break
        rule = rule[: 1 - k]
        rules.append(rule)
        left = left & ~_all(rule)
    return rules


def _best(got: list, cuts: dict[str, list[float]]) -> tuple[Literal, int] | None:
    """The literal of most gain, and how many good rows it still covers. None where none gains."""
    table: dict[int, dict[int, tuple[int, int]]] = {}
    for r in got:
        table.setdefault(r["stat"], {})[r["bin"]] = (r["p"], r["n"] - r["p"])
    best = None
    for i, by_bin in sorted(table.items()):
        p0, n0 = (sum(v[k] for v in by_bin.values()) for k in (0, 1))
        if not p0 or not n0:
            return None
        p = n = 0
        for b in range(len(cuts[SHARES[i]])):
            p, n = p + by_bin.get(b, (0, 0))[0], n + by_bin.get(b, (0, 0))[1]
            for above, x, y in ((False, p, n), (True, p0 - p, n0 - n)):
                gain = x * (math.log2(x / (x + y)) - math.log2(p0 / (p0 + n0))) if x else 0
                if gain > 1e-9 and (best is None or gain > best[2] + 1e-9):
                    best = (Literal(SHARES[i], above, cuts[SHARES[i]][b]), y, gain)
    return best and best[:2]


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: false from the first rule that holds, else true."""
    out = F.when(F.lit(False), F.lit(False))
    for r in rules:
        out = out.when(_all(r), F.lit(False))
    return out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[Rule]]:
    """The base counts, ``base_failed`` and ``kept`` of every document, and the rules learned."""
    stats = stored(statistics(docs, id_col, text_col), "statistics")
    marks = labels.where("quality is not null").select(F.col(id_col).alias("__folio_id"), (F.col("quality") == 0).alias("bad"))
    # what fails the base rule needs no learned one
    known = stats.join(marks, F.col(id_col) == F.col("__folio_id")).where(~base_failed()).withColumn("grow", F.pmod(F.xxhash64(id_col), F.lit(3)) > 0)
    rules = learn(known)
    return stats.select(id_col, *BASE, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept")), rules


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))[0]
