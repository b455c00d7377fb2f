"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is two aggregates and two joins over the edges; nothing is collected but two numbers a round, and these are
observed while the round's edges are written, so that they take no job. Between rounds the edges are a checkpoint in the
shared folder, so lost executors cost one round at most. Edges that are stars already take one round, so components of
more links are best found from the (node, root) of those before and the new links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from folio.llm.common import shared_dir


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each neighbour to the least one: the larger neighbours (large) or the smaller ones and the node itself."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` as a checkpoint, and their number and the sum of their hashes."""
    seen = Observation()
    edges = edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hashes")).checkpoint()
    return edges, (seen.get["n"], seen.get["hashes"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: long) to (node, root): the least node of each node's component; roots themselves are left out.

    Null ends and loops are ignored; repeated edges count once.
    """
    shared_dir(edges.sparkSession)
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    edges, state = _written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        edges, now = _written(_star(_star(edges, True), False))
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
