"""Connected components by alternating large-star and small-star edge rewrites (distributed joins only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.skew import HOT_SHARE, hot_threshold, join_counted
from turnloom.staging import Stage

LINK_SCHEMA = "id bigint, kind string, key string"


def star_links(stage: Stage, keyed: DataFrame) -> DataFrame:
    """(id, rep) for every row of ``keyed(id BIGINT, kind, key)`` that is not the smallest id of its key.

    Rows that share (kind, key) are linked to their smallest id, so a key with n rows gives n-1 edges, never
    n*n pairs. Counts and minima are pre-aggregated map-side; hot keys are salted in the join back. NULL keys
    link nothing.
    """
    keyed = stage.write(keyed.where(F.col("key").isNotNull()).select("id", F.xxhash64("kind", "key").alias("h"), "kind", "key"), "keyed")
    reps = stage.write(
        keyed.groupBy("h", "kind", "key").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where(F.col("n") > 1), "reps"
    )
    linked = join_counted(keyed, reps, ["h", "kind", "key"], "n", F.col("id"), hot_threshold(reps, "n"))
    return linked.where(F.col("id") != F.col("rep")).select(F.col("id").alias("u"), F.col("rep").alias("v"))


def _large_star(stage: Stage, edges: DataFrame, threshold: float) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood.

    The minima are one exchange that the plan reuses for the hot keys' list and for the join.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    mins = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    out = join_counted(both.where(F.col("v") > F.col("u")), mins, ["u"], "n", F.col("v"), threshold)
    return stage.write(out.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")


def _small_star(stage: Stage, edges: DataFrame, threshold: float) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    mins = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_counted(down, mins, ["u"], "n", F.col("v"), threshold)
    moved = moved.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stage.write(moved.union(mins.select("u", F.col("m").alias("v"))).distinct(), "small")


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(stage: Stage, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; the component is its smallest node.

    Self-loops and repeated edges are ignored, an empty edge table gives an empty result. The rounds stop when
    neither rewrite changes the edge set (compared by count and hash sum, one row to the driver).
    """
    cur = stage.write(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "edges")
    seen = _fingerprint(cur)
    for _ in range(max_rounds):
        # a node is hot above 1/HOT_SHARE of the edge ends; the rewrites never add edges
        threshold = 2.0 * seen[0] / HOT_SHARE
        large = _large_star(stage, cur, threshold)
        small = _small_star(stage, large, threshold)
        stage.drop(large)
        stage.drop(cur)
        cur, now = small, _fingerprint(small)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select("v").distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
