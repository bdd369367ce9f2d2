"""Problem 4: splits that keep related records together.

Related rows are found by union-find: every partition contracts its edges to a forest (tree edges only), the
forests are merged hierarchically, FAN_IN at a time, and contracted again. One task never gets more than
TASK_EDGES edges: where the forest no longer fits, merging stops there and large-star/small-star rounds close
what is left, with the same result. Groups then go, largest first, to the split furthest below its target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.llm.match_groups import exploded_keys
from turnloom.operators.graph import connected_components, star_links
from turnloom.ranking import hash_rank
from turnloom.skew import hot_threshold, join_counted
from turnloom.staging import Stage

FAN_IN = 8
#: Most edges one union-find task takes (16 bytes each, about 200 MB with its working arrays).
TASK_EDGES = 2_000_000
#: Quotas (one or a few per size of group, 40 bytes each) that are broadcast.
BROADCAST_QUOTAS = 500_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for each node that is not the smallest of its tree; vectorised union with pointer jumping."""
    ids, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inv[: len(u)], inv[len(u) :]
    root = np.arange(len(ids))
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def _local_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts_u, parts_v, held = [], [], 0
    for batch in batches:
        parts_u.append(batch.column("u").to_numpy(zero_copy_only=False))
        parts_v.append(batch.column("v").to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held >= TASK_EDGES:  # a partition beyond the bound gives several forests
            yield from _trees(parts_u, parts_v)
            parts_u, parts_v, held = [], [], 0
    if parts_u:
        yield from _trees(parts_u, parts_v)


def _trees(parts_u: list[np.ndarray], parts_v: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    u, v = forest(np.concatenate(parts_u), np.concatenate(parts_v))
    for at in range(0, len(u), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(u[at : at + 100_000]), pa.array(v[at : at + 100_000])], ["u", "v"])


def merged_forest(stage: Stage, edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges(u, v)``; the component is its smallest node.

    Rows are dealt out evenly, not by node, so the star of a hot node is no hot partition.
    """
    cur, parts = stage.write(edges.mapInArrow(_local_forests, "u bigint, v bigint"), "forest"), None
    while True:
        n = cur.count()
        # every node with an edge of its own keeps one tree edge, so more such nodes than a task takes can never merge into one
        if n > TASK_EDGES and cur.agg(F.approx_count_distinct("u", 0.02)).first()[0] > 1.1 * TASK_EDGES:
            break
        least = max(1, -(-n // TASK_EDGES))
        now = max(least, (parts or FAN_IN**2) // FAN_IN)
        if now == parts:
            break
        parts = now
        cur = stage.write(cur.repartition(parts).mapInArrow(_local_forests, "u bigint, v bigint"), "forest")
        if parts == 1:
            roots = cur.select("v").distinct()
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
            )
    return connected_components(stage, cur)


def related_rows(stage: Stage, df: DataFrame, keys: dict[str, Column], row_id: str) -> DataFrame:
    """(node, component) of every row that shares a key with another row, directly or through others."""
    return stage.write(merged_forest(stage, star_links(stage, exploded_keys(df, keys, row_id))), "labels")


def presplit_value(col: Column) -> Column:
    return F.lower(T.strip(col))


def contradicting_rows(df: DataFrame) -> DataFrame:
    """(rec_id) of every row of a related set with two or more different non-null ``presplit`` values.

    NULL group_id or conv_id relate nothing; an empty table gives an empty result.
    """
    stage = Stage(df.sparkSession, "group-splits")
    labels = related_rows(stage, df, {"group": F.col("group_id"), "conv": F.col("conv_id")}, "rec_id")
    given = df.where(F.col("presplit").isNotNull()).select(F.col("rec_id").alias("node"), presplit_value(F.col("presplit")).alias("p"))
    given = given.join(labels, "node").groupBy("component").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    bad = given.where(F.col("a") != F.col("b")).select("component")
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    bad = stage.write(sizes.join(bad, "component"), "bad")
    return join_counted(labels, bad, ["component"], "n", F.col("node"), hot_threshold(sizes, "n")).select(F.col("node").alias("rec_id"))


def greedy_counts(size: int, count: int, deficits: list[float]) -> list[int]:
    """How many of ``count`` groups of one size each split gets when each goes to the largest deficit in turn.

    A level search stands for the one-by-one loop, so a billion single rows cost as little as ten.
    """
    low, high = min(deficits) - float(size) * (count + 1), max(deficits)
    taken = lambda level: [max(0, int((d - level) // size)) for d in deficits]
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(taken(mid)) <= count else (mid, high)
    got = taken(high)
    left = [d - size * g for d, g in zip(deficits, got)]
    for _ in range(count - sum(got)):
        i = max(range(len(left)), key=lambda k: (left[k], -k))
        got[i] += 1
        left[i] -= size
    return got


def plan_splits(classes: list[tuple[int, int]], shares: dict[str, float], loads: dict[str, float], total: int) -> list[tuple]:
    """(size, split, first, last) quotas of free groups, largest first; ``classes`` has (size, number of groups)."""
    names = sorted(shares, key=lambda s: (-shares[s], s))
    deficits = [shares[s] * total - loads.get(s, 0) for s in names]
    quotas = []
    for size, count in sorted(classes, reverse=True):
        first = 1
        for i, got in enumerate(greedy_counts(size, count, deficits)):
            deficits[i] -= size * got
            if got:
                quotas.append((size, names[i], first, first + got - 1))
            first += got
    return quotas


def assign_splits(df: DataFrame, targets: DataFrame, row_id: str = "rec_id") -> DataFrame:
    """(row_id, component, split): one split per related set, near ``targets(split, share)``.

    A set whose non-null presplits agree on one target split gets it; sets without a presplit, with
    contradicting ones, or with one that is no target are free and placed largest first into the split furthest
    below its share. Groups of one size go in the order of the md5 of their component id, so the result is the same in every run.
    The driver holds only the distinct (size, split) classes: fewer than sqrt(2 * rows) sizes can exist.
    """
    spark = df.sparkSession
    stage = Stage(spark, "group-splits")
    shares = {r["split"]: float(r["share"]) for r in targets.where(F.col("split").isNotNull()).collect()}
    if not shares:
        raise ValueError("no split targets")
    labels = related_rows(stage, df, {"group": F.col("group_id"), "conv": F.col("conv_id")}, row_id)
    rows = df.select(F.col(row_id).alias("node"), presplit_value(F.col("presplit")).alias("p")).join(labels, "node", "left")
    rows = stage.write(rows.select("node", F.coalesce("component", "node").alias("component"), "p"), "rows")
    known = F.col("a").isin(*shares) & (F.col("a") == F.col("b"))
    sets = rows.groupBy("component").agg(F.count("*").alias("n"), F.min("p").alias("a"), F.max("p").alias("b"))
    sets = stage.write(sets.select("component", "n", F.when(known, F.col("a")).alias("fixed")), "sets")
    classes = sets.groupBy("n", "fixed").agg(F.count("*").alias("c")).collect()
    loads: dict[str, float] = {}
    for r in classes:
        if r["fixed"] is not None:
            loads[r["fixed"]] = loads.get(r["fixed"], 0) + r["n"] * r["c"]
    total = sum(r["n"] * r["c"] for r in classes)
    quotas = plan_splits([(r["n"], r["c"]) for r in classes if r["fixed"] is None], shares, loads, total)
    quota = spark.createDataFrame(quotas, "n bigint, split string, first bigint, last bigint")
    free = sets.where(F.col("fixed").isNull()).withColumn("h", F.md5(F.col("component").cast("string")))
    ranked = hash_rank(free, ["n"], "h", ["component"])
    quota = F.broadcast(quota) if len(quotas) <= BROADCAST_QUOTAS else quota
    placed = ranked.join(quota, ["n"]).where(F.col("rank").between(F.col("first"), F.col("last"))).select("component", "n", "split")
    fixed = sets.where(F.col("fixed").isNotNull()).select("component", "n", F.col("fixed").alias("split"))
    every = stage.write(placed.union(fixed), "placed")
    out = join_counted(rows.select("node", "component"), every, ["component"], "n", F.col("node"), hot_threshold(every, "n"))
    return out.select(F.col("node").alias(row_id), "component", "split")
