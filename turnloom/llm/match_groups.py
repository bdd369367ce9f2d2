"""Problem 2: consolidate pairwise matches into groups.

Every key shared by several rows becomes a star of edges to the key's smallest row id (never all pairs); the
stars are closed by alternating large-star and small-star rewrites (``turnloom.operators.graph``). The group
identifier is the smallest ``group_id`` of the component in code-point order (Spark compares UTF-8 bytes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators import conversation as C
from turnloom.operators.graph import connected_components, star_links
from turnloom.skew import hot_threshold, join_counted
from turnloom.staging import Stage

MIN_OPENER_WORDS = 5


def exploded_keys(df: DataFrame, keys: dict[str, Column], row_id: str) -> DataFrame:
    """(id, kind, key, ...) with one row per row and non-null key."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in keys.items()])
    return df.select(F.col(row_id).cast("bigint").alias("id"), F.explode(F.filter(pairs, lambda p: p["key"].isNotNull())).alias("p")).select(
        "id", "p.kind", "p.key"
    )


def grouped_ids(df: DataFrame, keys: dict[str, Column], row_id: str, named_by: str) -> DataFrame:
    """(row_id, component) of every row whose component has two rows or more.

    ``component`` is the smallest ``named_by`` value among the component's rows, NULL where all are NULL. Rows
    with a NULL key are not linked by it; rows that link to nothing do not appear. ``row_id`` must be unique;
    an empty input gives an empty result. Other columns, whatever their names, are not looked at.
    """
    stage = Stage(df.sparkSession, "match-groups")
    slim = df.select(F.col(row_id), F.col(named_by), *[c.alias(f"__k_{k}") for k, c in keys.items()])
    keyed = exploded_keys(slim, {k: F.col(f"__k_{k}") for k in keys}, row_id)
    edges = stage.write(star_links(stage, keyed), "links")
    labels = stage.write(connected_components(stage, edges), "labels")
    named = slim.select(F.col(row_id).cast("bigint").alias("node"), F.col(named_by).alias("__name")).join(labels, "node")
    named = stage.write(named, "named")
    smallest = stage.write(named.groupBy("component").agg(F.min("__name").alias("__min"), F.count("*").alias("n")), "names")
    out = join_counted(named.select("node", "component"), smallest, ["component"], "n", F.col("node"), hot_threshold(smallest, "n"))
    return out.select(F.col("node").alias(row_id), F.col("__min").alias("component"))


def match_keys(conv: Column) -> dict[str, Column]:
    """The project's match rules: group_id, user_text_hash, and first_turn_hash of openers of five words or more."""
    long_enough = T.word_count(C.first_user_turn(conv)) >= MIN_OPENER_WORDS
    return {
        "group": F.col("group_id"),
        "user": F.col("user_text_hash"),
        "first": F.when(F.col("first_turn_hash").isNotNull() & long_enough, F.col("first_turn_hash")),
    }


def match_groups(df: DataFrame) -> DataFrame:
    """(rec_id, component) of interim records under :func:`match_keys`."""
    return grouped_ids(df, match_keys(F.col("conversation")), "rec_id", "group_id")
