"""Joins that have to be total, and guards: tables of violations, or an error where a rule of the build is broken."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.operators.curation import KEPT_WHOLE, SOURCES, SPLITS, whole_source_caps
from turnloom.operators.taxonomy import latest


class BrokenRule(ValueError):
    """A rule of the build does not hold; the message says which one and by how many rows."""


def require_empty(bad: DataFrame, rule: str) -> None:
    """Raise BrokenRule where ``bad`` has a row; the message shows a few of them."""
    few = bad.limit(3).collect()
    if few:
        raise BrokenRule(f"{rule}: {[r.asDict() for r in few]}")


def with_last_intent(corpus: DataFrame, intents: DataFrame, key: str = "conv_id", seq: str = "seq") -> DataFrame:
    """Corpus rows with the ``intent`` written last for their id; rows without one are left out.

    ``intents`` is an append log (key, intent, seq). The corpus keeps its own order column, if it has one.
    """
    last = latest(intents.select(key, "intent", seq), [key], seq).select(key, "intent")
    return corpus.join(last, key)


def total_join(left: DataFrame, right: DataFrame, key: str, what: str, checked: bool = True) -> DataFrame:
    """Inner join in which every left row has to find a right row. ``right`` has one row per key.

    ``checked`` counts the missing ones before (one more pass over the keys); without it a missing row is an error
    of the task that meets it.
    """
    if checked:
        require_empty(left.select(key).join(right.select(key), key, "left_anti"), f"no {what}")
        return left.join(right, key)
    found = left.join(right.withColumn("__there", F.lit(True)), key, "left")
    there = F.coalesce("__there", F.raise_error(F.concat(F.lit(f"no {what}: "), F.col(key).cast("string"))).cast("boolean"))
    return found.where(there).drop("__there")


def missing_ids(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key) of wanted rows that the other table does not know (each once)."""
    return wanted.select(key).distinct().join(known.select(key), key, "left_anti")


def tasks_by_samples(tasks: DataFrame, samples: int) -> DataFrame:
    """One row per task and sample: sample_index from 0, conv_id = task_id#sample_index. An array of fixed size, no join."""
    each = tasks.withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return each.withColumn("conv_id", F.concat_ws("#", "task_id", F.col("sample_index").cast("string")))


def labelled_classes(rows: DataFrame, sources: list[str]) -> DataFrame:
    """Rows of the given sources with ``label``, the position of their source in the list."""
    place = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source")) - 1
    return rows.where(F.col("source").isin(*sources)).withColumn("label", place.cast("int"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of several sets one after another, by column name; columns that only some have are NULL in the others."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def shared_features(sets: list[list[str]], wanted: list[str] | None = None) -> list[str]:
    """Feature names that every set has (and, where given, that are wanted), sorted; none is an error."""
    common = set.intersection(*map(set, sets)) if sets else set()
    common = common if wanted is None else common & set(wanted)
    if not common:
        raise BrokenRule("no shared representations")
    return sorted(common)


def unpaired_intents(rows: DataFrame, classes: list[str], by: str = "source", split: str = "split", seed: str = "seed_conv_id") -> DataFrame:
    """(seed, problem): seeds that a class lacks in a split, or that are in several splits.

    No rows where any seed is NULL (then the classes are not paired). Only two small facts per seed are aggregated.
    """
    mine = rows.where(F.col(by).isin(*classes))
    per = mine.groupBy(seed, split).agg(F.count_distinct(by).alias("k"))
    lacking = per.where(F.col("k") < len(classes)).select(F.col(seed).alias("seed"), F.lit("lacking").alias("problem"))
    crossing = per.groupBy(seed).agg(F.count("*").alias("k")).where("k > 1").select(F.col(seed).alias("seed"), F.lit("crossing").alias("problem"))
    found = lacking.union(crossing)
    return found if mine.where(F.col(seed).isNull()).isEmpty() else found.limit(0)


def presplit_violations(records: DataFrame) -> DataFrame:
    """(rec_id, rule): unknown sources, and preference pairs whose released split is neither train nor test."""
    known = F.coalesce(F.col("source").isin(*SOURCES), F.lit(False))
    bad = (F.col("source") == "hh_rlhf") & ~F.coalesce(F.col("presplit").isin("train", "test"), F.lit(False))
    return records.where(~known | bad).select("rec_id", F.when(~known, "source").otherwise("presplit").alias("rule"))


def different_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): ids that only one of two tables has, with their multiplicities."""
    one, two = a.select(key), b.select(key)
    return one.exceptAll(two).withColumn("side", F.lit("a")).union(two.exceptAll(one).withColumn("side", F.lit("b")))


def unstable_prefixes(rows: DataFrame, shorter: Column, longer: Column, row_id: str) -> DataFrame:
    """(row_id) where the rendering of some turns is no prefix of the rendering of these and more turns."""
    return rows.where(~F.coalesce(longer.startswith(shorter), F.lit(False))).select(row_id)


def expected_counts(totals: dict[str, int], sizes: dict[str, int]) -> dict[tuple[str, str], int]:
    """Exact number of records of each source and split: the sizes, or all of a source that is kept whole."""
    out = {}
    for source, n in totals.items():
        caps = whole_source_caps(n, sizes) if source in KEPT_WHOLE else sizes
        out.update({(source, split): caps[split] for split in SPLITS})
    return out


def shortages(pools: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(source, split, pool, wanted) where fewer records were assigned than are wanted; sources kept whole have no shortage.

    ``pools`` is (source, split, pool); a split without any record counts as a pool of 0.
    """
    every = pools.select("source").distinct().where(~F.col("source").isin(*KEPT_WHOLE))
    wanted = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.lit(sizes[s]).cast("bigint").alias("wanted")) for s in SPLITS])).alias("w")
    dense = every.select("source", wanted).select("source", "w.*").join(pools, ["source", "split"], "left").na.fill(0, ["pool"])
    return dense.where(F.col("pool") < F.col("wanted")).select("source", "split", "pool", "wanted")


def count_violations(corpus: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(source, split, n, wanted) where a source that is not kept whole does not have its exact number of records."""
    counts = corpus.groupBy("source", "split").agg(F.count("*").alias("n"))
    every = counts.select("source").distinct().where(~F.col("source").isin(*KEPT_WHOLE))
    wanted = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.lit(sizes[s]).cast("bigint").alias("wanted")) for s in SPLITS])).alias("w")
    dense = every.select("source", wanted).select("source", "w.*").join(counts, ["source", "split"], "left").na.fill(0, ["n"])
    return dense.where(F.col("n") != F.col("wanted")).select("source", "split", "n", "wanted")
