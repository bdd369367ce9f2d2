"""Joins whose keys may be hot: one key can hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_SHARE of the rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 256
#: Hot keys are spread over this many salts.
SALTS = 64


def hot_threshold(keyed: DataFrame, count_col: str) -> float:
    """Row count above which a key of ``keyed`` is hot. One aggregate row comes to the driver."""
    total = keyed.agg(F.sum(count_col)).first()[0] or 0
    return float(total) / HOT_SHARE


def join_counted(
    left: DataFrame, keyed: DataFrame, on: list[str], count_col: str, spread: Column, threshold: float, how: str = "inner"
) -> DataFrame:
    """``left JOIN keyed`` with hot keys salted.

    ``keyed`` has one row per key and its number of ``left`` rows in ``count_col``. Fewer than HOT_SHARE keys
    exceed ``threshold`` (each holds more than total/HOT_SHARE rows), so their list is broadcast, by that bound;
    rows of those keys spread over SALTS tasks, and the keyed row is repeated once per salt. NULL keys never match.
    """
    hot = keyed.where(F.col(count_col) > F.lit(threshold)).select(*on, F.lit(True).alias("__hot"))
    spread_left = left.join(F.broadcast(hot), on, "left").withColumn(
        "__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    )
    salts = F.when(F.col(count_col) > F.lit(threshold), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread_keyed = keyed.withColumn("__salt", F.explode(salts))
    return spread_left.drop("__hot").join(spread_keyed, [*on, "__salt"], how).drop("__salt")
