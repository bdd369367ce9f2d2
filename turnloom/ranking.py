"""Ranks and running sums over an order, in two steps: no task sorts more than one bucket of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Leading hex digits of a hash order that make its bucket (16**3 buckets in each group).
HEX_DIGITS = 3


def hex_bucket(order: str) -> Column:
    """Bucket of a hex hash order; buckets compare like the hashes."""
    return F.substring(F.col(order), 1, HEX_DIGITS)


def running_before(df: DataFrame, parts: list[str], bucket: Column, order: list[str], value: Column | dict[str, Column], out: str = "",
                   coarse: Column | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before each row, within ``parts``, in ``bucket``, ``order``.

    ``bucket`` must be non-decreasing along the order. Bucket totals are pre-aggregated and summed over the few
    buckets of a group; only rows of one bucket are sorted together. ``order`` should be total; 0 on first rows. Where
    a group has very many buckets, ``coarse`` (non-decreasing as well) cuts them into runs that are summed one by one.
    A dict of values, by name, gives several sums in one pass.
    """
    values = value if isinstance(value, dict) else {out: value}
    tagged = df.withColumn("__sumb", bucket).withColumn("__sumc", coarse if coarse is not None else F.lit(0))
    tagged = tagged.withColumns({f"__sumv{i}": v for i, v in enumerate(values.values())})
    k = range(len(values))
    upto = Window.unboundedPreceding, -1

    def earlier(totals: DataFrame, within: list[str], by: str, name: str) -> DataFrame:
        over = Window.partitionBy(*within).orderBy(by).rowsBetween(*upto)
        return totals.withColumns({f"{name}{i}": F.coalesce(F.sum(f"__sumt{i}").over(over), F.lit(0)) for i in k})

    def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        renamed = right.select(*[F.col(c).alias(f"__sumk{i}") for i, c in enumerate(on)], *[c for c in right.columns if c not in on])
        match = [F.col(c).eqNullSafe(F.col(f"__sumk{i}")) for i, c in enumerate(on)]
        return left.join(renamed, reduce(lambda a, b: a & b, match)).drop(*[f"__sumk{i}" for i in range(len(on))])

    keys = [*parts, "__sumc", "__sumb"]
    totals = tagged.groupBy(*keys).agg(*[F.sum(f"__sumv{i}").alias(f"__sumt{i}") for i in k])
    totals = earlier(totals, [*parts, "__sumc"], "__sumb", "__sumin")
    if coarse is not None:
        runs = totals.groupBy(*parts, "__sumc").agg(*[F.sum(f"__sumt{i}").alias(f"__sumt{i}") for i in k])
        runs = earlier(runs, parts, "__sumc", "__sumr").drop(*[f"__sumt{i}" for i in k])
        totals = joined(totals, runs, [*parts, "__sumc"])
        totals = totals.withColumns({f"__sumin{i}": F.col(f"__sumin{i}") + F.col(f"__sumr{i}") for i in k})
    totals = totals.select(*keys, *[F.col(f"__sumin{i}").alias(f"__sumbefore{i}") for i in k])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)
    tagged = tagged.withColumns({f"__sums{i}": F.coalesce(F.sum(f"__sumv{i}").over(inside), F.lit(0)) for i in k})
    placed = joined(tagged, totals, keys)
    return placed.select(*df.columns, *[(F.col(f"__sumbefore{i}") + F.col(f"__sums{i}")).alias(name) for i, name in enumerate(values)])


def hash_rank(df: DataFrame, parts: list[str], order: str, tie: list[str], out: str = "rank") -> DataFrame:
    """Add ``out``: the 1-based rank of each row within ``parts`` by a hex hash column, then ``tie``."""
    ranked = running_before(df, parts, hex_bucket(order), [order, *tie], F.lit(1), out)
    return ranked.withColumn(out, F.col(out) + 1)
