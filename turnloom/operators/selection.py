"""Budgeted selection by scores, transfer gaps, token-weighted losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as T


def gumbel(seed: str, key: Column) -> Column:
    """Deterministic Gumbel noise from the hash unit of a key."""
    return -F.log(-F.log(T.hash_unit(seed, key)))


def gumbel_top(df: DataFrame, log_weight: str, row_id: str, k: int, seed: str) -> DataFrame:
    """k rows without replacement with probability by weight: the largest log weight + Gumbel (a top-k, no full sort).

    Adds ``position`` (1-based), so a smaller budget is a prefix. Ties break by id.
    """
    noisy = df.withColumn("__s", F.col(log_weight) + gumbel(seed, F.col(row_id)))
    return _positions(noisy, [F.col("__s").desc(), F.col(row_id)], k).drop("__s")


def uniform_top(df: DataFrame, row_id: str, k: int, seed: str) -> DataFrame:
    """k rows in hash order, with their position."""
    return _positions(df.withColumn("__h", T.hash_order(seed, F.col(row_id))), [F.col("__h"), F.col(row_id)], k).drop("__h")


def _positions(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of an order with their 1-based position; k is the stated budget."""
    top = df.orderBy(*order).limit(k)
    from pyspark.sql.window import Window

    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def composition(selected: DataFrame, by: str) -> DataFrame:
    return selected.groupBy(by).agg(F.count("*").alias("n"))


def token_loss(rows: DataFrame, by: list[str], loss: str, tokens: str) -> DataFrame:
    """(by, nll_token_mean, ppl_token, n_conv, n_tokens): losses weighted by their tokens."""
    mean = F.sum(loss) / F.sum(tokens)
    return rows.groupBy(*by).agg(mean.alias("nll_token_mean"), F.exp(mean).alias("ppl_token"), F.count("*").alias("n_conv"), F.sum(tokens).alias("n_tokens"))


def transfer_gaps(nll: DataFrame) -> DataFrame:
    """(a, b, gap) per unordered pair of sources from (train, test, nll): half the two cross losses over the own ones.

    ``nll`` has sources squared rows; the pair join is on that small table.
    """
    x = nll.select("train", "test", "nll")
    own = x.where(F.col("train") == F.col("test")).select(F.col("train").alias("s"), F.col("nll").alias("own"))
    cross = x.where(F.col("train") < F.col("test")).select(F.col("train").alias("a"), F.col("test").alias("b"), F.col("nll").alias("ab"))
    back = x.where(F.col("train") > F.col("test")).select(F.col("test").alias("a"), F.col("train").alias("b"), F.col("nll").alias("ba"))
    both = cross.join(back, ["a", "b"])
    both = both.join(own.select(F.col("s").alias("a"), F.col("own").alias("aa")), "a").join(own.select(F.col("s").alias("b"), F.col("own").alias("bb")), "b")
    return both.select("a", "b", (0.5 * ((F.col("ab") - F.col("bb")) + (F.col("ba") - F.col("aa")))).alias("gap"))
