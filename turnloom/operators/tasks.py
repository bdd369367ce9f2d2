"""Task pools, reply checks, success tables with intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import stats
from turnloom.functions import text as T
from turnloom.ranking import hash_rank

# Intent template and reply limits.
INTENT_TEMPLATE = "You are a user chatting with an assistant language model to complete the following: "
BANNED_FIRST_WORDS = ("I", "You", "Here", "i", "you", "here")
MIN_WORDS, MAX_WORDS = 3, 25


def task_intent(problem: Column) -> Column:
    return F.concat(F.lit(INTENT_TEMPLATE), problem)


def select_tasks(pool: DataFrame, first: DataFrame, n: int, seed: str) -> DataFrame:
    """n tasks per dataset: those in ``first(task_id)`` ahead of the others, each in hash order."""
    tagged = pool.join(first.select("task_id", F.lit(0).alias("__f")).distinct(), "task_id", "left")
    order = F.concat(F.coalesce("__f", F.lit(1)).cast("string"), T.hash_order(seed, F.col("task_id")))
    ranked = hash_rank(tagged.withColumn("__h", order), ["dataset"], "__h", ["task_id"])
    return ranked.where(F.col("rank") <= n).select(*pool.columns)


def in_pool_order(chosen: DataFrame, pool: DataFrame, position: str) -> DataFrame:
    """Chosen tasks with their place in the pool, sorted by it (a task pool is small)."""
    return chosen.join(pool.select("task_id", position), "task_id").orderBy(position)


def reply_fault(reply: Column, copies: Column, first_token_banned: Column | None = None) -> Column:
    """NULL, or first_token, too_long, too_short, verbatim: the first check a user reply fails.

    ``copies`` holds texts (already normalised) the reply must not repeat. Without a tokenizer the first *word*
    stands for the first token.
    """
    words = T.words(reply)
    banned = F.get(words, F.lit(0)).isin(*BANNED_FIRST_WORDS) if first_token_banned is None else first_token_banned
    n = F.size(words)
    return (
        F.when(F.coalesce(banned, F.lit(False)), "first_token").when(n > MAX_WORDS, "too_long").when(n < MIN_WORDS, "too_short")
        .when(F.array_contains(copies, T.norm_text(reply)), "verbatim")
    )


def graded_turns(turns: DataFrame, grades: DataFrame) -> DataFrame:
    """turns(conv_id, task_id, turn) with their grade; an ungraded turn is a runtime error."""
    both = turns.join(grades.where("status = 'ok'").select("conv_id", "turn", "correct"), ["conv_id", "turn"], "left")
    return both.withColumn("correct", F.coalesce("correct", F.raise_error(F.lit("ungraded turns")).cast("boolean")))


def task_success(graded: DataFrame, by: list[str]) -> DataFrame:
    """(by, task_id, success): share of a task's conversations with a correct turn."""
    conv = graded.groupBy(*by, "task_id", "conv_id").agg(F.max("correct").alias("hit"))
    return conv.groupBy(*by, "task_id").agg(F.avg(F.col("hit").cast("double")).alias("success"))


def _quantiles(level: float):
    @F.pandas_udf("double")
    def t_quantile(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[int, float] = {}
        for n in it:
            yield n.map(lambda k: cache.setdefault(k, stats.t_quantile(0.5 + level / 2, k - 1)))

    return t_quantile


def intervals(values: DataFrame, by: list[str], value: str, level: float = 0.90) -> DataFrame:
    """(by, mean, half, n) in percent: mean and half-width of the Student-t interval; NULL half for one value."""
    out = values.groupBy(*by).agg((100 * F.avg(value)).alias("mean"), (100 * F.stddev_samp(value)).alias("sd"), F.count(value).alias("n"))
    half = F.nanvl(_quantiles(level)(F.col("n")), F.lit(None).cast("double")) * F.col("sd") / F.sqrt("n")
    return out.withColumn("half", half).select(*by, "mean", "half", "n")


def paired_delta(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """(task_id, delta) of two success tables over the same tasks; a task missing on one side is a runtime error."""
    both = a.select("task_id", F.col(value).alias("x")).join(b.select("task_id", F.col(value).alias("y")), "task_id", "full_outer")
    bad = F.col("x").isNull() | F.col("y").isNull()
    return both.select("task_id", F.when(bad, F.raise_error(F.lit("tasks differ")).cast("double")).otherwise(F.col("x") - F.col("y")).alias("delta"))
