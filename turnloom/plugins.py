"""Model calls as pluggable functions: language id, encoder, tokenizer, generation with retry policies.

Nothing here loads a model. A factory is called once per Python worker and returns the callable that does.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from turnloom.operators import selection, sft
from turnloom.simulate import many


def language_id(factory: Callable[[], Callable[[list[str]], list[tuple[str | None, float]]]]) -> Callable[[Column], Column]:
    """Text column to STRUCT<lang, prob>; blank text gives (NULL, 0)."""

    @F.pandas_udf("lang string, prob double")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = factory()
        for s in it:
            filled = s.fillna("")
            got = dict(zip(filled[filled != ""].index, predict(filled[filled != ""].tolist())))
            yield pd.DataFrame([got.get(i, (None, 0.0)) for i in s.index], columns=["lang", "prob"])

    return run


def encoder(factory: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[Column], Column]:
    """Text column to ARRAY<FLOAT>, batch by batch; a vector with a non-finite value is an error."""

    @F.pandas_udf("array<float>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for s in it:
            got = encode(s.fillna("").tolist())
            if any(x != x or x in (float("inf"), float("-inf")) for v in got for x in v):
                raise ValueError("non-finite feature")
            yield pd.Series(got, index=s.index)

    return run


def tokenizer(factory: Callable[[], Callable[[list[str]], list[list[int]]]]) -> Callable[[Column], Column]:
    @F.pandas_udf("array<int>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for s in it:
            yield pd.Series(encode(s.fillna("").tolist()), index=s.index)

    return run


def pooled(tokens: Column, how: str) -> Column:
    """Pool ARRAY<ARRAY<FLOAT>> token vectors: mean, last, cls, or mean_normalized (L2)."""
    if how in ("last", "cls"):
        return F.element_at(tokens, -1 if how == "last" else 1)
    zero = F.transform(F.element_at(tokens, 1), lambda _: F.lit(0.0))
    total = F.aggregate(tokens, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")))
    mean = F.transform(total, lambda x: x / F.size(tokens))
    if how == "mean":
        return mean
    norm = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(mean, lambda x: x / norm)


class GiveUp(Exception):
    """The service says that this request can never succeed."""


def with_retries(call: Callable[[], str], tries: int, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> str | None:
    """Result of ``call``, or None after ``tries`` failures or a GiveUp; waits 2**k plus jitter between tries."""
    rng = rng or random.Random()
    for k in range(tries):
        try:
            return call()
        except GiveUp:
            return None
        except Exception:
            if k + 1 < tries:
                sleep(2**k + rng.random())
    return None


def generate_column(df: DataFrame, factory: Callable[[], Callable[[str], str]], prompt: str, out: str, tries: int = 4, workers: int = 64) -> DataFrame:
    """Add ``out``: the service's answer to ``prompt``, NULL where it gave up. The client is made per worker.

    ``workers`` requests of a batch are under way at a time; a client of several endpoints picks one by
    ``simulate.Spread``.
    """
    fields = StructType([*df.schema.fields, StructField(out, StringType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in it:
            yield pdf.assign(**{out: list(many(lambda p: with_retries(lambda: client(p), tries), pdf[prompt], workers))})

    return df.mapInPandas(run, fields)


def user_token_loss(samples: DataFrame, factory: Callable[[], Callable[[list[int], list[int]], tuple[float, int]]], by: list[str]) -> DataFrame:
    """(by, nll_token_mean, ppl_token, n_conv, n_tokens): loss of the target tokens of (input_ids, labels) samples.

    The factory's function gives (summed loss, number of targets) of one sample; samples without a target from
    position 1 on, and longer ones than the limit, are left out.
    """
    rows = sft.within_limit(samples).where(sft.has_target(F.col("labels"))).select(*by, "input_ids", "labels")
    fields = StructType([*rows.select(*by).schema.fields, StructField("loss", DoubleType()), StructField("tokens", LongType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = factory()
        for pdf in it:
            got = [score(list(i), list(t)) for i, t in zip(pdf["input_ids"], pdf["labels"])]
            yield pdf[by].assign(loss=[float(x) for x, _ in got], tokens=[int(n) for _, n in got])

    return selection.token_loss(rows.mapInPandas(run, fields), by, "loss", "tokens")


def embedded(df: DataFrame, factory: Callable[[], Callable[[list[list[int]]], list[list[list[float]]]]], how: tuple[str, ...], longest: int, budget: int, most: int) -> DataFrame:
    """(conv_id, feature, v): token vectors of (conv_id, ids) pooled in several ways; texts longer than ``longest`` are cut.

    Batches hold up to ``most`` texts and ``budget`` padded tokens, shortest first. The factory's function encodes one.
    """
    cut = df.select("conv_id", F.slice("ids", 1, longest).alias("ids")).withColumn("n", F.size("ids"))
    batches = sft.token_batches(cut.withColumn("row", F.monotonically_increasing_id()), "n", "row", budget, most)
    made = "conv_id string, tokens array<array<float>>"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = factory()
        for pdf in it:
            for _, one in pdf.groupby(["part", "batch"], sort=False):
                yield pd.DataFrame({"conv_id": one["conv_id"].astype(str), "tokens": encode([list(x) for x in one["ids"]])})

    tokens = batches.select("conv_id", "ids", "part", "batch").mapInPandas(run, made)
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("feature"), pooled(F.col("tokens"), h).cast("array<double>").alias("v")) for h in how]))
    finite = F.when(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.raise_error(F.lit("non-finite feature")).cast("array<double>")).otherwise(F.col("v"))
    return tokens.select("conv_id", each.alias("f")).select("conv_id", "f.feature", F.col("f.v").alias("v")).withColumn("v", finite)
