"""Classification metrics, class weights, standardisation, linear heads on stored vectors, binning, divergence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.ranking import running_before

#: Approximate quantiles that cut a continuous order into buckets for running sums.
ORDER_BUCKETS = 256


def class_weights(df: DataFrame, label: str, classes: int) -> DataFrame:
    """(label, n, weight): N/(k*n_c) scaled to mean one; a class without rows counts as one row.

    The total is that of the counts after that replacement.
    """
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    dense = every.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))
    all_ = Window.partitionBy()  # one row per class
    filled = F.greatest(F.col("n"), F.lit(1)).cast("double")
    raw = dense.withColumn("w", F.sum(filled).over(all_) / (F.lit(classes) * filled))
    return raw.select("label", "n", (F.col("w") / F.avg("w").over(all_)).alias("weight"))


def column_stats(df: DataFrame, vector: str) -> DataFrame:
    """(dim, mean, std): population standard deviation + 1e-6 of each position of an array column."""
    x = df.select(F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return x.groupBy("dim").agg(F.avg("x").alias("mean"), (F.stddev_pop("x") + F.lit(1e-6)).alias("std"))


@dataclass(frozen=True)
class LinearHead:
    """A fitted head: weights[class][dim], bias[class], and the standardisation it was trained with."""

    weights: list[list[float]]
    bias: list[float]
    mean: list[float]
    std: list[float]


def _array(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def standardise(vector: Column, mean: list[float], std: list[float]) -> Column:
    centred = F.zip_with(vector, _array(mean), lambda x, m: x.cast("double") - m)
    return F.zip_with(centred, _array(std), lambda x, s: x / s)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)


def logits(vector: Column, head: LinearHead) -> Column:
    """((x - mean) / std) W + b as an array column; the head travels as literals, there is no join."""
    z = standardise(vector, head.mean, head.std)
    classes = F.array(*[F.struct(_array(w).alias("w"), F.lit(float(b)).alias("b")) for w, b in zip(head.weights, head.bias)])
    return F.get(F.transform(F.array(z), lambda v: F.transform(classes, lambda c: dot(v, c["w"]) + c["b"])), F.lit(0))


def argmax(values: Column) -> Column:
    """Index of the largest value; the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(values: Column) -> Column:
    e = F.get(F.transform(F.array(F.array_max(values)), lambda m: F.transform(values, lambda v: F.exp(v - m))), F.lit(0))
    return F.get(F.transform(F.array(e), lambda x: F.transform(x, lambda v: v / F.aggregate(x, F.lit(0.0), lambda a, b: a + b))), F.lit(0))


def centroid_head(df: DataFrame, vector: str, label: str, classes: int) -> LinearHead:
    """Nearest-centroid head, a deterministic stand-in for a trained one: w_k = c_k, b_k = -|c_k|^2 / 2."""
    x = df.select(F.col(label).alias("label"), F.posexplode(vector).alias("dim", "x"))
    rows = x.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()  # classes x dims numbers
    dims = 1 + max((r["dim"] for r in rows), default=-1)
    w = [[0.0] * dims for _ in range(classes)]
    for r in rows:
        w[r["label"]][r["dim"]] = r["m"]
    return LinearHead(w, [-sum(v * v for v in c) / 2 for c in w], [0.0] * dims, [1.0] * dims)


def confusion(df: DataFrame, truth: str, guess: str, classes: int) -> DataFrame:
    """(truth, guess, n) over all pairs of classes, zeros included."""
    spark = df.sparkSession
    pairs = spark.range(classes * classes).select((F.col("id") / classes).cast("int").alias("truth"), (F.col("id") % classes).cast("int").alias("guess"))
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))
    return pairs.join(counts, ["truth", "guess"], "left").select("truth", "guess", F.coalesce("n", F.lit(0)).alias("n"))


def scores(df: DataFrame, truth: str, guess: str, classes: int) -> DataFrame:
    """One row: n, accuracy, balanced_accuracy (mean recall of the classes present), chance."""
    cm = confusion(df, truth, guess, classes)
    per = cm.groupBy("truth").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).alias("hit"))
    return per.agg(
        F.sum("n").alias("n"), (F.sum("hit") / F.sum("n")).alias("accuracy"),
        F.avg(F.when(F.col("n") > 0, F.col("hit") / F.col("n"))).alias("balanced_accuracy")).withColumn("chance", F.lit(1.0 / classes))


def recalls(df: DataFrame, truth: str, guess: str, classes: int) -> DataFrame:
    """(label, recall) with denominator max(1, n)."""
    cm = confusion(df, truth, guess, classes)
    hit = F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0))
    return cm.groupBy(F.col("truth").alias("label")).agg((hit / F.greatest(F.sum("n"), F.lit(1))).alias("recall"))


def best_config(df: DataFrame, score: str, order: list[str]) -> DataFrame:
    """The row with the highest score, the earliest of equal ones (by ``order``)."""
    return df.orderBy(F.col(score).desc(), *order).limit(1)


def unit_edges(bins: int) -> list[float]:
    """Edges k * (1 / bins) of [0, 1], in floating point as evenly spaced grids are made; the last is 1."""
    return [k * (1.0 / bins) for k in range(bins)] + [1.0]


def unit_bin(score: Column, bins: int) -> Column:
    """Equal-width bin on [0, 1] against literal edges; right edges belong to the next bin, 1 to the last."""
    edges = F.array(*[F.lit(e) for e in unit_edges(bins)])
    return F.least(F.size(F.filter(edges, lambda e: e <= score)) - 1, F.lit(bins - 1)).cast("int")


def edge_bin(score: Column, inner: list[float]) -> Column:
    """Bin among sorted inner edges with infinite ends; right-open."""
    return F.size(F.filter(_array(inner), lambda e: e <= score)).cast("int") if inner else F.lit(0)


def order_bucket(df: DataFrame, value: str) -> Column:
    """Bucket of a continuous value for :func:`running_before`, from approximate quantiles of the column."""
    cuts = df.approxQuantile(value, [k / ORDER_BUCKETS for k in range(1, ORDER_BUCKETS)], 0.001)
    inner = sorted(set(cuts))
    return F.size(F.filter(_array(inner), lambda e: e <= F.col(value))).cast("int") if inner else F.lit(0)


def weighted_quantile_edges(df: DataFrame, value: str, weight: str, tie: str, bins: int) -> list[float]:
    """Inner edges at k/bins of the cumulative weight, linear between neighbours, clamped below; distinct.

    The running weight is bucketed; only the two rows around each of the ``bins`` - 1 targets come to the driver.
    """
    slim = df.select(F.col(value).alias("x"), F.col(weight).alias("w"), F.col(tie).alias("t"), F.lit(0).alias("g"))
    run = running_before(slim, ["g"], order_bucket(slim, "x"), ["x", "t"], F.col("w"), "before").withColumn("cum", F.col("before") + F.col("w"))
    out = []
    targets = [k / bins for k in range(1, bins)]
    aggs = []
    for i, q in enumerate(targets):
        aggs.append(F.max(F.when(F.col("cum") <= q, F.struct("cum", "x"))).alias(f"lo{i}"))
        aggs.append(F.min(F.when(F.col("cum") > q, F.struct("cum", "x"))).alias(f"hi{i}"))
    row = run.agg(*aggs).first()
    for i, q in enumerate(targets):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if lo is None and hi is None:
            continue
        if lo is None or hi is None:
            out.append((hi or lo)["x"])
        else:
            span = hi["cum"] - lo["cum"]
            out.append(lo["x"] + (hi["x"] - lo["x"]) * (q - lo["cum"]) / span)
    return sorted(set(out))


def histogram(df: DataFrame, bin_: Column, bins: int, by: list[str], pseudo: float = 0.5) -> DataFrame:
    """(by, bin, p): share of each of ``bins`` bins with a pseudocount, dense."""
    counts = df.select(*by, bin_.alias("bin")).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    groups = df.select(*by).distinct()
    dense = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    filled = dense.join(counts, [*by, "bin"], "left").withColumn("c", F.coalesce("n", F.lit(0)) + F.lit(pseudo))
    return filled.select(*by, "bin", (F.col("c") / F.sum("c").over(Window.partitionBy(*by))).alias("p"))


def kl_divergence(p: DataFrame, q: DataFrame) -> DataFrame:
    """One row: sum p * (ln p - ln q) over bins."""
    both = p.select("bin", "p").join(q.select("bin", F.col("p").alias("q")), "bin")
    return both.agg(F.sum(F.col("p") * (F.log("p") - F.log("q"))).alias("kl"))


def average_ranks(df: DataFrame, parts: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: rank of ``value`` within ``parts``, ties by their mean rank. Equal values are one row of the order."""
    counts = df.groupBy(*parts, value).agg(F.count("*").alias("__c"))
    run = running_before(counts.withColumn("__x", F.col(value).cast("double")), parts, order_bucket(counts.withColumn("__x", F.col(value).cast("double")), "__x"), ["__x"], F.col("__c"), "__r")
    ranks = run.select(*parts, value, (F.col("__r") + (F.col("__c") + 1) / 2).alias(out))
    return df.join(ranks, [*parts, value])
