"""Annotation logs, conversation categories, category shares and differences, matching, noise floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.functions import text as T
from turnloom.operators.integer import NotCertified, maximise
from turnloom.operators.metrics import unit_bin
from turnloom.ranking import hash_rank
from turnloom.staging import Stage

# Statuses that may be tried again.
RETRY = ("error", "invalid", "incomplete")
#: The ends of halves, two a group and repetition, are broadcast up to this many rows.
BROADCAST_ROWS = 500_000


def latest(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Last write per key of an append log (all columns of the row with the greatest ``seq``)."""
    return log.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(F.struct(*log.columns), seq).alias("r")).select("r.*")


def todo(wanted: DataFrame, log: DataFrame, keys: list[str], retry: bool = False) -> DataFrame:
    """Wanted units without a logged attempt; with ``retry`` those whose latest attempt failed come again."""
    done = latest(log, keys)
    if retry:
        done = done.where(~F.coalesce(F.col("status").isin(*RETRY), F.lit(False)))
    return wanted.join(done.select(*keys), keys, "left_anti")


def judged_status(labels: Column, confidence: Column, allowed: list[str], threshold: float) -> Column:
    """accepted, low_confidence or invalid: labels must be known and not empty ('none' is a known label)."""
    known = F.array(*[F.lit(x) for x in allowed])
    valid = (F.size(labels) > 0) & (F.size(F.array_except(labels, known)) == 0)
    return F.when(~F.coalesce(valid, F.lit(False)), "invalid").when(confidence >= threshold, "accepted").otherwise("low_confidence")


def conversation_units(records: DataFrame, conv_id: str = "conv_id", n_turns: str = "n_turns") -> DataFrame:
    """(conversation_id, turn): one unit per exchange; an odd last message is an exchange of its own."""
    last = F.ceil(F.col(n_turns) / 2).cast("int") - 1
    return records.where(F.col(n_turns) > 0).select(F.col(conv_id).alias("conversation_id"), F.explode(F.sequence(F.lit(0), last)).alias("turn")).distinct()


def conversation_categories(units: DataFrame, log: DataFrame, hierarchy: DataFrame, parents: list[str]) -> DataFrame:
    """(conversation_id, complete, categories, vector) from the latest attempts; missing units are pending.

    A conversation is complete when it has units and all are accepted. ``hierarchy`` is (parent, child), a small
    fixed table; labels without a parent are dropped. ``vector`` is 0/1 in the order of ``parents``.
    """
    seen = units.join(latest(log, ["conversation_id", "turn"]).select("conversation_id", "turn", "status", "labels"), ["conversation_id", "turn"], "left")
    ok = F.coalesce(F.col("status"), F.lit("pending")) == "accepted"
    mapped = {r["child"]: r["parent"] for r in hierarchy.collect()}
    lookup = F.create_map(*[F.lit(x) for kv in mapped.items() for x in kv])
    broad = F.filter(F.transform(F.when(ok, F.col("labels")), lambda x: F.try_element_at(lookup, x)), lambda x: x.isNotNull())
    out = seen.groupBy("conversation_id").agg(
        (F.count_if(ok) == F.count("*")).alias("complete"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(broad)))).alias("categories"))
    vector = F.array(*[F.array_contains("categories", p).cast("int") for p in parents])
    return out.select("conversation_id", "complete", "categories", vector.alias("vector"))


def category_shares(annotated: DataFrame, by: list[str]) -> DataFrame:
    """(by, pos, share) over complete conversations."""
    x = annotated.where("complete").select(*by, F.posexplode("vector").alias("pos", "x"))
    return x.groupBy(*by, "pos").agg(F.avg("x").alias("share"))


def category_difference(shares_a: DataFrame, shares_b: DataFrame) -> DataFrame:
    """One row: mean absolute difference of shares in percentage points."""
    both = shares_a.select("pos", F.col("share").alias("a")).join(shares_b.select("pos", F.col("share").alias("b")), "pos")
    return both.agg((F.avg(F.abs(F.col("a") - F.col("b"))) * 100).alias("difference"))


def match_cells(a: DataFrame, b: DataFrame, vector: str = "vector") -> DataFrame:
    """(vector, n_a, n_b, n): rows of equal vectors on both sides, and the smaller number."""
    left, right = (x.groupBy(vector).agg(F.count("*").alias(n)) for x, n in ((a, "n_a"), (b, "n_b")))
    both = left.join(right, vector, "full_outer").na.fill(0, ["n_a", "n_b"])
    return both.withColumn("n", F.least("n_a", "n_b"))


def maximum_match(cells: list[tuple[tuple[int, ...], int, int]], seconds: float = 1800.0) -> list[tuple[int, int]]:
    """Per-cell picks (z_a, z_b), proved to keep most rows with equal counts and equal per-feature totals.

    ``cells`` is :func:`match_cells` as (vector, n_a, n_b): few distinct vectors, whatever the number of rows. The
    integer program is solved exactly; NotCertified where ``seconds`` do not do for the proof, and where only the
    empty selection is feasible.
    """
    of_a, of_b = ([i for i, c in enumerate(cells) if c[side]] for side in (1, 2))
    vectors = [(1, *c[0]) for c in cells]
    width = len(vectors[0]) if vectors else 0
    a = [[vectors[i][f] for i in of_a] + [-vectors[i][f] for i in of_b] for f in range(width)]
    caps = [cells[i][1] for i in of_a] + [cells[i][2] for i in of_b]
    least = [min(c[1], c[2]) for c in cells]  # equal vectors on both sides always match
    z = maximise([1] * len(of_a) + [0] * len(of_b), a, caps, [least[i] for i in of_a] + [least[i] for i in of_b], seconds) if caps else []
    picks = [[0, 0] for _ in cells]
    for k, i in enumerate(of_a):
        picks[i][0] = z[k]
    for k, i in enumerate(of_b):
        picks[i][1] = z[len(of_a) + k]
    for f in range(width):
        if sum(v[f] * p[0] for v, p in zip(vectors, picks)) != sum(v[f] * p[1] for v, p in zip(vectors, picks)):
            raise AssertionError("totals of the picks differ")
    if not any(p[0] for p in picks):
        raise NotCertified("only the empty selection fits")
    return [tuple(p) for p in picks]


def pick_rows(df: DataFrame, quotas: DataFrame, keys: list[str], row_id: str, seed: str) -> DataFrame:
    """Per key the first ``quota`` rows in hash order; ``quotas`` is (keys, quota)."""
    ranked = hash_rank(df.withColumn("__h", T.hash_order(seed, F.col(row_id))), keys, "__h", [row_id])
    return ranked.join(quotas, keys).where(F.col("rank") <= F.col("quota")).select(*df.columns)


def score_match(df: DataFrame, cohort: str, score: str, row_id: str, bins: int, seed: str) -> DataFrame:
    """Rows of two cohorts so that every equal-width bin holds as many of each (the smaller number)."""
    binned = df.withColumn("bin", unit_bin(F.col(score), bins))
    counts = binned.groupBy("bin", cohort).agg(F.count("*").alias("n"))
    quota = counts.groupBy("bin").agg(F.when(F.count("*") == 2, F.min("n")).otherwise(F.lit(0)).alias("quota"))
    ranked = hash_rank(binned.withColumn("__h", T.hash_order(seed, F.col(row_id))), [cohort, "bin"], "__h", [row_id])
    return ranked.join(quota, "bin").where(F.col("rank") <= F.col("quota")).select(*df.columns, "bin")


def noise_floor(annotated: DataFrame, by: list[str], row_id: str, repetitions: int, seed: str) -> DataFrame:
    """(by, noise): median category difference of random disjoint halves (an odd row is left out).

    Each repetition orders the rows by its own hash. Rows are counted by the first hex digit of their hash and by
    vector; only rows of a digit that holds the end of a half are ranked one by one (in buckets). Hashing grows with
    rows times repetitions, as stated by the method; the counts grow with repetitions times distinct vectors.
    """
    keys = [*by, "rep"]
    stage = Stage(annotated.sparkSession, "noise")
    rows = stage.write(annotated.dropna(subset=by).select(*by, row_id, F.when(F.col("complete"), F.col("vector")).alias("vector")), "rows")
    drawn = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
    drawn = drawn.withColumn("__h", T.hash_order(seed, F.concat_ws(":", "rep", row_id))).withColumn("digit", F.ascii("__h"))
    counts = drawn.groupBy(*keys, "digit", "vector").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("digit")
    half = F.floor(F.sum("n").over(Window.partitionBy(*keys)) / 2)
    before = F.coalesce(F.sum("n").over(upto.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    end = F.sum("n").over(upto.rangeBetween(Window.unboundedPreceding, 0))
    counts = stage.write(counts.select("*", half.alias("half"), before.alias("before"), end.alias("end")), "counts")
    whole = (F.col("end") <= F.col("half")) | ((F.col("before") >= F.col("half")) & (F.col("end") <= 2 * F.col("half")))
    cut = stage.write(counts.where(~whole).select(*keys, "digit", "half", "before").distinct(), "cut")
    cut = F.broadcast(cut) if cut.count() <= BROADCAST_ROWS else cut
    ranked = hash_rank(drawn.join(cut, [*keys, "digit"]), [*keys, "digit"], "__h", [row_id]).withColumn("end", F.col("before") + F.col("rank"))
    placed = counts.where(whole).select(*keys, "vector", "half", "end", "n").unionByName(ranked.select(*keys, "vector", "half", "end", F.lit(1).cast("long").alias("n")))
    side = F.when(F.col("end") <= F.col("half"), F.lit("a")).when(F.col("end") <= 2 * F.col("half"), F.lit("b"))
    halves = placed.withColumn("side", side).where(F.col("side").isNotNull() & F.col("vector").isNotNull())
    few = halves.groupBy(*keys, "side", "vector").agg(F.sum("n").alias("n"))
    x = few.select(*keys, "side", "n", F.posexplode("vector").alias("pos", "x")).where(F.col("x").isNotNull())

    def mean(of: str) -> Column:
        n = F.when(F.col("side") == of, F.col("n"))
        return F.sum(n * F.col("x")) / F.sum(n)

    wide = x.groupBy(*keys, "pos").agg(mean("a").alias("a"), mean("b").alias("b"))
    per = wide.groupBy(*keys).agg((F.avg(F.abs(F.col("a") - F.col("b"))) * 100).alias("d"))
    return per.groupBy(*by).agg(F.median("d").alias("noise"))
