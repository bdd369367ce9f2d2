"""Queries over stored vectors: weights, standardisation, heads, metrics, binning, divergence, selection.

The embeddings table has no trained head; a nearest-centroid head is the deterministic stand-in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators import joins as J
from turnloom.operators import metrics as M
from turnloom.operators import probe as P
from turnloom.operators import selection as S
from turnloom.operators import taxonomy as X
from turnloom.plans import experiments as E
from turnloom.plans import sqlkit as K
from turnloom.session import table

CLASSES, BINS, BUDGET = 10, 20, 100


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("int").alias("label"))


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    """Inverse-frequency weights over 11 classes (the last has no rows)."""
    return M.class_weights(_vectors(spark, d), "label", CLASSES + 1).select("label", "n", F.round("weight", 6).alias("weight"))


SQL_WEIGHTS = f"""
WITH n AS (SELECT r.range AS label, count(e.vec_id) AS n FROM range({CLASSES + 1}) r LEFT JOIN embeddings e ON e.label = r.range GROUP BY 1),
w AS (SELECT label, n, (SELECT sum(greatest(n, 1)) FROM n) / ({CLASSES + 1} * greatest(n, 1)) AS w FROM n)
SELECT CAST(label AS INT) AS label, n, round(w / (SELECT avg(w) FROM w), 6) AS weight FROM w
"""


def standardise(spark: SparkSession, d: str) -> DataFrame:
    """Per-dimension mean and population deviation + 1e-6."""
    return M.column_stats(_vectors(spark, d), "embedding").select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


SQL_STANDARD = """
WITH x AS (SELECT unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT CAST(dim AS INT) AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x) + 1e-6, 6) AS std FROM x GROUP BY dim
"""

_LOGITS = """
x AS (SELECT vec_id, label, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
c AS (SELECT label AS k, dim, avg(x) AS m FROM x GROUP BY ALL),
b AS (SELECT k, -sum(m * m) / 2 AS b FROM c GROUP BY k),
l AS (SELECT vec_id, label, c.k, sum(x.x * c.m) + any_value(b.b) AS z FROM x JOIN c USING (dim) JOIN b USING (k) GROUP BY vec_id, label, c.k),
p AS (SELECT vec_id, label, max(z) AS top, arg_max(k, z) AS guess, max(z) FILTER (k = 1) - max(z) FILTER (k = 0) AS odds FROM l GROUP BY vec_id, label)
"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    df = _vectors(spark, d)
    head = M.centroid_head(df, "embedding", "label", CLASSES)
    df = df.withColumn("z", M.logits(F.col("embedding"), head)).drop("embedding")
    return df.select("vec_id", "label", "z", M.argmax(F.col("z")).alias("guess"), (F.col("z")[1] - F.col("z")[0]).alias("odds"))


def probe_logits(spark: SparkSession, d: str) -> DataFrame:
    """Predicted class and its logit."""
    return _scored(spark, d).select("vec_id", "guess", F.round(F.array_max("z"), 4).alias("top"))


def log_odds(spark: SparkSession, d: str) -> DataFrame:
    """K5, K6: binary log odds and softmax probability of classes 0 and 1."""
    p = M.softmax(F.slice("z", 1, 2))[1]
    return _scored(spark, d).select("vec_id", (F.round("odds", 4) + F.lit(0.0)).alias("odds"), F.round(p, 4).alias("p"))


def confusion(spark: SparkSession, d: str) -> DataFrame:
    """Dense confusion matrix."""
    return M.confusion(_scored(spark, d), "label", "guess", CLASSES)


SQL_CONFUSION = f"""
WITH {_LOGITS} SELECT CAST(a.range AS INT) AS truth, CAST(b.range AS INT) AS guess, count(p.vec_id) AS n
FROM range({CLASSES}) a CROSS JOIN range({CLASSES}) b LEFT JOIN p ON p.label = a.range AND p.guess = b.range GROUP BY ALL
"""


def classifier_scores(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, balanced accuracy and chance."""
    out = M.scores(_scored(spark, d), "label", "guess", CLASSES)
    return out.select("n", F.round("accuracy", 6).alias("accuracy"), F.round("balanced_accuracy", 6).alias("balanced_accuracy"), "chance")


SQL_SCORES = f"""
WITH {_LOGITS}, r AS (SELECT label, avg(CAST(label = guess AS INT)) AS recall FROM p GROUP BY label)
SELECT count(*) AS n, round(avg(CAST(label = guess AS INT)), 6) AS accuracy, round((SELECT avg(recall) FROM r), 6) AS balanced_accuracy, CAST(0.1 AS DOUBLE) AS chance FROM p
"""


def class_recalls(spark: SparkSession, d: str) -> DataFrame:
    """Recall of each class."""
    return M.recalls(_scored(spark, d), "label", "guess", CLASSES).select("label", F.round("recall", 6).alias("recall"))


SQL_RECALLS = f"""
WITH {_LOGITS} SELECT CAST(r.range AS INT) AS label, round(coalesce(sum(CAST(p.label = p.guess AS INT)), 0) / greatest(count(p.vec_id), 1), 6) AS recall
FROM range({CLASSES}) r LEFT JOIN p ON p.label = r.range GROUP BY 1
"""


def probe_fit(spark: SparkSession, d: str) -> DataFrame:
    """The epoch-limited grid on two feature blocks, labels 0 against the rest; scores per configuration."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = _vectors(spark, d).select(
        F.explode(F.array(F.struct(F.lit("first").alias("feature"), F.slice(v, 1, 32).alias("v")), F.struct(F.lit("second").alias("feature"), F.slice(v, 33, 32).alias("v")))).alias("f"),
        (F.col("label") == 0).cast("int").alias("label"), F.when(T.hash_unit("split", F.col("vec_id")) < 0.7, "train").otherwise("val").alias("split"))
    fitted = P.fit_grid(rows.select("f.feature", "f.v", "label", "split"), 2)
    return fitted.select("feature", "decay", F.round("score", 4).alias("score"))


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Equal-width bins of P(class 1) for two cohorts, and each bin's quota."""
    df = _cohorts(spark, d).withColumn("bin", M.unit_bin(F.col("p"), BINS))
    n = df.groupBy("bin").agg(F.count_if(F.col("cohort") == "a").alias("n_a"), F.count_if(F.col("cohort") == "b").alias("n_b"))
    return n.select("bin", "n_a", "n_b", F.least("n_a", "n_b").alias("quota"))


def _cohorts(spark: SparkSession, d: str) -> DataFrame:
    cohort = F.when(F.col("label") < 5, "a").otherwise("b")
    return _vectors(spark, d).select("vec_id", cohort.alias("cohort"), T.hash_unit("score", F.col("vec_id")).alias("p"))


_COHORTS = f"""
c AS (SELECT vec_id, CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS cohort, {K.unit('score', 'vec_id')} AS p FROM embeddings),
h AS (SELECT *, CAST(least(len(list_filter(CAST({M.unit_edges(BINS)!r} AS DOUBLE[]), lambda e: e <= p)) - 1, {BINS - 1}) AS INT) AS bin FROM c)
"""
SQL_HISTOGRAM = f"""
WITH {_COHORTS}, n AS (SELECT bin, count(*) FILTER (cohort = 'a') AS n_a, count(*) FILTER (cohort = 'b') AS n_b FROM h GROUP BY bin)
SELECT bin, n_a, n_b, least(n_a, n_b) AS quota FROM n
"""


def score_match(spark: SparkSession, d: str) -> DataFrame:
    """Rows kept so that every bin holds as many of either cohort."""
    return X.score_match(_cohorts(spark, d), "cohort", "p", "vec_id", BINS, "42").select("vec_id", "cohort", "bin")


SQL_MATCH = f"""
WITH {_COHORTS}, n AS (SELECT bin, least(count(*) FILTER (cohort = 'a'), count(*) FILTER (cohort = 'b')) AS quota FROM h GROUP BY bin),
r AS (SELECT *, row_number() OVER (PARTITION BY cohort, bin ORDER BY {K.order('42', 'vec_id')}, vec_id) AS k FROM h)
SELECT vec_id, cohort, bin FROM r JOIN n USING (bin) WHERE k <= quota
"""


def gumbel_topk(spark: SparkSession, d: str) -> DataFrame:
    """Importance-sampled donors (labels other than 1) by log odds, with prefix positions."""
    df = _scored(spark, d).where("label <> 1").select("vec_id", "label", "odds")
    out = S.gumbel_top(df, "odds", "vec_id", BUDGET, "0")
    return out.select("vec_id", "label", F.col("position").cast("int").alias("position"))


_GUMBEL = f"(odds - ln(-ln({K.unit('0', 'vec_id')})))"
SQL_GUMBEL = f"""
WITH {_LOGITS} SELECT vec_id, CAST(label AS INT) AS label, CAST(row_number() OVER (ORDER BY {_GUMBEL} DESC, vec_id) AS INT) AS position
FROM p WHERE label <> 1 ORDER BY position LIMIT {BUDGET}
"""


def uniform_topk(spark: SparkSession, d: str) -> DataFrame:
    """The uniform baseline of the same budget."""
    df = _vectors(spark, d).where("label <> 1").select("vec_id")
    return S.uniform_top(df, "vec_id", BUDGET, "0").select("vec_id", F.col("position").cast("int").alias("position"))


SQL_UNIFORM = f"""
SELECT vec_id, CAST(row_number() OVER (ORDER BY {K.order('0', 'vec_id')}, vec_id) AS INT) AS position FROM embeddings WHERE label <> 1 ORDER BY position LIMIT {BUDGET}
"""


def mix_composition(spark: SparkSession, d: str) -> DataFrame:
    """Donors by label in half and all of the budget."""
    full = gumbel_topk(spark, d)
    half = S.composition(full.where(F.col("position") <= BUDGET // 2), "label").withColumn("pct", F.lit(50))
    return half.unionByName(S.composition(full, "label").withColumn("pct", F.lit(100)))


SQL_MIX = f"WITH t AS ({SQL_GUMBEL}) SELECT label, count(*) AS n, 50 AS pct FROM t WHERE position <= {BUDGET // 2} GROUP BY label UNION ALL SELECT label, count(*), 100 FROM t GROUP BY label"


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    df = _scored(spark, d).select("vec_id", "label", "odds")
    n = df.agg(F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") != 1).alias("o")).first()
    return df.withColumn("w", F.when(F.col("label") == 1, F.lit(0.5 / n["t"])).otherwise(F.lit(0.5 / n["o"])))


def quantile_edges(spark: SparkSession, d: str) -> DataFrame:
    """K9: inner edges of equal total weight on target (label 1) and donors."""
    edges = M.weighted_quantile_edges(_weighted(spark, d), "odds", "w", "vec_id", BINS)
    return spark.createDataFrame([(i, round(e, 3)) for i, e in enumerate(edges)], "k int, edge double")


_EDGES = f"""
{_LOGITS},
n AS (SELECT vec_id, label, odds, 0.5 / sum(1) OVER (PARTITION BY label = 1) AS w FROM p),
cum AS (SELECT odds AS x, sum(w) OVER (ORDER BY odds, vec_id) AS c FROM n),
q AS (SELECT range / {BINS}.0 AS q FROM range(1, {BINS})),
br AS (SELECT q, arg_max(x, c) FILTER (c <= q) AS x0, max(c) FILTER (c <= q) AS c0, arg_min(x, c) FILTER (c > q) AS x1, min(c) FILTER (c > q) AS c1 FROM q, cum GROUP BY q),
e AS (SELECT DISTINCT CASE WHEN x0 IS NULL THEN x1 WHEN x1 IS NULL THEN x0 ELSE x0 + (x1 - x0) * (q - c0) / (c1 - c0) END AS e FROM br)
"""
SQL_EDGES = f"WITH {_EDGES} SELECT CAST(row_number() OVER (ORDER BY e) - 1 AS INT) AS k, round(e, 3) AS edge FROM e"


def delta_kl(spark: SparkSession, d: str) -> DataFrame:
    """How much closer the importance sample is to the target than the uniform one."""
    df = _weighted(spark, d)
    edges = M.weighted_quantile_edges(df, "odds", "w", "vec_id", BINS)
    bins = len(edges) + 1
    hist = lambda x: M.histogram(x.withColumn("g", F.lit(0)), M.edge_bin(F.col("odds"), edges), bins, ["g"])
    target = hist(df.where("label = 1"))
    kls = []
    for picked in (gumbel_topk(spark, d), uniform_topk(spark, d)):
        kls.append(M.kl_divergence(target, hist(df.join(picked.select("vec_id"), "vec_id", "left_semi"))).first()["kl"])
    return spark.createDataFrame([(round(kls[1], 4), round(kls[0], 4), round(kls[1] - kls[0], 4))], "kl_uniform double, kl_gumbel double, delta double")


SQL_KL = f"""
WITH {_EDGES},
binned AS (SELECT vec_id, label, (SELECT count(*) FROM e WHERE e.e <= p.odds) AS bin FROM p),
g AS (SELECT vec_id FROM p WHERE label <> 1 ORDER BY {_GUMBEL} DESC, vec_id LIMIT {BUDGET}),
u AS (SELECT vec_id FROM p WHERE label <> 1 ORDER BY {K.order('0', 'vec_id')}, vec_id LIMIT {BUDGET}),
bins AS (SELECT range AS bin FROM range((SELECT count(*) + 1 FROM e))),
cnt AS (SELECT bins.bin, count(*) FILTER (binned.label = 1) + 0.5 AS t, count(*) FILTER (binned.vec_id IN (SELECT vec_id FROM g)) + 0.5 AS g, count(*) FILTER (binned.vec_id IN (SELECT vec_id FROM u)) + 0.5 AS u
  FROM bins LEFT JOIN binned USING (bin) GROUP BY bins.bin),
s AS (SELECT t / sum(t) OVER () AS t, g / sum(g) OVER () AS g, u / sum(u) OVER () AS u FROM cnt),
r AS (SELECT sum(t * (ln(t) - ln(u))) AS ku, sum(t * (ln(t) - ln(g))) AS kg FROM s)
SELECT round(ku, 4) AS kl_uniform, round(kg, 4) AS kl_gumbel, round(ku - kg, 4) AS delta FROM r
"""


def correlations(spark: SparkSession, d: str) -> DataFrame:
    """Pearson and Spearman (average ranks) of words and messages, per source."""
    df = table(spark, d, "interim_record").select("rec_id", "source", "n_words_user", "n_turns")
    pearson = df.groupBy("source").agg(F.corr("n_words_user", "n_turns").alias("r"), F.count("*").alias("n"))
    ranked = M.average_ranks(M.average_ranks(df, ["source"], "n_words_user", "ra"), ["source"], "n_turns", "rb")
    rho = ranked.groupBy("source").agg(F.corr("ra", "rb").alias("rho"))
    return pearson.join(rho, "source").select("source", F.round("r", 6).alias("r"), F.round("rho", 6).alias("rho"), "n")


SQL_CORR = """
WITH k AS (SELECT source, n_words_user AS a, n_turns AS b, rank() OVER (PARTITION BY source ORDER BY n_words_user) + (count(*) OVER (PARTITION BY source, n_words_user) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY source ORDER BY n_turns) + (count(*) OVER (PARTITION BY source, n_turns) - 1) / 2.0 AS rb FROM interim_record)
SELECT source, round(corr(a, b), 6) AS r, round(corr(ra, rb), 6) AS rho, count(*) AS n FROM k GROUP BY source
"""


def transfer_gap(spark: SparkSession, d: str) -> DataFrame:
    """Symmetric gaps; mean squared centroid distance stands in for the loss of one source on another."""
    df = _vectors(spark, d)
    x = df.select("label", "vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    c = x.groupBy(F.col("label").alias("train"), "dim").agg(F.avg("x").alias("m"))
    nll = x.join(F.broadcast(c), "dim").groupBy("train", F.col("label").alias("test")).agg((F.sum((F.col("x") - F.col("m")) ** 2) / F.count_distinct("vec_id")).alias("nll"))
    return S.transfer_gaps(nll).select("a", "b", F.round("gap", 4).alias("gap"))


SQL_GAP = """
WITH x AS (SELECT label, vec_id, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
c AS (SELECT label AS train, dim, avg(x) AS m FROM x GROUP BY ALL),
n AS (SELECT c.train, x.label AS test, sum((x.x - c.m) * (x.x - c.m)) / count(DISTINCT vec_id) AS nll FROM x JOIN c USING (dim) GROUP BY ALL)
SELECT CAST(ab.train AS INT) AS a, CAST(ab.test AS INT) AS b, round(0.5 * (ab.nll - bb.nll + ba.nll - aa.nll), 4) AS gap
FROM n ab JOIN n ba ON ba.train = ab.test AND ba.test = ab.train JOIN n aa ON aa.train = ab.train AND aa.test = ab.train
JOIN n bb ON bb.train = ab.test AND bb.test = ab.test WHERE ab.train < ab.test
"""

def confusion_shares(spark: SparkSession, d: str) -> DataFrame:
    """V3: confusion matrix with row shares."""
    return E.confusion_report(_scored(spark, d), "label", "guess", CLASSES).select("truth", "guess", "n", F.round("share", 6).alias("share"))


SQL_SHARES = f"""
WITH t AS ({SQL_CONFUSION}) SELECT truth, guess, n, round(n / greatest(sum(n) OVER (PARTITION BY truth), 1), 6) AS share FROM t
"""


def score_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Least, mean and greatest score over combinations (recalls stand in for the scores, parity for the comparison)."""
    rows = class_recalls(spark, d).withColumn("even", F.col("label") % 2 == 0)
    return E.score_ranges(rows, ["even"], "recall").select("even", *[F.round(c, 6).alias(c) for c in ("low", "mean", "high")])


SQL_RANGES = f"WITH t AS ({SQL_RECALLS}) SELECT label % 2 = 0 AS even, round(min(recall), 6) AS low, round(avg(recall), 6) AS mean, round(max(recall), 6) AS high FROM t GROUP BY 1"


def selection_gains(spark: SparkSession, d: str) -> DataFrame:
    """Gains of selected over random donors in divergence and loss (mean distance of the odds stands in for the loss)."""
    df = _scored(spark, d).select("vec_id", "label", "odds")
    picks = {"dsir": S.gumbel_top(df.where("label <> 1"), "odds", "vec_id", BUDGET, "0"), "random": S.uniform_top(df.where("label <> 1"), "vec_id", BUDGET, "0")}
    mean = lambda x, m: x.agg(F.avg("odds").alias("value")).select(F.lit("one").alias("target"), F.lit(100).alias("pct"), F.lit(m).alias("method"), "value")
    value = J.union_all([mean(p, m) for m, p in picks.items()])
    out = E.selection_gains(value, value.withColumn("value", -F.col("value")))
    return out.select("target", "pct", F.round("delta_kl", 3).alias("delta_kl"), F.round("delta_nll", 3).alias("delta_nll"))


SQL_GAINS = f"""
WITH {_LOGITS}, g AS (SELECT odds FROM p WHERE label <> 1 ORDER BY {_GUMBEL} DESC, vec_id LIMIT {BUDGET}), u AS (SELECT odds FROM p WHERE label <> 1 ORDER BY {K.order('0', 'vec_id')}, vec_id LIMIT {BUDGET}),
gain AS (SELECT (SELECT avg(odds) FROM u) - (SELECT avg(odds) FROM g) AS k)
SELECT 'one' AS target, 100 AS pct, round(k, 3) AS delta_kl, round(-k, 3) AS delta_nll FROM gain
"""

CATALOGUE = {
    "confusion_shares": (confusion_shares, SQL_SHARES),
    "score_ranges": (score_ranges, SQL_RANGES),
    "selection_gains": (selection_gains, SQL_GAINS),
    "class_weights": (class_weights, SQL_WEIGHTS),
    "standardise": (standardise, SQL_STANDARD),
    "probe_logits": (probe_logits, f"WITH {_LOGITS} SELECT vec_id, CAST(guess AS INT) AS guess, round(top, 4) AS top FROM p"),
    "log_odds": (log_odds, f"WITH {_LOGITS} SELECT vec_id, round(odds, 4) + 0.0 AS odds, round(1 / (1 + exp(-odds)), 4) AS p FROM p"),
    "confusion": (confusion, SQL_CONFUSION),
    "classifier_scores": (classifier_scores, SQL_SCORES),
    "class_recalls": (class_recalls, SQL_RECALLS),
    "probe_fit": (probe_fit, None),
    "score_histogram": (score_histogram, SQL_HISTOGRAM),
    "score_match": (score_match, SQL_MATCH),
    "gumbel_topk": (gumbel_topk, SQL_GUMBEL),
    "uniform_topk": (uniform_topk, SQL_UNIFORM),
    "mix_composition": (mix_composition, SQL_MIX),
    "quantile_edges": (quantile_edges, SQL_EDGES),
    "delta_kl": (delta_kl, SQL_KL),
    "correlations": (correlations, SQL_CORR),
    "transfer_gap": (transfer_gap, SQL_GAP),
}
