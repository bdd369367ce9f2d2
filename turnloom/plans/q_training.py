"""Queries over annotation logs, categories, training samples, tasks and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators import conversation as C
from turnloom.operators import selection as S
from turnloom.operators import sft
from turnloom.operators import tasks as K2
from turnloom.operators import taxonomy as X
from turnloom.plans import sqlkit as K
from turnloom.session import table

#: Stand-in hierarchy for the external taxonomy: parent -> children; 'none' has no parent.
PARENTS = {"expression": ("creative", "roleplay", "rewriting"), "information": ("factual", "advice"), "production": ("coding", "calculation", "planning")}
LABELS = sorted(c for cs in PARENTS.values() for c in cs) + ["none"]
#: Threshold of the annotations, and draws of the noise floor (the reference's).
THRESHOLD, REPETITIONS = 0.7, 1000


def _hierarchy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, c) for p, cs in PARENTS.items() for c in cs], "parent string, child string")


def _units(spark: SparkSession, d: str) -> DataFrame:
    convs = table(spark, d, "interim_record").select("conv_id", "n_turns")
    logged = table(spark, d, "unit").select(F.col("conversation_id").alias("conv_id")).distinct()
    return X.conversation_units(convs.join(logged, "conv_id", "left_semi"))


def annotation_latest(spark: SparkSession, d: str) -> DataFrame:
    """Last write per unit of the annotation log."""
    out = X.latest(table(spark, d, "unit"), ["conversation_id", "turn"])
    return out.select("conversation_id", "turn", "seq", "status", F.array_join("labels", ",").alias("labels"))


SQL_LATEST = """
SELECT conversation_id, turn, seq, status, array_to_string(labels, ',') AS labels
FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id, turn ORDER BY seq DESC) AS k FROM unit) WHERE k = 1
"""


def annotation_todo(spark: SparkSession, d: str) -> DataFrame:
    """Units without an attempt, or whose last attempt failed."""
    return X.todo(_units(spark, d), table(spark, d, "unit"), ["conversation_id", "turn"], retry=True)


_LATEST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id, turn ORDER BY seq DESC) AS k FROM unit) WHERE k = 1)"
_UNITS = """
u AS (SELECT DISTINCT conv_id AS conversation_id, CAST(unnest(range(CAST(ceil(n_turns / 2.0) AS INT))) AS INT) AS turn FROM interim_record
  WHERE conv_id IN (SELECT conversation_id FROM unit))
"""
SQL_TODO = f"WITH {_LATEST}, {_UNITS} SELECT u.conversation_id, u.turn FROM u LEFT JOIN l USING (conversation_id, turn) WHERE l.seq IS NULL OR l.status IN ('error', 'invalid', 'incomplete')"


def annotation_status(spark: SparkSession, d: str) -> DataFrame:
    """Units by status of their last attempt, pending where there is none."""
    last = X.latest(table(spark, d, "unit"), ["conversation_id", "turn"]).select("conversation_id", "turn", "status")
    both = _units(spark, d).join(last, ["conversation_id", "turn"], "left")
    return both.groupBy(F.coalesce("status", F.lit("pending")).alias("status")).agg(F.count("*").alias("n"))


SQL_STATUS = f"WITH {_LATEST}, {_UNITS} SELECT coalesce(l.status, 'pending') AS status, count(*) AS n FROM u LEFT JOIN l USING (conversation_id, turn) GROUP BY 1"


def annotation_judged(spark: SparkSession, d: str) -> DataFrame:
    """Attempts judged by label set and confidence threshold."""
    status = X.judged_status(F.col("labels"), F.col("confidence"), LABELS, THRESHOLD)
    return table(spark, d, "unit").select("seq", status.alias("judged"))


_LABEL_LIST = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
SQL_JUDGED = f"""
SELECT seq, CASE WHEN NOT coalesce(len(labels) > 0 AND len(list_filter(labels, lambda x: x IS NULL OR NOT list_contains({_LABEL_LIST}, x))) = 0, false) THEN 'invalid'
  WHEN confidence >= {THRESHOLD} THEN 'accepted' ELSE 'low_confidence' END AS judged FROM unit
"""


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    ann = X.conversation_categories(_units(spark, d), table(spark, d, "unit"), _hierarchy(spark), list(PARENTS))
    source = table(spark, d, "interim_record").groupBy("conv_id").agg(F.min("source").alias("source"))
    return ann.join(source, F.col("conversation_id") == F.col("conv_id")).drop("conv_id")


def conversation_categories(spark: SparkSession, d: str) -> DataFrame:
    """Broad categories and completeness per conversation."""
    return _annotated(spark, d).select("conversation_id", "complete", F.array_join("categories", ",").alias("categories"))


_PARENT_OF = "CASE " + " ".join(f"WHEN x IN ({', '.join(repr(c) for c in cs)}) THEN '{p}'" for p, cs in PARENTS.items()) + " END"
_ANNOTATED = f"""
{_LATEST}, {_UNITS},
s AS (SELECT u.conversation_id, coalesce(l.status, 'pending') = 'accepted' AS ok, CASE WHEN l.status = 'accepted' THEN l.labels END AS labels FROM u LEFT JOIN l USING (conversation_id, turn)),
a AS (SELECT conversation_id, bool_and(ok) AS complete, list_sort(list_distinct(coalesce(flatten(list(list_filter(list_transform(coalesce(labels, []), lambda x: {_PARENT_OF}), lambda x: x IS NOT NULL))), []))) AS categories
  FROM s GROUP BY conversation_id),
so AS (SELECT conv_id, min(source) AS source FROM interim_record GROUP BY conv_id),
an AS (SELECT conversation_id, complete, categories, source, unnest({list(PARENTS)!r}) AS parent, unnest(range({len(PARENTS)})) AS pos FROM a JOIN so ON conv_id = conversation_id),
v AS (SELECT *, CAST(list_contains(categories, parent) AS INT) AS x FROM an)
"""
SQL_CATEGORIES = f"WITH {_ANNOTATED} SELECT conversation_id, complete, array_to_string(categories, ',') AS categories FROM a"


def prevalence(spark: SparkSession, d: str) -> DataFrame:
    """Share of complete conversations holding each category, in percent, per source."""
    shares = X.category_shares(_annotated(spark, d), ["source"])
    return shares.select("source", F.col("pos").cast("int").alias("pos"), F.bround(100 * F.round("share", 9), 1).alias("percent"))


SQL_PREVALENCE = f"""
WITH {_ANNOTATED}, p AS (SELECT source, CAST(pos AS INT) AS pos, 1000 * round(avg(x), 9) AS y FROM v WHERE complete GROUP BY ALL)
SELECT source, pos, (CASE WHEN y - floor(y) = 0.5 THEN 2 * round(y / 2) ELSE round(y) END) / 10 AS percent FROM p
"""


def category_difference(spark: SparkSession, d: str) -> DataFrame:
    """Mean absolute share difference of two sources, in points."""
    ann = _annotated(spark, d)
    shares = [X.category_shares(ann.where(F.col("source") == s), []) for s in ("wildchat_1m", "lmsys")]
    return X.category_difference(*shares).select(F.round("difference", 6).alias("difference"))


SQL_DIFFERENCE = f"""
WITH {_ANNOTATED}, sh AS (SELECT pos, avg(x) FILTER (source = 'wildchat_1m') AS a, avg(x) FILTER (source = 'lmsys') AS b FROM v WHERE complete AND source IN ('wildchat_1m', 'lmsys') GROUP BY pos)
SELECT round(avg(abs(a - b)) * 100, 6) AS difference FROM sh
"""


def match_cells(spark: SparkSession, d: str) -> DataFrame:
    """Equal category vectors of two sources with their multiplicities."""
    ann = _annotated(spark, d).where("complete").withColumn("vector", F.array_join(F.col("vector").cast("array<string>"), ""))
    a, b = (ann.where(F.col("source") == s) for s in ("wildchat_1m", "lmsys"))
    return X.match_cells(a, b)


SQL_CELLS = f"""
WITH {_ANNOTATED}, k AS (SELECT conversation_id, source, string_agg(CAST(x AS VARCHAR), '' ORDER BY pos) AS vector FROM v WHERE complete GROUP BY ALL)
SELECT vector, count(*) FILTER (source = 'wildchat_1m') AS n_a, count(*) FILTER (source = 'lmsys') AS n_b,
  least(count(*) FILTER (source = 'wildchat_1m'), count(*) FILTER (source = 'lmsys')) AS n FROM k WHERE source IN ('wildchat_1m', 'lmsys') GROUP BY vector
"""


def maximum_match(spark: SparkSession, d: str) -> DataFrame:
    """Size of the largest subsets with equal sizes and category totals, and the totals of both sides.

    The integer program works on the distinct vectors (at most 2**categories) and is solved to a proof.
    """
    ann = _annotated(spark, d).where("complete")
    a, b = (ann.where(F.col("source") == s) for s in ("wildchat_1m", "lmsys"))
    rows = X.match_cells(a, b).collect()  # at most 2**categories distinct vectors
    cells = sorted((tuple(r["vector"]), r["n_a"], r["n_b"]) for r in rows)
    picks = X.maximum_match(cells)
    size = sum(p[0] for p in picks)
    totals = [[sum(c[0][f] * p[side] for c, p in zip(cells, picks)) for f in range(len(PARENTS))] for side in (0, 1)]
    return spark.createDataFrame([(size, sum(p[1] for p in picks), totals[0] == totals[1])], "size_a bigint, size_b bigint, equal_totals boolean")


#: The least promise of multipliers from a grid for the equal totals: an upper bound of every match by weak duality. Where
#: a match reaches it, the match is largest.
SQL_MAXIMUM = f"""
WITH {_ANNOTATED}, k AS (SELECT conversation_id, source, list(x ORDER BY pos) AS vec FROM v WHERE complete GROUP BY ALL),
n AS (SELECT vec, count(*) FILTER (source = 'wildchat_1m') AS a, count(*) FILTER (source = 'lmsys') AS b FROM k WHERE source IN ('wildchat_1m', 'lmsys') GROUP BY vec),
g AS (SELECT (range - 4) / 2.0 AS p FROM range(9)),
m AS (SELECT p0.p AS p0, p1.p AS p1, p2.p AS p2, p3.p AS p3, sum(greatest(0, 1 - (p0.p + p1.p * vec[1] + p2.p * vec[2] + p3.p * vec[3])) * a + greatest(0, p0.p + p1.p * vec[1] + p2.p * vec[2] + p3.p * vec[3]) * b) AS most
  FROM g p0, g p1, g p2, g p3, n GROUP BY ALL)
SELECT CAST(floor(min(most) + 1e-9) AS BIGINT) AS size_a, CAST(floor(min(most) + 1e-9) AS BIGINT) AS size_b, true AS equal_totals FROM m
"""


def _noise_floor(spark: SparkSession, d: str, repetitions: int) -> DataFrame:
    out = X.noise_floor(_annotated(spark, d), ["source"], "conversation_id", repetitions, "42")
    return out.select("source", F.round("noise", 6).alias("noise"))


def noise_floor(spark: SparkSession, d: str) -> DataFrame:
    """Median category difference of random halves per source, over the reference's 1000 draws."""
    return _noise_floor(spark, d, REPETITIONS)


SQL_NOISE = f"""
WITH {_ANNOTATED},
r AS (SELECT conversation_id, source, rep, row_number() OVER (PARTITION BY source, rep ORDER BY md5('42:' || rep || ':' || conversation_id), conversation_id) AS k, count(*) OVER (PARTITION BY source, rep) AS n
  FROM (SELECT DISTINCT conversation_id, source FROM v) CROSS JOIN (SELECT range AS rep FROM range({REPETITIONS}))),
h AS (SELECT conversation_id, source, rep, CASE WHEN k <= floor(n / 2) THEN 'a' WHEN k <= 2 * floor(n / 2) THEN 'b' END AS side FROM r),
sh AS (SELECT h.source, rep, pos, avg(x) FILTER (side = 'a') AS a, avg(x) FILTER (side = 'b') AS b FROM h JOIN v USING (conversation_id, source) WHERE complete AND side IS NOT NULL GROUP BY ALL),
t AS (SELECT source, rep, avg(abs(a - b)) * 100 AS d FROM sh GROUP BY ALL)
SELECT source, round(median(d), 6) AS noise FROM t GROUP BY source
"""


def _samples(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "interim_record").select("rec_id", "source", "conversation", F.concat(F.lit("You are a user from "), "source").alias("intent"))
    return sft.flip(df, "llama")


def sft_flip(spark: SparkSession, d: str) -> DataFrame:
    """Masked user-model samples (whitespace tokens stand in for a tokenizer): sizes and digest."""
    out = _samples(spark, d)
    text = F.array_join(F.transform("labels", lambda x: x.cast("string")), ",")
    return out.select("rec_id", F.size("input_ids").alias("n"), F.size(F.filter("labels", lambda x: x != sft.IGNORED)).alias("targets"), F.md5(text).alias("digest"))


def _seg(role: str, body: str) -> str:
    return f"'<|start_header_id|>{role}<|end_header_id|>' || chr(10) || chr(10) || {body} || '<|eot_id|>'"


_BODY = f"regexp_replace(t.content, '^{K.WS}+|{K.WS}+$', '', 'g')"
_NEXT = "'<|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10)"
SQL_FLIP = f"""
WITH e AS (SELECT rec_id, source, conversation FROM interim_record WHERE len(conversation) % 2 = 0),
s AS (SELECT rec_id, 0 AS i, '<|begin_of_text|>' || {_seg("system", "'You are a user from ' || source")} || {_NEXT} AS txt, false AS target FROM e
  UNION ALL SELECT rec_id, i + 1, CASE WHEN t.role = 'user' THEN {_BODY} || '<|eot_id|>' ELSE {_seg("assistant", _BODY)} || {_NEXT} END, t.role = 'user'
    FROM (SELECT rec_id, unnest(range(len(conversation))) AS i, unnest(conversation) AS t FROM e)
  UNION ALL SELECT rec_id, 1000000, '<|endconversation|><|eot_id|>', true FROM e),
w AS (SELECT rec_id, i, target, unnest({K.split_words("txt")}) AS w, unnest(range(len({K.split_words("txt")}))) AS j FROM s),
t AS (SELECT rec_id, i, j, target, CASE WHEN target THEN CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 50000 ELSE -100 END AS label FROM w)
SELECT rec_id, CAST(count(*) + 1 AS INT) AS n, CAST(count(*) FILTER (target) AS INT) AS targets, md5(string_agg(CAST(label AS VARCHAR), ',' ORDER BY i, j) || ',-100') AS digest FROM t GROUP BY rec_id
"""


def _token_loss(spark: SparkSession, d: str, longest: int) -> DataFrame:
    df = table(spark, d, "interim_record").select("source", T.words(C.user_text(F.col("conversation"))).alias("w")).where((F.size("w") > 0) & (F.size("w") <= longest))
    loss = F.aggregate("w", F.lit(0), lambda acc, x: acc + F.char_length(x)) / F.lit(10.0)
    out = S.token_loss(df.select("source", loss.alias("loss"), F.size("w").alias("t")), ["source"], "loss", "t")
    return out.select("source", F.round("nll_token_mean", 6).alias("nll_token_mean"), F.round("ppl_token", 6).alias("ppl_token"), "n_conv", "n_tokens")


def token_loss(spark: SparkSession, d: str) -> DataFrame:
    """Token-weighted loss per source over all records within the reference's limit, sft.MAX_TOKENS.

    Word length stands in for a token's loss.
    """
    return _token_loss(spark, d, sft.MAX_TOKENS)


SQL_LOSS = f"""
WITH w AS (SELECT source, {K.split_words(K.user_text())} AS w FROM interim_record),
l AS (SELECT source, list_sum(list_transform(w, lambda x: length(x))) / 10.0 AS loss, len(w) AS t FROM w WHERE len(w) BETWEEN 1 AND 4096)
SELECT source, round(sum(loss) / sum(t), 6) AS nll_token_mean, round(exp(sum(loss) / sum(t)), 6) AS ppl_token, count(*) AS n_conv, CAST(sum(t) AS BIGINT) AS n_tokens FROM l GROUP BY source
"""


def length_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 32 by length, sliced over four workers, the incomplete rest dropped."""
    df = table(spark, d, "interim_record").select("rec_id", "n_words_user")
    return sft.length_buckets(df, "n_words_user", "rec_id", 32, 4).select("rec_id", "batch", "worker")


SQL_BUCKETS = """
WITH r AS (SELECT rec_id, row_number() OVER (ORDER BY n_words_user, rec_id) - 1 AS k, count(*) OVER () AS n FROM interim_record)
SELECT rec_id, k // 32 AS batch, CAST((k // 32) % 4 AS INT) AS worker FROM r WHERE k // 32 < n // 32 // 4 * 4
"""


def token_batches(spark: SparkSession, d: str) -> DataFrame:
    """Length-sorted batches within a padded-token budget; sizes per batch."""
    df = table(spark, d, "interim_record").select("rec_id", "n_words_user")
    out = sft.token_batches(df, "n_words_user", "rec_id", 2000, 32)
    return out.groupBy("part", "batch").agg(F.count("*").alias("n"), F.max("n_words_user").alias("longest"))


#: The greedy cut, row by row in the order of the rule.
SQL_BATCHES = f"""
WITH RECURSIVE r AS (SELECT rec_id, n_words_user AS n, len(bin(n_words_user)) * 1000000 + rec_id // {sft.ID_RANGE} AS part FROM interim_record),
o AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n, rec_id) AS k FROM r),
b(part, k, batch, held, n) AS (SELECT part, k, CAST(0 AS BIGINT), CAST(1 AS BIGINT), n FROM o WHERE k = 1
  UNION ALL SELECT o.part, o.k, CASE WHEN b.held >= 32 OR (b.held + 1) * o.n > 2000 THEN b.batch + 1 ELSE b.batch END,
    CASE WHEN b.held >= 32 OR (b.held + 1) * o.n > 2000 THEN 1 ELSE b.held + 1 END, o.n FROM b JOIN o ON o.part = b.part AND o.k = b.k + 1)
SELECT CAST(part AS BIGINT) AS part, batch, count(*) AS n, max(n) AS longest FROM b GROUP BY part, batch
"""


def sample_packs(spark: SparkSession, d: str) -> DataFrame:
    """Samples within the length limit packed into chunks without splitting one; fill per pack."""
    df = table(spark, d, "interim_record").select("rec_id", F.col("n_words_user").alias("n")).where(F.col("n") <= sft.MAX_TOKENS)
    return sft.packs(df, "n", "rec_id", 4096, emit_tail=True).groupBy("part", "pack").agg(F.count("*").alias("samples"), F.sum("n").alias("tokens"))


SQL_PACKS = f"""
WITH RECURSIVE r AS (SELECT rec_id, n_words_user AS n, rec_id // {sft.ID_RANGE} AS part FROM interim_record WHERE n_words_user <= 4096),
o AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY rec_id) AS k FROM r),
b(part, k, pack, held, n) AS (SELECT part, k, CAST(CASE WHEN n >= 4096 THEN 1 ELSE 0 END AS BIGINT), CAST(n AS BIGINT), n FROM o WHERE k = 1
  UNION ALL SELECT o.part, o.k, CASE WHEN b.held + o.n >= 4096 THEN b.pack + 1 ELSE b.pack END, CASE WHEN b.held + o.n >= 4096 THEN o.n ELSE b.held + o.n END, o.n FROM b JOIN o ON o.part = b.part AND o.k = b.k + 1)
SELECT CAST(part AS BIGINT) AS part, pack, count(*) AS samples, CAST(sum(n) AS BIGINT) AS tokens FROM b GROUP BY part, pack
"""


def padded(spark: SparkSession, d: str) -> DataFrame:
    """Truncated, end-marked, masked and padded token arrays of tasks."""
    ids = sft.truncate_with_eos(sft.word_ids(F.col("problem")), 48, 2)
    df = table(spark, d, "task").select("task_id", ids.alias("ids"))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return df.select("task_id", join(sft.pad(F.col("ids"), 64, 0)).alias("ids"), join(sft.pad(sft.attention_mask(F.col("ids")), 64, 0)).alias("mask"))


SQL_PADDED = f"""
WITH t AS (SELECT task_id, list_transform({K.split_words("problem")}, lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 50000)[1:47] AS i FROM task)
SELECT task_id, array_to_string(list_concat(list_concat(i, [2]), list_transform(range(63 - len(i)), lambda x: 0)), ' ') AS ids,
  array_to_string(list_concat(list_transform(range(len(i) + 1), lambda x: 1), list_transform(range(63 - len(i)), lambda x: 0)), ' ') AS mask FROM t
"""


def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Learning rate by step (100 warm-up, 1000 in all)."""
    rate = sft.lr_schedule(F.col("id"), 2e-5, 100, 1000, 2e-6)
    return spark.range(1100).select(F.col("id").alias("step"), F.round(rate * 1e6, 6).alias("rate"))


SQL_RATE = """
SELECT range AS step, round(1e6 * CASE WHEN range < 100 THEN 2e-5 * (range + 1) / 100 WHEN range < 1000 THEN 2e-6 + 1.8e-5 * 0.5 * (1 + cos(pi() * (range - 100) / 900.0)) ELSE 2e-6 END, 6) AS rate FROM range(1100)
"""


def task_select(spark: SparkSession, d: str) -> DataFrame:
    """50 tasks per dataset, those with an intent first, with their template intent."""
    pool = table(spark, d, "task").select("task_id", "dataset", "problem", "intent")
    first = pool.where(F.col("intent").isNotNull()).select("task_id")
    return K2.select_tasks(pool.drop("intent"), first, 50, "42").select("task_id", "dataset", F.md5(K2.task_intent(F.col("problem"))).alias("intent"))


SQL_TASKS = f"""
SELECT task_id, dataset, md5('{K2.INTENT_TEMPLATE}' || problem) AS intent FROM (SELECT *, row_number() OVER (PARTITION BY dataset
  ORDER BY CASE WHEN intent IS NULL THEN 1 ELSE 0 END, {K.order('42', 'task_id')}, task_id) AS k FROM task) WHERE k <= 50
"""


def reply_faults(spark: SparkSession, d: str) -> DataFrame:
    """Every user turn checked as a reply to the user turns before it; faults per source."""
    turns = C.user_turns(F.col("conversation"))
    checked = T.let(turns, lambda ts: T.let(F.transform(ts, T.norm_text), lambda ns: F.transform(ts, lambda t, i: K2.reply_fault(t, F.slice(ns, 1, i)))))
    df = table(spark, d, "interim_record").select("source", F.explode(checked).alias("fault"))
    return df.groupBy("source", F.coalesce("fault", F.lit("ok")).alias("fault")).agg(F.count("*").alias("n"))


SQL_FAULTS = f"""
WITH u AS (SELECT source, rec_id, unnest({K.USERS}) AS x, unnest(range(len({K.USERS}))) AS i FROM interim_record),
n AS (SELECT *, {K.split_words('x')} AS w, {K.norm('x')} AS t FROM u),
p AS (SELECT *, min(i) OVER (PARTITION BY rec_id, t) < i AS copy FROM n)
SELECT source, CASE WHEN w[1] IN ('I', 'You', 'Here', 'i', 'you', 'here') THEN 'first_token' WHEN len(w) > 25 THEN 'too_long' WHEN len(w) < 3 THEN 'too_short' WHEN copy THEN 'verbatim' ELSE 'ok' END AS fault, count(*) AS n
FROM p GROUP BY ALL
"""


def _graded(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic pseudo-grades: a hash of (rec_id, turn) decides; the group stands in for the task."""
    turns = table(spark, d, "interim_record").select(
        F.col("rec_id").cast("string").alias("conv_id"), F.col("source"), F.col("group_id").alias("task_id"), F.explode(F.sequence(F.lit(1), F.greatest(F.floor(F.col("n_turns") / 2), F.lit(1)).cast("int"))).alias("turn"))
    grades = turns.select("conv_id", "turn", F.lit("ok").alias("status"), (T.hash_unit("grade", F.concat_ws("/", "conv_id", "turn")) < 0.3).alias("correct"))
    return K2.graded_turns(turns, grades)


_GRADED = f"""
g AS (SELECT CAST(rec_id AS VARCHAR) AS conv_id, source, group_id AS task_id, unnest(range(1, CAST(greatest(n_turns // 2, 1) AS BIGINT) + 1)) AS turn FROM interim_record),
c AS (SELECT source, task_id, conv_id, bool_or({K.unit('grade', "conv_id || '/' || turn")} < 0.3) AS hit FROM g GROUP BY ALL),
t AS (SELECT source, task_id, avg(CAST(hit AS INT)) AS success FROM c GROUP BY ALL)
"""


def task_success(spark: SparkSession, d: str) -> DataFrame:
    """Success of each task (any correct turn, mean over conversations)."""
    return K2.task_success(_graded(spark, d), ["source"]).select("source", "task_id", F.round("success", 6).alias("success"))


def success_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean success in percent per source, its deviation and number of tasks."""
    out = K2.intervals(K2.task_success(_graded(spark, d), ["source"]), ["source"], "success")
    return out.select("source", F.round("mean", 6).alias("mean"), F.round("half", 3).alias("half"), "n")


def success_spread(spark: SparkSession, d: str) -> DataFrame:
    """G16 without the quantile: mean, deviation and number of the tasks' success per source."""
    out = K2.task_success(_graded(spark, d), ["source"])
    return out.groupBy("source").agg(F.round(F.avg("success"), 6).alias("mean"), F.round(F.stddev_samp("success"), 6).alias("sd"), F.count("*").alias("n"))


def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    """difference of two pseudo-graders on the same tasks, as mean and deviation."""
    a = K2.task_success(_graded(spark, d), [])
    b = a.select("task_id", (F.lit(1.0) - F.col("success")).alias("success"))
    return K2.paired_delta(a, b, "success").agg(F.round(F.avg("delta"), 6).alias("mean"), F.round(F.stddev_samp("delta"), 6).alias("sd"), F.count("*").alias("n"))


SQL_DELTA = f"""
WITH {_GRADED}, x AS (SELECT task_id, avg(CAST(hit AS INT)) AS s FROM c GROUP BY task_id)
SELECT round(avg(2 * s - 1), 6) AS mean, round(stddev_samp(2 * s - 1), 6) AS sd, count(*) AS n FROM x
"""

CATALOGUE = {
    "annotation_latest": (annotation_latest, SQL_LATEST),
    "annotation_todo": (annotation_todo, SQL_TODO),
    "annotation_status": (annotation_status, SQL_STATUS),
    "annotation_judged": (annotation_judged, SQL_JUDGED),
    "conversation_categories": (conversation_categories, SQL_CATEGORIES),
    "prevalence": (prevalence, SQL_PREVALENCE),
    "category_difference": (category_difference, SQL_DIFFERENCE),
    "match_cells": (match_cells, SQL_CELLS),
    "maximum_match": (maximum_match, SQL_MAXIMUM),
    "noise_floor": (noise_floor, SQL_NOISE),
    "sft_flip": (sft_flip, SQL_FLIP),
    "token_loss": (token_loss, SQL_LOSS),
    "length_buckets": (length_buckets, SQL_BUCKETS),
    "token_batches": (token_batches, SQL_BATCHES),
    "sample_packs": (sample_packs, SQL_PACKS),
    "padded": (padded, SQL_PADDED),
    "lr_schedule": (lr_schedule, SQL_RATE),
    "task_select": (task_select, SQL_TASKS),
    "reply_faults": (reply_faults, SQL_FAULTS),
    "task_success": (task_success, f"WITH {_GRADED} SELECT source, task_id, round(success, 6) AS success FROM t"),
    "success_means": (success_means, None),
    "success_spread": (success_spread, f"WITH {_GRADED} SELECT source, round(avg(success), 6) AS mean, round(stddev_samp(success), 6) AS sd, count(*) AS n FROM t GROUP BY source"),
    "paired_delta": (paired_delta, SQL_DELTA),
}
