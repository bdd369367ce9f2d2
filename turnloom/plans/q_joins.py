"""Queries of the total joins and guards (F2, F5-F9, F15, H7, I6-I8, J1, J2, J4, J7) and of the class table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators import conversation as C
from turnloom.operators import joins as J
from turnloom.operators import prompts as P
from turnloom.plans import sqlkit as K
from turnloom.session import table

SAMPLES = 5
CLASSES = ["lmsys", "wildchat_1m", "sharechat"]


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    """One row per conv_id, the one with the smallest rec_id."""
    first = table(spark, d, "interim_record").groupBy("conv_id").agg(F.min("rec_id").alias("rec_id"), F.min_by("source", "rec_id").alias("source"))
    return first.where(F.col("conv_id").isNotNull())


def _intents(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in intent log: one attempt per logged unit of the annotation log."""
    log = table(spark, d, "unit").where(F.col("conversation_id").isNotNull())
    return log.select(F.col("conversation_id").alias("conv_id"), F.concat_ws(":", F.col("turn").cast("string"), F.array_join(F.coalesce("labels", F.array().cast("array<string>")), "+")).alias("intent"), "seq")


_CORPUS = "c AS (SELECT conv_id, min(rec_id) AS rec_id, arg_min(source, rec_id) AS source FROM interim_record WHERE conv_id IS NOT NULL GROUP BY conv_id)"
_INTENTS = """l AS (SELECT conversation_id AS conv_id, coalesce(CAST(turn AS VARCHAR) || ':', '') || array_to_string(coalesce(labels, []), '+') AS intent, seq FROM unit WHERE conversation_id IS NOT NULL),
i AS (SELECT conv_id, arg_max(intent, seq) AS intent FROM l GROUP BY conv_id)"""


def last_intents(spark: SparkSession, d: str) -> DataFrame:
    """Corpus records with the intent logged last for them, in corpus order (rec_id)."""
    return J.with_last_intent(_corpus(spark, d), _intents(spark, d)).select("rec_id", "conv_id", "intent")


SQL_INTENTS = f"WITH {_CORPUS}, {_INTENTS} SELECT rec_id, conv_id, intent FROM c JOIN i USING (conv_id)"


def total_annotations(spark: SparkSession, d: str) -> DataFrame:
    """annotated conversations joined to their corpus row; one without it would be an error."""
    notes = table(spark, d, "unit").where("status = 'accepted'").groupBy("conversation_id").agg(F.count("*").alias("units"))
    known = _corpus(spark, d).select(F.col("conv_id").alias("conversation_id"), "source")
    return J.total_join(notes, known, "conversation_id", "corpus record").select("conversation_id", "source", "units")


SQL_TOTAL = f"WITH {_CORPUS} SELECT conversation_id, source, count(*) AS units FROM unit JOIN c ON c.conv_id = conversation_id WHERE status = 'accepted' GROUP BY ALL"


def corpus_positions(spark: SparkSession, d: str) -> DataFrame:
    """F8: units joined to the position (here rec_id) of their conversation in the corpus."""
    units = table(spark, d, "unit").select(F.col("conversation_id").alias("conv_id"), "seq")
    return units.join(_corpus(spark, d).select("conv_id", "rec_id"), "conv_id").select("seq", "rec_id")


SQL_POSITIONS = f"WITH {_CORPUS} SELECT seq, rec_id FROM unit JOIN c ON c.conv_id = conversation_id"


def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    """sharechat conversations whose id is no url of the message rows (here all of them, the tables are not of one release)."""
    wanted = table(spark, d, "interim_record").where("source = 'sharechat'").select(F.col("conv_id").alias("url"))
    return J.missing_ids(wanted, table(spark, d, "sharechat_row"), "url")


SQL_MISSING = "SELECT DISTINCT conv_id AS url FROM interim_record WHERE source = 'sharechat' AND NOT EXISTS (SELECT 1 FROM sharechat_row s WHERE s.url = conv_id)"


def task_samples(spark: SparkSession, d: str) -> DataFrame:
    """every task with its five conversations to simulate."""
    return J.tasks_by_samples(table(spark, d, "task").select("task_id", "dataset"), SAMPLES).select("task_id", "dataset", "sample_index", "conv_id")


SQL_SAMPLES = f"SELECT task_id, dataset, CAST(range AS INT) AS sample_index, task_id || '#' || range AS conv_id FROM task, range({SAMPLES})"


def class_table(spark: SparkSession, d: str) -> DataFrame:
    """Rows of three sources with the position of their source as label."""
    return J.labelled_classes(table(spark, d, "interim_record").select("rec_id", "source"), CLASSES).select("rec_id", "label")


SQL_CLASSES = "SELECT rec_id, CAST(list_position(['lmsys', 'wildchat_1m', 'sharechat'], source) - 1 AS INT) AS label FROM interim_record WHERE source IN ('lmsys', 'wildchat_1m', 'sharechat')"


def _seeded(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in synthetic sets: one row per user group, source and split; the group is the seed."""
    df = table(spark, d, "interim_record").where(F.col("source").isin("wildchat_1m", "wildchat_4p8m"))
    split = F.when(T.hash_unit("split", F.col("conv_id")) < 0.8, "train").otherwise("val")
    return df.select("source", split.alias("split"), F.col("group_id").alias("seed_conv_id"))


def unpaired_intents(spark: SparkSession, d: str) -> DataFrame:
    """I8: seeds that one of two classes lacks in a split, and seeds in both splits."""
    return J.unpaired_intents(_seeded(spark, d), ["wildchat_1m", "wildchat_4p8m"])


SQL_UNPAIRED = f"""
WITH r AS (SELECT source, CASE WHEN {K.unit('split', 'conv_id')} < 0.8 THEN 'train' ELSE 'val' END AS split, group_id AS seed FROM interim_record WHERE source IN ('wildchat_1m', 'wildchat_4p8m')),
p AS (SELECT seed, split, count(DISTINCT source) AS k FROM r GROUP BY ALL)
SELECT seed, problem FROM (SELECT seed, 'lacking' AS problem FROM p WHERE k < 2 UNION ALL SELECT seed, 'crossing' FROM p GROUP BY seed HAVING count(*) > 1)
WHERE NOT EXISTS (SELECT 1 FROM r WHERE seed IS NULL)
"""


def presplit_violations(spark: SparkSession, d: str) -> DataFrame:
    """Unknown sources and released splits that are neither train nor test."""
    return J.presplit_violations(table(spark, d, "interim_record").select("rec_id", "source", "presplit"))


SQL_PRESPLIT = """
SELECT rec_id, CASE WHEN NOT known THEN 'source' ELSE 'presplit' END AS rule FROM (SELECT rec_id, source, presplit,
  coalesce(source IN ('wildchat_1m', 'wildchat_4p8m', 'lmsys', 'arena_2025', 'sharechat', 'sharegpt', 'hh_rlhf'), false) AS known FROM interim_record)
WHERE NOT known OR (source = 'hh_rlhf' AND NOT coalesce(presplit IN ('train', 'test'), false))
"""


def different_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that only one of two sample sets has (records of even turn count against those without markers)."""
    df = table(spark, d, "interim_record").select("rec_id", "conversation")
    return J.different_ids(df.where(F.size("conversation") % 2 == 0), df.where(~C.has_marker(F.col("conversation"))), "rec_id")


SQL_DIFFERENT = f"""
WITH a AS (SELECT rec_id FROM interim_record WHERE len(conversation) % 2 = 0),
b AS (SELECT rec_id FROM interim_record WHERE NOT coalesce(list_bool_or(list_transform(conversation, lambda t: t.role = 'user' AND regexp_matches(coalesce(t.content, ''), '{K.MARK}'))), false))
SELECT rec_id, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT rec_id, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
"""


def prefix_stability(spark: SparkSession, d: str) -> DataFrame:
    """Renderings of all turns but the last that are no prefix of the whole rendering, per template: none."""
    df = table(spark, d, "interim_record").select("rec_id", "conversation").where(F.size("conversation") > 1)
    head = F.slice("conversation", 1, F.size("conversation") - 1)
    out = None
    for family in P.CHAT:
        bad = J.unstable_prefixes(df, P.render_chat(head, family, next_user=False), P.render_chat(F.col("conversation"), family, next_user=False), "rec_id")
        one = bad.agg(F.count("*").alias("n")).select(F.lit(family).alias("family"), "n")
        out = one if out is None else out.union(one)
    return out


SQL_PREFIX = "SELECT unnest(['llama', 'qwen']) AS family, CAST(0 AS BIGINT) AS n"


def pool_shortages(spark: SparkSession, d: str) -> DataFrame:
    """H7: sources and presplits with fewer records than wanted (40, 3 and 7 records a source)."""
    split = F.lower(F.trim("presplit"))
    pools = table(spark, d, "interim_record").groupBy("source", split.alias("split")).agg(F.count("*").alias("pool"))
    return J.shortages(pools, {"train": 40, "val": 3, "test": 7})


SQL_SHORT = """
WITH p AS (SELECT source, lower(trim(presplit)) AS split, count(*) AS pool FROM interim_record GROUP BY ALL),
w AS (SELECT s.source, v.split, v.wanted FROM (SELECT DISTINCT source FROM interim_record WHERE source <> 'sharegpt') s, (VALUES ('train', CAST(40 AS BIGINT)), ('val', 3), ('test', 7)) v(split, wanted))
SELECT w.source, w.split, coalesce(pool, 0) AS pool, wanted FROM w LEFT JOIN p ON p.source = w.source AND p.split = w.split WHERE coalesce(pool, 0) < wanted
"""


def exact_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sources and presplits that do not hold exactly 40, 3 and 7 records."""
    df = table(spark, d, "interim_record").select("source", F.lower(F.trim("presplit")).alias("split"))
    return J.count_violations(df, {"train": 40, "val": 3, "test": 7})


SQL_COUNTS = SQL_SHORT.replace("AS pool FROM interim_record", "AS n FROM interim_record").replace("coalesce(pool, 0) AS pool, wanted", "coalesce(n, 0) AS n, wanted").replace("coalesce(pool, 0) < wanted", "coalesce(n, 0) <> wanted")

CATALOGUE = {
    "last_intents": (last_intents, SQL_INTENTS),
    "total_annotations": (total_annotations, SQL_TOTAL),
    "corpus_positions": (corpus_positions, SQL_POSITIONS),
    "missing_ids": (missing_ids, SQL_MISSING),
    "task_samples": (task_samples, SQL_SAMPLES),
    "class_table": (class_table, SQL_CLASSES),
    "unpaired_intents": (unpaired_intents, SQL_UNPAIRED),
    "presplit_violations": (presplit_violations, SQL_PRESPLIT),
    "different_ids": (different_ids, SQL_DIFFERENT),
    "prefix_stability": (prefix_stability, SQL_PREFIX),
    "pool_shortages": (pool_shortages, SQL_SHORT),
    "exact_counts": (exact_counts, SQL_COUNTS),
}
