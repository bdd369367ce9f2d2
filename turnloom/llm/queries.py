"""Queries of the training-data problems: pN_found as TESTDATA.md defines them, and the operators' own results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import copies, encoding, group_splits, language, leaks, match_groups, packing, pii, rebuild, repeated_lines
from turnloom.session import table
from turnloom.staging import Stage


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found_kinds(table(spark, d, "interim_record"), table(spark, d, "name_list"))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Digest of each conversation with its items replaced by placeholders."""
    out = pii.redacted(table(spark, d, "interim_record").select("rec_id", "conversation"), table(spark, d, "name_list"))
    return out.select("rec_id", F.md5(F.to_json("conversation")).alias("digest"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return match_groups.match_groups(table(spark, d, "interim_record"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, d, "interim_record"))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """Digest of each conversation (roles and contents) after the repeated lines are cut."""
    out = repeated_lines.remove_repeated_lines(table(spark, d, "interim_record").select("rec_id", "model", "conversation"))
    turns = F.transform("conversation", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\x01"), F.coalesce(t["content"], F.lit("<none>"))))
    return out.select("rec_id", F.md5(F.coalesce(F.array_join(turns, "\x02"), F.lit(""))).alias("digest"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return group_splits.contradicting_rows(table(spark, d, "interim_record"))


def p4_assign(spark: SparkSession, d: str) -> DataFrame:
    return group_splits.assign_splits(table(spark, d, "interim_record"), table(spark, d, "split_target"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return rebuild.dropped_conversations(table(spark, d, "sharechat_row"))


def p5_turns(spark: SparkSession, d: str) -> DataFrame:
    return rebuild.rebuild_turns(table(spark, d, "sharechat_row"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_pairs(table(spark, d, "interim_record"))


def p6_ledger(spark: SparkSession, d: str) -> DataFrame:
    return copies.fold_copies(table(spark, d, "interim_record"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return language.label_cases(table(spark, d, "interim_record"))


def p7_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every row's languages with their confidence."""
    return language.row_languages(language.row_segments(table(spark, d, "interim_record")))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_all(table(spark, d, "documents"), table(spark, d, "container_spec"))


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of p8_pack, per kind of container: all documents placed, and no fault of any sort."""
    spec = table(spark, d, "container_spec").select(F.col("container").alias("kind"), F.col("capacity_tokens").cast("bigint").alias("capacity"))
    stage = Stage(spark, "packing-check")
    packed = stage.write(p8_pack(spark, d).join(F.broadcast(spec), "kind"), "packed")
    inside = packed.where(F.col("container").isNotNull())
    full = inside.groupBy("kind", "container").agg((F.sum("tokens") > F.max("capacity")).alias("over"), (F.count("*") - F.count_distinct("slot")).alias("twice"))
    per = packed.groupBy("kind", "doc_id").agg(
        F.count("*").alias("parts"), F.count_distinct("part").alias("distinct"), F.sum("tokens").alias("tokens"), F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.max("capacity").alias("capacity"))
    torn = (F.col("parts") != F.col("distinct")) | (F.col("tokens") != F.col("end")) | ((F.col("parts") > 1) & (F.col("tokens") <= F.col("capacity") * (F.col("parts") - 1)))
    docs = per.groupBy("kind").agg(F.count("*").alias("documents"), F.count_if(torn).alias("torn"))
    return docs.join(full.groupBy("kind").agg(F.count_if("over").alias("overfull"), F.sum("twice").alias("slots_twice")), "kind")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_pairs(table(spark, d, "documents"), table(spark, d, "task"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the documents that stay."""
    return leaks.remove_leaked(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "task")).select("doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_documents(table(spark, d, "documents"))


def p10_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the repaired text of each garbled document."""
    out = encoding.repaired_documents(table(spark, d, "documents"))
    return out.select("doc_id", F.md5("text").alias("digest"), "restored")


_ALL = (
    p1_found, p1_redacted, p2_found, p3_found, p3_clean, p4_found, p4_assign, p5_found, p5_turns, p6_found, p6_ledger,
    p7_found, p7_languages, p8_pack, p8_check, p9_found, p9_clean, p10_found, p10_repaired,
)
QUERIES = {f.__name__: f for f in _ALL}
