"""Readers of the seven conversation sources and of the pipeline's own files. Paths are arguments.

Every loader gives the record schema (:data:`RECORD`): conv_id, group_id, model, timestamp, lang_label, presplit,
conversation, meta (a JSON string). Validation and language filtering come later (``operators.curation``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.functions import text as T
from turnloom.operators import conversation as C
from turnloom.operators import sft
from turnloom.operators.prompts import parse_preference_pair

MESSAGES = "array<struct<role:string,content:string>>"
RECORD = f"conv_id string, group_id string, model string, timestamp string, lang_label string, presplit string, conversation {MESSAGES}, meta string"
# Role names by source.
SHAREGPT_USERS, SHAREGPT_ASSISTANTS = ("human", "user"), ("gpt", "chatgpt", "bing", "bard", "assistant")
MESSAGE_USERS, MESSAGE_ASSISTANTS = ("user", "human"), ("llm", "assistant", "model", "chatbot", "ai")


def _record(df: DataFrame, **cols: Column | str | None) -> DataFrame:
    def of(name: str) -> Column:
        c = cols.get(name)
        return (F.lit(None).cast("string") if c is None else F.col(c) if isinstance(c, str) else c).alias(name)

    text = [of(n).cast("string").alias(n) for n in ("conv_id", "group_id", "model", "timestamp", "lang_label", "presplit")]
    return df.select(*text, of("conversation"), of("meta").cast("string").alias("meta"))


def user_group(ip: Column, country: Column, source: Column, conv_id: Column) -> Column:
    """``ip_country`` where an address is given (no country: ``unknown``), else ``source:conv_id``."""
    named = F.concat_ws("_", ip, F.coalesce(F.nullif(country, F.lit("")), F.lit("unknown")))
    return F.when(F.coalesce(ip, F.lit("")) != "", named).otherwise(F.concat_ws(":", source, conv_id))


def wildchat(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Parquet release with hashed addresses; only ten columns are read."""
    df = spark.read.parquet(path).select(
        "conversation_hash", "hashed_ip", "country", "model", "timestamp", "language", "conversation", "redacted", "toxic", "turn")
    conv = C.normalise_roles(F.col("conversation"), "role", "content", ("user",), ("assistant",))
    return _record(
        df, conv_id="conversation_hash", model="model", timestamp=F.col("timestamp").cast("string"), lang_label="language", conversation=conv,
        group_id=user_group(F.col("hashed_ip"), F.col("country"), F.lit(source), F.col("conversation_hash")),
        meta=F.to_json(F.struct("country", "redacted", "toxic", "turn"), {"ignoreNullFields": "false"}))


def lmsys(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path).select("conversation_id", "model", "conversation", "turn", "language", "redacted")
    conv = C.normalise_roles(F.col("conversation"), "role", "content", ("user",), ("assistant",))
    return _record(df, conv_id="conversation_id", group_id="conversation_id", model="model", lang_label="language", conversation=conv,
                   meta=F.to_json(F.struct("redacted", "turn"), {"ignoreNullFields": "false"}))


def sharegpt(spark: SparkSession, path: str) -> DataFrame:
    """JSON array files with from/value messages."""
    df = spark.read.schema("id string, conversations array<struct<`from`:string,value:string>>").option("multiLine", True).json(path)
    conv = F.coalesce(C.normalise_roles(F.col("conversations"), "from", "value", SHAREGPT_USERS, SHAREGPT_ASSISTANTS), F.array().cast(MESSAGES))
    return _record(df, conv_id="id", group_id="id", conversation=conv, meta=F.to_json(F.struct(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))))


def hh_rlhf(spark: SparkSession, root: str) -> DataFrame:
    """Preference pairs under ``root/<subset>/<split>.jsonl[.gz]``; id = subset/split/line number from 0."""
    df = spark.read.schema("chosen string, rejected string").json(f"{root}/*/*.jsonl*")
    parts = F.split(F.col("_metadata.file_path"), "/")
    split = F.regexp_replace(F.element_at(parts, -1), r"\.jsonl(\.gz)?$", "")
    block = ["subset", "split", "at"]
    df = numbered_lines(df.select("*", F.element_at(parts, -2).alias("subset"), split.alias("split"), "_metadata"))
    cid = F.concat_ws("/", "subset", "split", F.col("line").cast("string"))
    return _record(df, conv_id=cid, group_id=cid, presplit="split", conversation=parse_preference_pair(F.col("chosen"), F.col("rejected")), meta=F.to_json(F.struct("subset")))


def _message_rows(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.col("url"), F.lit("")) != "")


def _order(df: DataFrame, row_id: str) -> Column:
    index = F.coalesce(T.strip(F.col("message_index")).try_cast("bigint"), F.lit(0))
    return F.struct(index.alias("i"), F.col(row_id).alias("r"))


def ambiguous_urls(df: DataFrame) -> DataFrame:
    """(url) of conversations that repeat a raw message index (NULL is an index like any other)."""
    seen = _message_rows(df).groupBy("url", "message_index").agg(F.count("*").alias("c"))
    return seen.groupBy("url").agg(F.max("c").alias("c")).where("c > 1").select("url")


def message_metadata(df: DataFrame, row_id: str) -> DataFrame:
    """(url, lang_label, model, timestamp): English where all user labels are, else the single label, else NULL;
    model of the first assistant row that has one; first time column filled on the first row."""
    role = F.lower("role")
    user, assistant = role.isin(*MESSAGE_USERS), role.isin(*MESSAGE_ASSISTANTS)
    order = _order(df, row_id)
    time = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("created_at", "create_time", "message_create_time", "published_at")])
    model = F.when(assistant & (F.coalesce(F.col("model"), F.lit("")) != ""), F.struct(order.alias("o"), F.col("model").alias("m")))
    label = F.coalesce("detected_language_final", F.lit(""))
    out = _message_rows(df).groupBy("url").agg(
        F.max(F.when(user, ~label.isin(*C.ENGLISH_LABELS))).alias("other"), F.min(F.when(user, label)).alias("a"), F.max(F.when(user, label)).alias("b"),
        F.min(model).alias("model"), F.min(F.struct(order.alias("o"), time.alias("t"))).alias("first"))
    lang = F.when(~F.col("other"), "English").when(F.col("a") == F.col("b"), F.col("a"))
    return out.select("url", lang.alias("lang_label"), F.coalesce("model.m", F.lit("")).alias("model"), F.col("first.t").alias("timestamp"))


def messages_to_conversations(df: DataFrame, row_id: str) -> DataFrame:
    """(conv_id, conversation): rows of one url by integer index (missing or bad: 0), ties in row order."""
    rows = _message_rows(df)
    entry = F.struct(_order(df, row_id).alias("o"), F.lower(F.coalesce("role", F.lit(""))).alias("role"), F.col("plain_text"))
    nested = rows.groupBy("url").agg(F.array_sort(F.collect_list(entry)).alias("m"))
    return nested.select(F.col("url").alias("conv_id"), C.normalise_roles(F.col("m"), "role", "plain_text", MESSAGE_USERS, MESSAGE_ASSISTANTS).alias("conversation"))


def sharechat(spark: SparkSession, path: str, platform: str) -> DataFrame:
    """Turn-level CSV of one platform."""
    rows = spark.read.options(header=True, multiLine=True, escape='"').csv(path).withColumn("__row", F.monotonically_increasing_id())
    meta = message_metadata(rows, "__row")
    labels = _message_rows(rows).where(F.lower("role").isin(*MESSAGE_USERS)).groupBy("url").agg(
        F.sort_array(F.collect_set(F.coalesce("detected_language_final", F.lit("")))).alias("labels"))
    df = messages_to_conversations(rows, "__row").join(meta, F.col("conv_id") == F.col("url")).drop("url").join(labels.withColumnRenamed("url", "conv_id"), "conv_id", "left")
    meta_json = F.to_json(F.struct(F.lit(platform).alias("platform"), F.coalesce("labels", F.array().cast("array<string>")).alias("user_language_labels")))
    return _record(df, conv_id="conv_id", group_id="conv_id", model=F.concat_ws(":", F.lit(platform), "model"), timestamp="timestamp", lang_label="lang_label", conversation="conversation", meta=meta_json)


def arena_message(message: Column, role: str) -> Column:
    """(text, valid): joined text blocks; valid if the role fits, all blocks are text and the text is not blank."""
    blocks = message["content"]
    ok = (message["role"] == role) & (F.size(blocks) > 0) & F.forall(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull() & (F.coalesce(b["image"], F.lit("")) == ""))
    text = F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "")
    return F.struct(F.coalesce(text, F.lit("")).alias("text"), (F.coalesce(ok, F.lit(False)) & ~T.is_blank(text)).alias("valid"))


def arena(spark: SparkSession, path: str) -> DataFrame:
    """Longest history of each evaluation session (NULL length counts as -1); the English, all-text ones stay.

    The winner is chosen on the narrow columns first, its wide row is fetched by a semi join; a winner that is
    not English drops its session.
    """
    df = spark.read.parquet(path)
    rank = F.struct(F.coalesce(F.size("full_conversation"), F.lit(-1)).alias("n"), "evaluation_order", F.col("timestamp").cast("string").alias("t"), "id")
    winners = df.groupBy("evaluation_session_id").agg(F.max(rank).alias("r")).select(F.col("r.id").alias("id"))
    won = df.join(winners, "id", "left_semi").where(F.col("language") == "en")
    turns = F.transform("full_conversation", lambda t: F.struct(arena_message(t["user"], "user").alias("u"), arena_message(t["model_side_a"], "assistant").alias("a"), arena_message(t["model_side_b"], "assistant").alias("b")))
    won = won.withColumn("__t", turns).where((F.size("__t") > 0) & F.forall("__t", lambda t: t["u"]["valid"] & t["a"]["valid"] & t["b"]["valid"]))
    conv = F.flatten(F.transform("__t", lambda t: F.array(
        F.struct(F.lit("user").alias("role"), t["u"]["text"].alias("content")), F.struct(F.lit("assistant").alias("role"), t["a"]["text"].alias("content")))))
    return _record(won, conv_id="id", group_id="evaluation_session_id", timestamp=F.col("timestamp").cast("string"), lang_label=F.lit("en"), conversation=conv,
                   meta=F.to_json(F.struct("evaluation_order", "winner", "model_a", "model_b")))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, a missing path gives an empty table."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.globStatus(hadoop_path) is None or len(fs.globStatus(hadoop_path)) == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def task_pool(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """(task_id, dataset, problem, gold) of a released task file (gsm8k or humaneval columns)."""
    if dataset == "gsm8k":
        df = numbered_lines(spark.read.schema("question string, answer string").json(path))
        gold = F.to_json(F.struct(T.gsm_answer(F.col("answer")).alias("answer"), F.col("answer").alias("solution")))
        return df.select(F.concat(F.lit("gsm8k/"), F.col("line").cast("string")).alias("task_id"), F.lit(dataset).alias("dataset"), T.strip(F.col("question")).alias("problem"), gold.alias("gold"))
    df = spark.read.schema("task_id string, prompt string, test string, entry_point string, canonical_solution string").json(path)
    gold = F.to_json(F.struct("prompt", "test", "entry_point", "canonical_solution"))
    return df.select("task_id", F.lit(dataset).alias("dataset"), F.regexp_replace("prompt", r"\A\n+|\n+\z", "").alias("problem"), gold.alias("gold"))


def numbered_lines(df: DataFrame) -> DataFrame:
    """Add ``line``, the number of each row in its file, from 0: the rows of a file's earlier blocks and of its own before it.

    So plain files may be read in many splits.
    """
    df = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__mono"))
    blocks = df.groupBy("__file", "__at").agg(F.min("__mono").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy("__file").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("__file", "__at", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    joined = df.join(blocks, ["__file", "__at"]).withColumn("line", F.col("__before") + F.col("__mono") - F.col("__first"))
    return joined.drop("__file", "__at", "__mono", "__first", "__before")


# Name prefixes of the prior benchmark's tasks, and those they stand for.
PRIOR_TASKS = {"sharded-GSM8K": "gsm8k", "sharded-HumanEval": "HumanEval"}


def prior_task_ids(df: DataFrame) -> DataFrame:
    """(task_id) of the pools' tasks that a prior benchmark (task_id like ``sharded-GSM8K/12``) has, each once."""
    family = F.substring_index("task_id", "/", 1)
    number = F.substring("task_id", F.length(family) + 2, F.length("task_id"))
    names = F.create_map(*[F.lit(x) for kv in PRIOR_TASKS.items() for x in kv])
    own = df.select(F.try_element_at(names, family).alias("f"), number.alias("n")).where(F.col("f").isNotNull())
    return own.select(F.concat_ws("/", "f", "n").alias("task_id")).distinct()


def samples(spark: SparkSession, path: str, limit: int = sft.MAX_TOKENS) -> DataFrame:
    """Training samples (input_ids, labels, attention_mask) of a JSON-lines file: those within the limit that have a target."""
    rows = spark.read.schema("input_ids array<int>, labels array<int>").json(path)
    kept = sft.within_limit(rows, "input_ids", limit).where(sft.has_target(F.col("labels")))
    return kept.withColumn("attention_mask", sft.attention_mask(F.col("input_ids")))


def english_rows(df: DataFrame, released: bool, identify: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows in English: by the released label, or by a language identifier's first guess on the joined user text."""
    if released:
        return df.where(F.col("lang_label").isin(*C.ENGLISH_LABELS))
    return df.where(identify(C.language_id_input(C.user_text(F.col("conversation"))))["lang"] == "en")


#: Loader registry: source name to reader.
LOADERS: dict[str, Callable[..., DataFrame]] = {
    "wildchat_1m": lambda spark, path: wildchat(spark, path, "wildchat_1m"),
    "wildchat_4p8m": lambda spark, path: wildchat(spark, path, "wildchat_4p8m"),
    "lmsys": lmsys,
    "arena_2025": arena,
    "sharechat": sharechat,
    "sharegpt": sharegpt,
    "hh_rlhf": hh_rlhf,
}
