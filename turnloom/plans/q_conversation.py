"""Queries over conversations: metadata, validation, views, markers, prompts, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators import conversation as C
from turnloom.operators import prompts as P
from turnloom.plans import sqlkit as K
from turnloom.session import table


def _interim(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "interim_record").select("rec_id", *cols)


def conv_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Hashes and sizes recomputed from the conversation."""
    return C.with_metadata(_interim(spark, d, "conversation")).drop("conversation")


SQL_METADATA = f"""
SELECT rec_id, md5({K.norm(K.opener())}) AS first_turn_hash, md5({K.norm(K.user_text())}) AS user_text_hash,
  CAST(len({K.split_words(K.user_text())}) AS INT) AS n_words_user, CAST(len(conversation) AS INT) AS n_turns
FROM interim_record
"""


def conv_validation(spark: SparkSession, d: str) -> DataFrame:
    """Rejection reasons of message rows nested by url in row order (roles mapped, NULL text '')."""
    rows = table(spark, d, "sharechat_row").where(F.coalesce(F.col("url"), F.lit("")) != "")
    nested = rows.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("row_id", F.lower("role").alias("role"), "plain_text"))).alias("m"))
    conv = C.normalise_roles(F.col("m"), "role", "plain_text", ("user", "human"), ("llm", "assistant", "model", "chatbot", "ai"))
    return nested.select("url", F.coalesce(C.rejection_reason(conv), F.lit("valid")).alias("reason"))


SQL_VALIDATION = f"""
WITH t AS (SELECT url, row_number() OVER (PARTITION BY url ORDER BY row_id) - 1 AS i,
    CASE WHEN lower(role) IN ('user', 'human') THEN 'user' WHEN lower(role) IN ('llm', 'assistant', 'model', 'chatbot', 'ai') THEN 'assistant' ELSE 'other' END AS r,
    regexp_replace(coalesce(plain_text, ''), '{K.WS}', '', 'g') = '' AS blank
  FROM sharechat_row WHERE coalesce(url, '') <> ''),
b AS (SELECT url, i, count(*) OVER (PARTITION BY url) AS n, r,
    CASE WHEN r <> CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END THEN 'not_alternating' WHEN blank THEN 'empty_turn' END AS why FROM t)
SELECT url, coalesce(CASE WHEN max(n) < 2 THEN 'too_short' WHEN max(CASE WHEN i = 0 THEN r END) <> 'user' THEN 'not_user_first' END,
  arg_min(why, CASE WHEN why IS NOT NULL THEN i END), 'valid') AS reason FROM b GROUP BY url
"""


def _view(view: str, lowercase: bool = False):
    def run(spark: SparkSession, d: str) -> DataFrame:
        text = C.serialize(F.col("conversation"), view, lowercase)
        return _interim(spark, d, "conversation").select("rec_id", F.md5(text).alias("digest"), F.char_length(text).alias("chars"))

    run.__doc__ = f"E1: view {view}{', lower-cased user text' * lowercase}; digest and length of the rendered text."
    return run


def _view_sql(view: str, lowercase: bool = False) -> str:
    user = "'<user_query>'" if view == "user_masked" else "lower(t.content)" if lowercase else "t.content"
    other = "'<assistant_response>'" if view in ("full_masked", "first_turn") else "t.content"
    conv = "conversation[1:1]" if view == "first_turn" else "conversation"
    text = f"array_to_string(list_transform({conv}, lambda t: CASE WHEN t.role = 'user' THEN 'User: ' || {user} ELSE 'Assistant: ' || {other} END), chr(10))"
    return f"SELECT rec_id, md5({text}) AS digest, CAST(length({text}) AS INT) AS chars FROM interim_record"


def view_meta(spark: SparkSession, d: str) -> DataFrame:
    """Per-row view metadata with the class label of the source and count features."""
    sources = F.array(*[F.lit(s) for s in ("wildchat_1m", "lmsys", "sharegpt")])
    df = _interim(spark, d, "source", "n_turns", "n_words_user", "conversation")
    label = F.array_position(sources, F.col("source")).cast("int") - 1
    n = C.count_features(F.col("conversation"), with_words=True)
    return df.where(label >= 0).select("rec_id", label.alias("label"), "n_turns", n[0].alias("n_user"), n[1].alias("n_assistant"), n[2].alias("n_words"))


SQL_VIEW_META = f"""
SELECT rec_id, CAST(list_position(['wildchat_1m', 'lmsys', 'sharegpt'], source) - 1 AS INT) AS label, n_turns,
  CAST(len({K.USERS}) AS BIGINT) AS n_user, CAST(len(list_filter(conversation, lambda t: t.role = 'assistant')) AS BIGINT) AS n_assistant,
  CAST(len({K.split_words(K.user_text())}) AS BIGINT) AS n_words
FROM interim_record WHERE source IN ('wildchat_1m', 'lmsys', 'sharegpt')
"""


def turn_filter(spark: SparkSession, d: str) -> DataFrame:
    """Single-turn records per source."""
    df = _interim(spark, d, "source", "conversation").where(C.n_user_turns(F.col("conversation")) == 1)
    return df.groupBy("source").agg(F.count("*").alias("n"))


SQL_TURN_FILTER = f"SELECT source, count(*) AS n FROM interim_record WHERE len({K.USERS}) = 1 GROUP BY source"


def marker_find(spark: SparkSession, d: str) -> DataFrame:
    """Markers of user turns, with their counts."""
    found = F.explode(T.find_markers(F.col("t.content")))
    turns = _interim(spark, d, "conversation").select("rec_id", F.posexplode("conversation").alias("turn", "t")).where("t.role = 'user'")
    return turns.select("rec_id", "turn", found.alias("marker")).groupBy("rec_id", "turn", "marker").agg(F.count("*").alias("n"))


SQL_MARKER_FIND = rf"""
WITH t AS (SELECT rec_id, unnest(range(len(conversation))) AS turn, unnest(conversation) AS t FROM interim_record),
m AS (SELECT rec_id, turn, unnest(regexp_extract_all(t.content, '{K.MARK}')) AS marker FROM t WHERE t.role = 'user')
SELECT rec_id, CAST(turn AS INT) AS turn, marker, count(*) AS n FROM m GROUP BY ALL
"""


def marker_delete(spark: SparkSession, d: str) -> DataFrame:
    """Conversation digest and metadata after marker deletion."""
    df = _interim(spark, d, "conversation").withColumn("conversation", C.clean_conversation(F.col("conversation")))
    text = F.array_join(F.transform("conversation", lambda t: t["content"]), "\x01")
    return C.with_metadata(df).select("rec_id", F.md5(text).alias("digest"), "user_text_hash", "n_words_user")


SQL_MARKER_DELETE = f"""
WITH c AS (SELECT rec_id, {K.CLEAN_CONV} AS conversation FROM interim_record)
SELECT rec_id, md5(array_to_string(list_transform(conversation, lambda t: t.content), chr(1))) AS digest,
  md5({K.norm(K.user_text())}) AS user_text_hash, CAST(len({K.split_words(K.user_text())}) AS INT) AS n_words_user FROM c
"""


def marker_has(spark: SparkSession, d: str) -> DataFrame:
    """Records with a marker in a user turn, per source."""
    df = _interim(spark, d, "source", "conversation").where(C.has_marker(F.col("conversation")))
    return df.groupBy("source").agg(F.count("*").alias("n"))


SQL_MARKER_HAS = f"SELECT source, count(*) AS n FROM interim_record WHERE regexp_matches({K.user_text()}, '{K.MARK}') GROUP BY source"


def prev_user_repeat(spark: SparkSession, d: str) -> DataFrame:
    """H5: user turns equal (normalised) to the user turn before them in one conversation."""
    def pairs_of(turns):
        rest = F.slice(turns, 2, F.greatest(F.size(turns) - 1, F.lit(0)))
        return F.transform(rest, lambda t, i: F.struct((i + 1).alias("user_turn"), (t == F.get(turns, i)).alias("same")))

    pairs = T.let(F.transform(C.user_turns(F.col("conversation")), T.norm_text), pairs_of)
    return _interim(spark, d, "conversation").select("rec_id", F.explode(pairs).alias("p")).select("rec_id", "p.user_turn", "p.same")


SQL_PREV = f"""
WITH u AS (SELECT rec_id, unnest({K.USERS}) AS x, unnest(range(len({K.USERS}))) AS i FROM interim_record),
l AS (SELECT rec_id, i, {K.norm('x')} AS x, lag({K.norm('x')}) OVER (PARTITION BY rec_id ORDER BY i) AS p FROM u)
SELECT rec_id, CAST(i AS INT) AS user_turn, x = p AS same FROM l WHERE i > 0
"""


def text_norm(spark: SparkSession, d: str) -> DataFrame:
    """Normalised digest, words and 7-gram count of each document."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(T.norm_text(t)).alias("digest"), T.word_count(t).alias("words"), F.size(T.word_ngrams(t, 7)).alias("grams"))


SQL_TEXT_NORM = f"""
SELECT doc_id, md5({K.norm("coalesce(text, '')")}) AS digest, CAST(len({K.split_words("coalesce(text, '')")}) AS INT) AS words,
  CAST(greatest(len({K.split_words("coalesce(text, '')")}) - 6, 0) AS INT) AS grams FROM documents
"""


def strip_thinking(spark: SparkSession, d: str) -> DataFrame:
    """E5 on deterministic traces wrapped around task problems (stand-in for model replies)."""
    kinds = ((0, "<think>a</think> {}"), (1, "<think>{}"), (2, "{}"), (3, "<think>a</think>b</think>\n{} "))
    df = table(spark, d, "task").select("task_id", "problem")
    text = F.concat(*[F.lit("")])
    bucket = F.pmod(F.char_length("problem"), F.lit(4))
    for k, form in kinds:
        a, b = form.split("{}")
        text = F.when(bucket == k, F.concat(F.lit(a), "problem", F.lit(b))).otherwise(text)
    return df.select("task_id", T.strip_thinking(text).alias("reply"))


SQL_THINK = f"""
WITH t AS (SELECT task_id, problem, length(problem) % 4 AS k FROM task)
SELECT task_id, CASE k WHEN 1 THEN '' ELSE regexp_replace(problem, '^{K.WS}+|{K.WS}+$', '', 'g') END AS reply FROM t
"""


def answer_extract(spark: SparkSession, d: str) -> DataFrame:
    """Final number of worked answers built from the tasks' gold values."""
    df = table(spark, d, "task").where("dataset = 'gsm8k'")
    return df.select("task_id", T.gsm_answer(F.concat(F.lit("so 1,000 #### 2\n#### 1,"), "gold", F.lit("  "))).alias("answer"))


SQL_ANSWER = "SELECT task_id, '1' || regexp_replace(gold, ',', '', 'g') AS answer FROM task WHERE dataset = 'gsm8k'"


def _transcript(conv):
    return F.array_join(F.transform(conv, lambda t: F.concat(F.when(t["role"] == "user", F.lit("\n\nHuman: ")).otherwise(F.lit("\n\nAssistant: ")), t["content"])), "")


def transcript_parse(spark: SparkSession, d: str) -> DataFrame:
    """hh_rlhf conversations rendered as transcripts and parsed back; messages and digest."""
    df = _interim(spark, d, "source", "conversation").where("source = 'hh_rlhf'").withColumn("conv", P.parse_transcript(_transcript("conversation")))
    return df.select("rec_id", F.size("conv").alias("n"), F.md5(F.array_join(F.transform("conv", lambda t: F.concat(t["role"], F.lit("\x01"), t["content"])), "\x02")).alias("digest"))


SQL_TRANSCRIPT = f"""
SELECT rec_id, CAST(len(conversation) AS INT) AS n, md5(array_to_string(list_transform(conversation,
  lambda t: t.role || chr(1) || regexp_replace(t.content, '^{K.WS}+|{K.WS}+$', '', 'g')), chr(2))) AS digest
FROM interim_record WHERE source = 'hh_rlhf'
"""


def preference_pair(spark: SparkSession, d: str) -> DataFrame:
    """chosen/rejected pairs made from hh_rlhf rows; the completion holds a literal 'Human:' and stays one turn."""
    df = _interim(spark, d, "source", "conversation").where("source = 'hh_rlhf'").where(F.size("conversation") % 2 == 0)
    history = _transcript(F.slice("conversation", 1, F.size("conversation") - 1))
    chosen = F.concat(history, F.lit("\n\nAssistant: good\n\nHuman: not a turn"))
    rejected = F.concat(history, F.lit("\n\nAssistant: bad"))
    conv = P.parse_preference_pair(chosen, rejected)
    return df.select("rec_id", F.size(conv).alias("n"), F.element_at(conv, -1)["content"].alias("last"))


SQL_PAIR = """
SELECT rec_id, CAST(len(conversation) AS INT) AS n, 'good' || chr(10) || chr(10) || 'Human: not a turn' AS last
FROM interim_record WHERE source = 'hh_rlhf' AND len(conversation) % 2 = 0
"""


def prompt_renderings(spark: SparkSession, d: str) -> DataFrame:
    """Intent-prompt history and both chat-template renderings, as digests."""
    conv = F.col("conversation")
    return _interim(spark, d, "conversation").select(
        "rec_id", F.md5(P.intent_history(conv)).alias("intent"),
        F.md5(P.render_chat(conv, "llama")).alias("llama"), F.md5(P.render_chat(conv, "qwen")).alias("qwen"))


SQL_PROMPTS = f"""
SELECT rec_id, md5(array_to_string(list_transform(conversation, lambda t: '<' || t.role || '>: ' || t.content), chr(10))) AS intent,
  md5('<|begin_of_text|>' || array_to_string(list_transform(conversation, lambda t: '<|start_header_id|>' || t.role || '<|end_header_id|>' || chr(10) || chr(10)
    || regexp_replace(t.content, '^{K.WS}+|{K.WS}+$', '', 'g') || '<|eot_id|>'), '')
    || '<|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10)) AS llama,
  md5('<|im_start|>system' || chr(10) || 'You are Qwen, created by Alibaba Cloud. You are a helpful assistant.<|im_end|>' || chr(10)
    || array_to_string(list_transform(conversation, lambda t: '<|im_start|>' || t.role || chr(10) || t.content || '<|im_end|>' || chr(10)), '')
    || '<|im_start|>user' || chr(10)) AS qwen
FROM interim_record
"""


def code_blocks(spark: SparkSession, d: str) -> DataFrame:
    """E7 (relational part): fenced python blocks of assistant turns."""
    turns = _interim(spark, d, "conversation").select("rec_id", F.posexplode("conversation").alias("turn", "t")).where("t.role = 'assistant'")
    return turns.select("rec_id", "turn", F.explode(P.fenced_blocks(F.col("t.content"))).alias("code")).groupBy("rec_id", "turn").agg(
        F.count("*").alias("blocks"), F.sum(F.char_length("code")).alias("chars"))


SQL_CODE = r"""
WITH t AS (SELECT rec_id, unnest(range(len(conversation))) AS turn, unnest(conversation) AS t FROM interim_record),
b AS (SELECT rec_id, turn, unnest(regexp_extract_all(t.content, '(?s)```(?:python|py)?[ \t]*\n(.*?)```', 1)) AS code FROM t WHERE t.role = 'assistant')
SELECT rec_id, CAST(turn AS INT) AS turn, count(*) AS blocks, CAST(sum(length(code)) AS BIGINT) AS chars FROM b GROUP BY ALL
"""

CATALOGUE = {
    "conv_metadata": (conv_metadata, SQL_METADATA),
    "conv_validation": (conv_validation, SQL_VALIDATION),
    **{f"view_{v}": (_view(v), _view_sql(v)) for v in ("full_masked", "full_unmasked", "first_turn", "user_masked")},
    "view_lowercase": (_view("full_unmasked", True), _view_sql("full_unmasked", True)),
    "view_meta": (view_meta, SQL_VIEW_META),
    "turn_filter": (turn_filter, SQL_TURN_FILTER),
    "marker_find": (marker_find, SQL_MARKER_FIND),
    "marker_delete": (marker_delete, SQL_MARKER_DELETE),
    "marker_has": (marker_has, SQL_MARKER_HAS),
    "prev_user_repeat": (prev_user_repeat, SQL_PREV),
    "text_norm": (text_norm, SQL_TEXT_NORM),
    "strip_thinking": (strip_thinking, SQL_THINK),
    "answer_extract": (answer_extract, SQL_ANSWER),
    "transcript_parse": (transcript_parse, SQL_TRANSCRIPT),
    "preference_pair": (preference_pair, SQL_PAIR),
    "prompt_renderings": (prompt_renderings, SQL_PROMPTS),
    "code_blocks": (code_blocks, SQL_CODE),
}
