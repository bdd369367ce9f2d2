"""Problem 5: rebuild conversations from message rows.

Message rows are an event log. Events of one message (``url``, index) are folded by version: retries (rows
equal but for their row id) collapse, edits replace, deletes remove. Two creates of one message that differ and
carry no version are a conflict. Validation is a set of mergeable aggregates per conversation (extrema,
counts, role-by-parity flags), so a conversation with a third of all rows is never held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.skew import hot_threshold, join_counted
from turnloom.staging import Stage

# Role names, compared without case.
USER_ROLES = ("user", "human")
ASSISTANT_ROLES = ("llm", "assistant", "model", "chatbot", "ai")
#: Turns per nested part of a rebuilt conversation; a longer conversation comes in several parts.
PART_TURNS = 4096


def message_index(col: Column) -> Column:
    """The index as an integer: surrounding white space and leading zeros do not matter; else NULL.

    Integers of more than 38 digits count as no index.
    """
    digits = F.regexp_extract(T.strip(col), r"^([+-]?)0*([0-9]{1,38})$", 0)
    return F.when(digits != "", digits).try_cast("decimal(38,0)")


def role_class(col: Column) -> Column:
    low = F.lower(col)
    return F.when(low.isin(*USER_ROLES), F.lit("user")).when(low.isin(*ASSISTANT_ROLES), F.lit("assistant"))


def events_of(df: DataFrame, op: str | None = None, version: str | None = None) -> DataFrame:
    """Message rows as log events: (url, idx, role, content, op, version, body).

    ``body`` is a 128-bit digest of all columns except ``row_id``: equal bodies are retries of one message.
    ``op`` and ``version`` name columns with the kind of event (create, edit, delete) and an integer version;
    without them every row is a create without a version. Unreadable versions count as none.
    """
    rest = sorted(c for c in df.columns if c != "row_id")
    body = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest]), {"ignoreNullFields": "false"}))
    return df.where(F.col("url").isNotNull() & (F.col("url") != "")).select(
        "url",
        message_index(F.col("message_index")).alias("idx"),
        role_class(F.col("role")).alias("role"),
        F.col("plain_text").alias("content"),
        (F.coalesce(F.lower(F.col(op)), F.lit("create")) if op else F.lit("create")).alias("op"),
        (F.col(version).try_cast("bigint") if version else F.lit(None).cast("bigint")).alias("version"),
        F.unhex(body).alias("body"),
    )


def fold_events(events: DataFrame, payload: list[str]) -> DataFrame:
    """One row per surviving (url, idx, body): retries collapse, the newest version wins, deletes remove.

    Rows without an index keep one row each per body. Messages without versions that differ under one index
    all survive: that conflict is the validation's to see. The fold is a plain aggregate (max of a struct), so
    copies are combined map-side.
    """
    slot = F.when(F.col("version").isNull() | F.col("idx").isNull(), F.col("body"))
    order = F.struct(F.coalesce("version", F.lit(-1)).alias("version"), "op", "body", *payload)
    newest = events.groupBy("url", "idx", slot.alias("slot")).agg(F.max(order).alias("e"))
    return newest.where(F.col("e.op") != "delete").select("url", "idx", F.col("e.body").alias("body"), *[F.col(f"e.{p}").alias(p) for p in payload])


def verdicts(events: DataFrame) -> DataFrame:
    """(url, low, n, reason) per conversation; ``reason`` is NULL for a usable one.

    Reasons in order: bad_index, conflict, gap, too_short, bad_role, not_alternating, blank_text, unanswered.
    """
    lean = events.select("url", "idx", "role", "op", "version", "body", T.is_blank(F.col("content")).alias("blank"))
    turns = fold_events(lean, ["role", "blank"])
    even = F.pmod(F.col("idx"), F.lit(2)) == 0
    parity = [(r, p) for r in ("user", "assistant") for p in ("even", "odd")]
    per_index = turns.groupBy("url", "idx").agg(
        F.count("*").alias("n"),
        F.max(F.col("role").isNull()).alias("bad_role"),
        F.max("blank").alias("blank"),
        *[F.max((F.col("role") == r) & (even if p == "even" else ~even)).alias(f"{r}_{p}") for r, p in parity],
    )
    seen = per_index.groupBy("url").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("idx").isNull(), F.col("n")).otherwise(0)).alias("no_index"),
        F.max(F.col("idx").isNotNull() & (F.col("n") > 1)).alias("clash"),
        F.min("idx").alias("low"),
        F.max("idx").alias("high"),
        *[F.max(c).alias(c) for c in ("bad_role", "blank")],
        *[F.max(f"{r}_{p}").alias(f"{r}_{p}") for r, p in parity],
    )
    low_even = F.pmod(F.col("low"), F.lit(2)) == 0
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    wrong = F.when(low_even, flag("user_odd") | flag("assistant_even")).otherwise(flag("user_even") | flag("assistant_odd"))
    reason = (
        F.when(F.col("no_index") > 0, "bad_index")
        .when(flag("clash"), "conflict")
        .when(F.col("high") - F.col("low") + 1 != F.col("n"), "gap")
        .when(F.col("n") < 2, "too_short")
        .when(F.col("bad_role"), "bad_role")
        .when(wrong, "not_alternating")
        .when(F.col("blank"), "blank_text")
        .when(F.col("n") % 2 == 1, "unanswered")
    )
    return seen.select("url", "low", "n", reason.alias("reason"))


def dropped_conversations(df: DataFrame, op: str | None = None, version: str | None = None) -> DataFrame:
    """(url) of the non-empty urls whose conversation is unusable. Empty input gives an empty result."""
    return verdicts(events_of(df, op, version)).where(F.col("reason").isNotNull()).select("url")


def rebuild_turns(df: DataFrame, op: str | None = None, version: str | None = None) -> DataFrame:
    """(url, turn, role, content) of the usable conversations, in message form: turn = index - lowest index.

    A conversation with a third of all messages is salted in the join with its verdict.
    """
    events = events_of(df, op, version)
    stage = Stage(df.sparkSession, "rebuild")
    judged = stage.write(verdicts(events), "verdicts")
    good = judged.where(F.col("reason").isNull()).select("url", "low", "n")
    turns = fold_events(events, ["role", "content"])
    return join_counted(turns, good, ["url"], "n", F.col("idx"), hot_threshold(judged, "n")).select("url", (F.col("idx") - F.col("low")).cast("bigint").alias("turn"), "role", "content")


def rebuild_conversations(df: DataFrame, op: str | None = None, version: str | None = None) -> DataFrame:
    """(url, part, conversation ARRAY<STRUCT<role, content>>) of the usable conversations, in order.

    A conversation longer than PART_TURNS comes in several parts, so no task gathers an unbounded group.
    """
    part = F.floor(F.col("turn") / PART_TURNS).cast("int").alias("part")
    nested = rebuild_turns(df, op, version).groupBy("url", part).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("m"))
    return nested.select("url", "part", F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("conversation"))
