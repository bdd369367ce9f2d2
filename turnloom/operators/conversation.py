"""Conversation expressions: validation, metadata, views (inputs are ARRAY<STRUCT<role, content>> columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as T

# Placeholders of the masked views, and labels that count as English.
ASSISTANT_MASK = "<assistant_response>"
USER_MASK = "<user_query>"
ENGLISH_LABELS = ("English", "english", "en", "EN", "eng")


def user_turns(conv: Column) -> Column:
    return F.transform(F.filter(conv, lambda t: t["role"] == "user"), lambda t: F.coalesce(t["content"], F.lit("")))


def first_user_turn(conv: Column) -> Column:
    """Text of the first user message; '' when there is none."""
    return F.coalesce(F.get(user_turns(conv), F.lit(0)), F.lit(""))


def user_text(conv: Column) -> Column:
    return F.array_join(user_turns(conv), "\n")


def n_user_turns(conv: Column) -> Column:
    return F.size(F.filter(F.coalesce(conv, F.array().cast("array<struct<role:string,content:string>>")), lambda t: t["role"] == "user"))


def with_metadata(df: DataFrame, conv: str = "conversation") -> DataFrame:
    """Add first_turn_hash, user_text_hash, n_words_user, n_turns (messages) computed from ``conv``."""
    c = F.col(conv)
    return df.withColumns(
        {
            "first_turn_hash": T.md5_text(T.norm_text(first_user_turn(c))),
            "user_text_hash": T.md5_text(T.norm_text(user_text(c))),
            "n_words_user": T.word_count(user_text(c)),
            "n_turns": F.greatest(F.size(F.coalesce(c, F.array().cast("array<struct<role:string,content:string>>"))), F.lit(0)),
        }
    )


def rejection_reason(conv: Column) -> Column:
    """NULL for a valid conversation, else the first failing reason.

    too_short (NULL or < 2 messages), not_user_first, then at the first bad position not_alternating before
    empty_turn (NULL or blank content). An odd length is valid.
    """
    per_turn = F.transform(
        conv,
        lambda t, i: F.when(
            ~t["role"].eqNullSafe(F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))), F.lit("not_alternating")
        ).when(T.is_blank(t["content"]), F.lit("empty_turn")),
    )
    first_bad = F.get(F.filter(per_turn, lambda r: r.isNotNull()), F.lit(0))
    return (
        F.when(conv.isNull() | (F.size(conv) < 2), F.lit("too_short"))
        .when(~F.get(conv, F.lit(0))["role"].eqNullSafe(F.lit("user")), F.lit("not_user_first"))
        .otherwise(first_bad)
    )


def normalise_roles(conv: Column, role: str, content: str, users: tuple[str, ...], assistants: tuple[str, ...]) -> Column:
    """Map role names to user/assistant, others to ``unknown:<role>``; NULL content becomes ''."""
    return F.transform(
        conv,
        lambda t: F.struct(
            F.when(t[role].isin(*users), F.lit("user"))
            .when(t[role].isin(*assistants), F.lit("assistant"))
            .otherwise(F.concat(F.lit("unknown:"), F.coalesce(t[role], F.lit("None"))))
            .alias("role"),
            F.coalesce(t[content], F.lit("")).alias("content"),
        ),
    )


def serialize(conv: Column, view: str = "full_masked", lowercase: bool = False) -> Column:
    """Render a conversation as ``User: ..`` / ``Assistant: ..`` lines.

    full_masked hides assistant text, user_masked hides user text, full_unmasked shows all, first_turn renders
    only the first message. ``lowercase`` applies to user text, except in user_masked.
    """
    turns = F.slice(conv, 1, 1) if view == "first_turn" else conv

    def line(t: Column) -> Column:
        user = F.lower(t["content"]) if lowercase else t["content"]
        if view == "user_masked":
            user = F.lit(USER_MASK)
        other = F.lit(ASSISTANT_MASK) if view in ("full_masked", "first_turn") else t["content"]
        return F.when(t["role"] == "user", F.concat(F.lit("User: "), user)).otherwise(F.concat(F.lit("Assistant: "), other))

    return F.array_join(F.transform(turns, line), "\n")


def clean_conversation(conv: Column) -> Column:
    """Delete redaction markers from user turns; assistant turns stay as they are."""
    return F.transform(
        conv,
        lambda t: F.struct(
            t["role"].alias("role"), F.when(t["role"] == "user", T.delete_markers(t["content"])).otherwise(t["content"]).alias("content")
        ),
    )


def has_marker(conv: Column) -> Column:
    return F.coalesce(F.exists(conv, lambda t: (t["role"] == "user") & T.has_marker(t["content"])), F.lit(False))


def pad_unanswered(conv: Column) -> Column:
    """Append an empty assistant turn to a conversation of odd length."""
    empty = F.array(F.struct(F.lit("assistant").alias("role"), F.lit("").alias("content")))
    return F.when(F.size(conv) % 2 == 1, F.concat(conv, empty)).otherwise(conv)


def count_features(conv: Column, with_words: bool = False) -> Column:
    """[n_user, n_assistant(, n_words_user)] as BIGINTs."""
    n_asst = F.size(F.filter(conv, lambda t: t["role"] == "assistant"))
    parts = [n_user_turns(conv), n_asst] + ([T.word_count(user_text(conv))] if with_words else [])
    return F.array(*[p.cast("bigint") for p in parts])


def language_id_input(text: Column, max_chars: int = 3000) -> Column:
    """Text handed to a language identifier: newlines to blanks, stripped, first ``max_chars`` characters."""
    return F.substring(T.strip(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))), 1, max_chars)


def view_rows(corpus: DataFrame, sources: list[str], view: str = "full_masked", lowercase: bool = False) -> DataFrame:
    """(text, label, source, conv_id, n_turns, n_user_turns, n_words_user, seed_conv_id, intent_source) of a classifier's rows.

    ``label`` is the position of the source in the list. Seed and intent source come from the JSON of ``meta`` and are
    NULL for conversations that are not synthetic.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source")) - 1
    c = F.col("conversation")
    return corpus.where(F.col("source").isin(*sources)).select(
        serialize(c, view, lowercase).alias("text"), place.cast("int").alias("label"), "source", "conv_id", F.size(c).alias("n_turns"), n_user_turns(c).alias("n_user_turns"),
        "n_words_user", *[F.get_json_object("meta", f"$.{k}").alias(k) for k in ("seed_conv_id", "intent_source")])
