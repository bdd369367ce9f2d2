"""Scalar text expressions (all JVM-side columns, no Python UDF)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace class of Python's str.isspace, as a Java pattern.
WS = r"(?U)[\s\x1c-\x1f]+"
WS_CHAR = r"[\s\x1c-\x1f]"

# The redaction-marker patterns, in rule order (earlier rules win ties at one position).
MARKERS = (
    r"\bNAME_\d+\b",
    r"\[your answer\]",
    r"<PRESIDIO_ANONYMIZED_[A-Z_0-9]+>",
    r"<TRUFFLEHOG_REDACTED_[A-Z_0-9]+>",
    r"<REDACTED>",
    r"<URL>",
    r"<DATE_TIME>",
)

#: A text without any of these holds none of MARKERS; the test is far cheaper than the patterns.
MARKER_HINTS = ("NAME_", "[your answer]", "<PRESIDIO_", "<TRUFFLEHOG_", "<REDACTED>", "<URL>", "<DATE_TIME>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column used inside a higher-order lambda is evaluated anew for every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    """Python ``str.strip``: every Unicode space at both ends."""
    return F.regexp_replace(col, rf"(?U)\A{WS_CHAR}+|{WS_CHAR}+\z", "")


def is_blank(col: Column) -> Column:
    """True for NULL, empty and whitespace-only text."""
    return F.coalesce(F.regexp_replace(col, WS, "") == "", F.lit(True))


def norm_text(col: Column) -> Column:
    """Strip, lower, collapse white space to one blank; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), WS, " "))


def md5_text(col: Column) -> Column:
    """md5 hex of the UTF-8 bytes."""
    return F.md5(col.cast("binary"))


def words(col: Column) -> Column:
    """``text.split()``: words between runs of white space; NULL gives an empty array."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), WS), lambda w: w != "")


def word_count(col: Column) -> Column:
    return F.size(words(col))


def word_ngrams(col: Column, n: int) -> Column:
    """Lower-cased word n-grams; fewer than n words give an empty array. Repeats are kept."""
    def grams(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, every).otherwise(F.array().cast("array<string>"))

    return let(words(F.lower(col)), grams)


def alternation(rules: tuple[str, ...]) -> str:
    return "(?U)(?:" + "|".join(rules) + ")"


def may_hold_marker(col: Column) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(h) for h in MARKER_HINTS])


def find_markers(col: Column, rules: tuple[str, ...] = MARKERS) -> Column:
    """All marker occurrences, leftmost first, non-overlapping."""
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(alternation(rules)), F.lit(0))


def has_marker(col: Column, rules: tuple[str, ...] = MARKERS) -> Column:
    found = col.rlike(alternation(rules))
    return F.coalesce(may_hold_marker(col) & found if rules is MARKERS else found, F.lit(False))


def delete_markers(col: Column, rules: tuple[str, ...] = MARKERS, passes: int = 4) -> Column:
    """Delete markers until none is left; adjoining white space becomes one blank, none at the edges.

    Each pass is two JVM regex replacements. ``passes`` are unrolled; a text that still holds a marker then goes
    through further passes until it holds none. NULL stays NULL.
    """
    m, ws = alternation(rules)[4:], f"{WS_CHAR}*"
    edge = rf"(?U)\A{ws}(?:{m}{ws})+|{ws}(?:{m}{ws})+\z"
    inner = rf"(?U){ws}(?:{m}{ws})+"

    def once(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(c, edge, ""), inner, " ")

    def state(c: Column) -> Column:
        return F.struct(c.alias("text"), has_marker(c, rules).alias("more"))

    def rest(c: Column) -> Column:
        step = lambda acc, _: F.when(acc["more"], let(once(acc["text"]), state)).otherwise(acc)
        deep = F.aggregate(F.sequence(F.lit(1), F.length(c)), state(c), step)["text"]  # a pass shortens the text
        return F.when(has_marker(c, rules), deep).otherwise(c)

    cut = let(reduce(lambda c, _: once(c), range(passes), col), rest)
    return F.when(may_hold_marker(col), cut).otherwise(col) if rules is MARKERS else cut


def strip_thinking(col: Column) -> Column:
    """Text after the last ``</think>``; '' when an unclosed ``<think>`` remains; stripped."""
    tail = F.substring_index(col, "</think>", -1)
    return F.when(tail.contains("<think>"), F.lit("")).otherwise(strip(tail))


def gsm_answer(col: Column) -> Column:
    """Number after ``####`` at the end of a worked answer, commas removed; NULL when there is none."""
    got = F.regexp_extract(strip(col), r"####\s*(.+?)\s*$", 1)
    return F.nullif(F.replace(got, F.lit(","), F.lit("")), F.lit(""))


def hash_unit(seed: str, key: Column) -> Column:
    """Deterministic u in (0,1) from md5(seed:key); equal in every engine that has md5."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string"))), 1, 13), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(float(16**13))


def hash_order(seed: str, key: Column) -> Column:
    """Deterministic shuffle key."""
    return F.md5(F.concat(F.lit(seed + ":"), key.cast("string")))
