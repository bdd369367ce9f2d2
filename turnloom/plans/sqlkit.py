"""DuckDB fragments shared by the oracle queries."""

from __future__ import annotations

#: Python's white space for RE2.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: User turns of a conversation column.
USERS = "list_transform(list_filter(conversation, lambda t: t.role = 'user'), lambda t: coalesce(t.content, ''))"
MARK = r"(?:\bNAME_\d+\b|\[your answer\]|<PRESIDIO_ANONYMIZED_[A-Z_0-9]+>|<TRUFFLEHOG_REDACTED_[A-Z_0-9]+>|<REDACTED>|<URL>|<DATE_TIME>)"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '{WS}+', ' ', 'g'))"


def split_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def users_of(conv: str = "conversation") -> str:
    return USERS.replace("conversation", conv, 1)


def user_text(conv: str = "conversation") -> str:
    return f"coalesce(array_to_string({users_of(conv)}, chr(10)), '')"


def opener(conv: str = "conversation") -> str:
    return f"coalesce(({users_of(conv)})[1], '')"


def clean(x: str) -> str:
    """Marker deletion, two passes (no deeper nesting in the tables)."""
    for _ in range(2):
        x = f"regexp_replace({x}, '^{WS}*(?:{MARK}{WS}*)+|{WS}*(?:{MARK}{WS}*)+$', '', 'g')"
        x = f"regexp_replace({x}, '{WS}*(?:{MARK}{WS}*)+', ' ', 'g')"
    return x


CLEAN_CONV = (
    "list_transform(conversation, lambda t: {'role': t.role, 'content': CASE WHEN t.role = 'user' THEN " + clean("t.content") + " ELSE t.content END})"
)


def unit(seed: str, key: str) -> str:
    """Deterministic u in (0,1), as functions.text.hash_unit."""
    return f"((CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


def order(seed: str, key: str) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR))"
