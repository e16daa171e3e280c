"""SQL text for expressions over large literal tables.

A table of a few hundred words becomes one parsed expression instead of thousands of driver-side
column objects.  ``text`` arguments are SQL expressions (usually a column name).
"""

from __future__ import annotations

import re


def lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def arr(items: list[str]) -> str:
    return "array(" + ", ".join(items) + ")" if items else "cast(array() as array<string>)"


def any_contains(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def any_rlike(text: str, patterns: list[str], ignore_case: bool = False) -> str:
    flag = "(?i)" if ignore_case else ""
    return "(" + " OR ".join(f"{text} RLIKE {lit(flag + p)}" for p in patterns) + ")"


# What a piece that every match holds may not cross: groups, classes, any character, optional characters, borders.
_LOOSE = re.compile(r"(?<!\\)\([^()\\]*\)[?*+]*|\\[dDsSwWbB][?*+]*|(?<!\\)\.[?*+]*|(?:\\\W|[^\\])[?*]|(?<!\\)[+^$]")
# Sets, counts, flags, quotes, escaped backslashes and brackets, nested or odd groups.
_UNSURE = re.compile(r"(?<!\\)\[|\{|\(\?|\\[^\WdDsSwWbB]|\\[\\()|]|\([^)]*[(\\]")


def anchor(pattern: str) -> str:
    """The longest lower-case piece that each match of the pattern holds, without regard to case; empty where none can be told.

    A plain test for it spares most texts the regex.
    """
    if not pattern.isascii() or _UNSURE.search(pattern):
        return ""
    rest = re.sub(r"\\(\W)", r"\1", _LOOSE.sub("\0", pattern))
    return "" if "|" in rest else max(rest.split("\0"), key=len).lower()


def contained(text: str, piece: str) -> str:
    """A plain test for a piece, to stand before a regex; nothing for no piece."""
    return f"contains({text}, {lit(piece)}) AND " if piece else ""


def anchored(text: str, low: str, pattern: str) -> str:
    """``text RLIKE`` the pattern in either case, tried where ``low``, the text in lower case, holds the pattern's anchor."""
    return contained(low, anchor(pattern)) + f"{text} RLIKE {lit('(?i)' + pattern)}"


def count_hits(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"int(contains({text}, {lit(w)}))" for w in words) + ")"


def first_of(arms: list[tuple[str, str]], default: str) -> str:
    """CASE over (condition, value) SQL pairs."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in arms) + f" ELSE {default} END"


def decisive(groups: list[tuple[str, list[str]]]) -> list[tuple[str, list[str]]]:
    """The groups with those words that can decide which group is hit first: a word that holds one of its own or an earlier group's never does."""
    seen, out = [], []
    for label, words in groups:
        own = [w for w in words if not any(s in w for s in seen) and not any(o != w and o in w for o in words)]
        seen += own
        out += [(label, list(dict.fromkeys(own)))] * bool(own)
    return out


def kept(arms: list[tuple[str, str]]) -> str:
    """Array of the values whose condition holds, in order."""
    return "array_compact(array(" + ", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in arms) + "))"


def found_words(text: str, words: list[str]) -> str:
    """Array of those of the (lower-case) words that ``text`` holds, in order: one lambda over a constant list, whose plan does not grow with the list."""
    return f"filter({arr([lit(w) for w in words])}, w -> contains({text}, w))"


def map_of(table: dict) -> str:
    def value(v):
        return lit(v) if isinstance(v, str) else arr([lit(x) for x in v]) if isinstance(v, (list, tuple)) else f"{v}D" \
            if isinstance(v, float) else str(v)
    return "map(" + ", ".join(f"{lit(k)}, {value(v)}" for k, v in table.items()) + ")"
