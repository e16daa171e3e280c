"""String columns: rule-table classifiers and text utilities (all JVM-side expressions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..rules import taxonomy as tx
from . import sqltext as sq

# Unicode word characters, spelled out so that every regex engine agrees.
WORD = r"\p{L}\p{N}_"


def any_contains(text: Column | str, words: list[str]) -> Column:
    """True when ``text`` contains any of ``words`` (plain substring test).

    Here and below, ``text`` is a Column or the name of a column; large word tables want the name.
    """
    if isinstance(text, str):
        return F.expr(sq.any_contains(text, words))
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def any_rlike(text: Column | str, patterns: list[str], ignore_case: bool = False) -> Column:
    if isinstance(text, str):
        return F.expr(sq.any_rlike(text, patterns, ignore_case))
    flag = "(?i)" if ignore_case else ""
    return reduce(lambda a, b: a | b, [text.rlike(flag + p) for p in patterns])


def first_group(text: str, groups: list[tuple[str, list[str]]], default: str = "unknown",
                relabel=lambda x: x) -> Column:
    """Label of the first group with a substring hit; ``text`` is already lower-cased."""
    return F.expr(sq.first_of([(sq.any_contains(text, words), sq.lit(relabel(label))) for label, words in sq.decisive(groups)],
                              sq.lit(default)))


def all_groups(text: str, groups: list[tuple[str, list[str]]], default: str = "unknown",
               relabel=lambda x: x) -> Column:
    """Distinct labels of every group with a hit, in table order; ``[default]`` when none."""
    hits = F.array_distinct(F.expr(sq.kept([(sq.any_contains(text, words), sq.lit(relabel(label)))
                                            for label, words in groups])))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(default)))


def count_hits(text: str, words: list[str]) -> Column:
    return F.expr(sq.count_hits(text, words))


def matching_words(text: str, words: list[str]) -> Column:
    """The sub-list of ``words`` found in ``text`` (lower-cased comparison), table order."""
    if all(w == w.lower() for w in words):
        return F.expr(f"if({text} IS NULL, {sq.arr([])}, {sq.found_words(text, words)})")
    return F.expr(sq.kept([(f"contains({text}, {sq.lit(w.lower())})", sq.lit(w)) for w in words]))


def most_hits(text: str, groups: list[tuple[str, list[str]]], default: str = "unknown") -> Column:
    """Label with the most keyword hits; the earlier group wins ties."""
    rows = [f"named_struct('n', {sq.count_hits(text, words)}, 'o', {-i}, 'v', {sq.lit(label)})"
            for i, (label, words) in enumerate(groups)]
    best = F.array_max(F.expr(sq.arr(rows)))
    return F.when(best["n"] > 0, best["v"]).otherwise(F.lit(default))


def normalize_bug_label(raw: str) -> str:
    """Driver-side form of :func:`normalize_bug_type`, for literals in rule tables."""
    key = (raw or "").strip()
    if not key:
        return "unknown"
    if key in tx.BUG_TYPES:
        return key
    low = key.lower()
    flat = low.replace("-", "_").replace(" ", "_")
    for k in (low, flat):
        if k in tx.BUG_TYPE_ALIASES:
            return tx.BUG_TYPE_ALIASES[k]
    return next((b for b in tx.BUG_TYPES if b == flat or b in flat or flat in b), "unknown")


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Literal map lookup; null when the key is absent."""
    return F.try_element_at(F.expr(sq.map_of(table)), key)


def normalize_bug_type(raw: Column) -> Column:
    """Canonical bug type: exact, alias, separator-normalised, then containment in enum order."""
    key = F.trim(F.coalesce(raw, F.lit("")))
    low = F.lower(key)
    flat = F.translate(low, "- ", "__")
    exact = F.when(key.isin(tx.BUG_TYPES), key)
    flat_enum = F.when(flat.isin(tx.BUG_TYPES), flat)
    fuzzy = None
    for b in tx.BUG_TYPES:
        cond = F.contains(flat, F.lit(b)) | F.contains(F.lit(b), flat)
        fuzzy = F.when(cond, F.lit(b)) if fuzzy is None else fuzzy.when(cond, F.lit(b))
    return F.when(key == "", F.lit("unknown")).otherwise(F.coalesce(
        exact, lookup(low, tx.BUG_TYPE_ALIASES), lookup(flat, tx.BUG_TYPE_ALIASES), flat_enum,
        fuzzy, F.lit("unknown")))


def bug_category(bug_type: Column) -> Column:
    table = {b: c for c, types in tx.BUG_CATEGORIES.items() for b in types}
    return F.coalesce(lookup(bug_type, table), F.lit("other"))


def bug_description(bug_type: Column) -> Column:
    return F.coalesce(lookup(bug_type, tx.BUG_DESCRIPTIONS), F.lit(tx.BUG_DESCRIPTION_DEFAULT))


# Every Unicode white-space character.
SPACES = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
          "\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    """Trim all Unicode white space on both ends."""
    return F.btrim(text, F.lit(SPACES))


def non_empty(text: Column) -> Column:
    return F.when(text != "", text)


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null when there is none or it is empty."""
    return non_empty(F.regexp_extract(text, pattern, group))


def truncate_text(text: Column, max_len: int = 200, suffix: str = "...") -> Column:
    """Cut at a word boundary when the last space lies past half of ``max_len``."""
    cut = F.substring(text, 1, max_len - len(suffix))
    last_space = F.length(cut) - F.instr(F.reverse(cut), " ")  # 0-based; == length when absent
    at_word = (F.instr(cut, " ") > 0) & (last_space > max_len // 2)
    short = F.when(at_word, F.substring(cut, F.lit(1), last_space.cast("int"))).otherwise(cut)
    return F.when(F.length(text) <= max_len, text).otherwise(F.concat(short, F.lit(suffix)))


def clean_text(text: Column, squeeze: bool = True) -> Column:
    """Drop ANSI colours, unify newlines, squeeze blank lines, right-trim lines, trim."""
    out = F.regexp_replace(text, "\\x1b\\[[0-9;]*m", "")
    out = F.regexp_replace(out, "\r\n?", "\n")
    if squeeze:
        out = F.regexp_replace(out, "\n{3,}", "\n\n")
        out = F.regexp_replace(out, r"[ \t\f\x0B\x1C-\x1F\x85\p{Z}]+(?=\n|$)", "")
    return strip(out)


def commit_hash_in(text: Column) -> Column:
    """First 40-hex word, else first 12-hex word, else null."""
    def word(n):
        return extract(text, rf"(?<![{WORD}])([0-9a-fA-F]{{{n}}})(?![{WORD}])")
    return F.coalesce(word(40), word(12))


def cve_ids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)(" + tx.CVE_PATTERN + ")"), 1))


def emails(text: Column) -> Column:
    pattern = rf"([{WORD}.+-]+@[{WORD}-]+\.[{WORD}.-]+)"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))


def safe_filename(name: Column, max_len: int = 120) -> Column:
    """Replace separators and reserved characters, trim dots/spaces, keep the extension when cut."""
    out = F.translate(name, "/\\<>:\"|?*", "_________")
    out = F.regexp_replace(out, r"^[. ]+|[. ]+$", "")
    ext = F.regexp_extract(out, r"(?s)^.*[^.].*?(\.[^.]*)$", 1)
    base = F.substring(out, F.lit(1), F.length(out) - F.length(ext))
    cut = F.concat(F.substring(base, F.lit(1), F.lit(max_len) - F.length(ext)), ext)
    out = F.when(F.length(out) > max_len, cut).otherwise(out)
    return F.when(out == "", F.lit("unnamed")).otherwise(out)


def fixed(x: Column, digits: int) -> Column:
    """Fixed-point text without digit grouping (exact half-even rounding)."""
    return F.translate(F.format_number(x, digits), ",", "")


def format_duration(ms: Column) -> Column:
    secs = ms / 1000
    minutes = F.floor(secs / 60)
    return (F.when(ms < 1, F.concat(fixed(ms * 1000, 0), F.lit("μs"))).when(ms < 1000, F.concat(fixed(ms, 0), F.lit("ms")))
            .when(ms < 60000, F.concat(fixed(secs, 2), F.lit("s")))
            .otherwise(F.concat(minutes.cast("string"), F.lit("m "), fixed(secs - minutes * 60, 0), F.lit("s"))))


def to_bool(text: Column) -> Column:
    return F.coalesce(F.lower(text).isin("true", "yes", "1", "on", "y"), F.lit(False))


def words(text: Column) -> Column:
    """Distinct lower-case white-space tokens."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[\s\p{Z}\x0B\x1C-\x1F\x85]+"), lambda t: t != ""))


def overlap_score(query: Column, document: Column) -> Column:
    """|Q ∩ D| / |Q| over lower-case tokens; 0.5 for an empty query."""
    q = words(query)
    return F.when(F.size(q) == 0, F.lit(0.5)).otherwise(
        F.size(F.array_intersect(q, words(document))) / F.size(q))


def json_from_answer(answer: Column, schema) -> Column:
    """Recover a JSON object from a model answer: whole text, fenced block, outermost braces."""
    def attempt(t: Column) -> Column:
        return F.when(F.try_parse_json(t).isNotNull() & F.trim(t).startswith("{"), F.from_json(t, schema))
    fenced = F.regexp_extract(answer, r"```(?:json)?\s*([\s\S]*?)\s*```", 1)
    braces = F.regexp_extract(answer, r"\{[\s\S]*\}", 0)
    return F.coalesce(attempt(answer), attempt(fenced), attempt(braces))


def flattened(schema, sep: str = ".", parent: str = "") -> list[Column]:
    """The leaves of nested structs as columns named by their path; arrays and maps are leaves."""
    from pyspark.sql.types import StructType
    out = []
    for f in schema.fields:
        path = f"{parent}.`{f.name}`" if parent else f"`{f.name}`"
        if isinstance(f.dataType, StructType):
            out += [c.alias(f"{f.name}{sep}{n}") for n, c in zip(leaf_names(f.dataType, sep), flattened(f.dataType, sep, path))]
        else:
            out.append(F.col(path).alias(f.name))
    return out


def leaf_names(schema, sep: str = ".") -> list[str]:
    from pyspark.sql.types import StructType
    return [f"{f.name}{sep}{n}" if isinstance(f.dataType, StructType) else f.name for f in schema.fields
            for n in (leaf_names(f.dataType, sep) if isinstance(f.dataType, StructType) else [""])]
