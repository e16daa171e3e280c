"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings. DataFrame functions only.

A candidate is a long run of token characters with a letter and a digit. A window slides over it; the counts of its characters are kept
incrementally (one comes, one goes), and so is the sum of c log2 c, which gives the Shannon entropy of the window. The
candidate is a secret if the best window reaches the threshold of its character class, unless the allow-list knows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import spans as sp
from .shared import text_of

WINDOW = 20
KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"  # runs of hex digits are maximal, so shorter ones need no second look
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
#: Character class -> (pattern of its strings, bits that a window of 20 characters must reach).
CLASSES = {"hex": (r"^[0-9a-fA-F_=-]+$", 3.0), "capitals": (r"^[A-Z0-9_=-]+$", 3.4), "base64": (r"^[A-Za-z0-9+/_=-]+$", 3.7)}
#: Strings that look random and are no secrets.
ALLOWED = r"(?i)example|placeholder|changeme|your[_-]|dummy|xxxx|0{8}|1234567890|0123456789abcdef|abcdefghij|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
#: What stands before strings that are addresses or content hashes.
ALLOWED_BEFORE = r"(?i)(://\S*|www\.\S*|base64,|sha-?(1|224|256|384|512)[:= -]{1,2}|md5[:= -]{1,2}|integrity=\S*)$"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _weight(c: Column) -> Column:
    return F.when(c > 0, c * F.log2(F.greatest(c, F.lit(1.0)))).otherwise(F.lit(0.0))


def best_window_entropy(piece: Column, window: int = WINDOW) -> Column:
    """The largest entropy, in bits, of a window of ``window`` characters (of the whole string if it is shorter).

    State: counts by character, the sum of c log2 c, and the best entropy so far; each character changes one or two counts.
    """
    chars = F.transform(F.split(piece, ""), lambda c: F.instr(F.lit(_ALPHABET), c))
    return sp.let(chars, lambda codes: F.aggregate(
        F.sequence(F.lit(1), F.size(codes)),
        F.struct(F.array_repeat(F.lit(0.0), len(_ALPHABET)).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best")),
        lambda acc, i: _step(acc, i, codes, window), lambda acc: acc["best"]))


def _step(acc: Column, i: Column, codes: Column, window: int) -> Column:
    come = F.element_at(codes, i)
    go = F.when(i > window, F.element_at(codes, F.greatest(i - window, F.lit(1)))).otherwise(F.lit(0))
    have = lambda code: F.coalesce(F.get(acc["n"], code - 1), F.lit(0.0))
    same = come == go
    grown = acc["sum"] + F.when(same, 0.0).otherwise(
        _weight(have(come) + 1) - _weight(have(come)) + F.when(go > 0, _weight(have(go) - 1) - _weight(have(go))).otherwise(F.lit(0.0)))
    counts = F.when(same, acc["n"]).otherwise(F.transform(
        acc["n"], lambda c, k: c + F.when(k == come - 1, 1.0).when(k == go - 1, -1.0).otherwise(F.lit(0.0))))
    size = F.least(i, F.lit(window)).cast("double")
    full = (i >= window) | (i == F.size(codes))
    best = F.when(full, F.greatest(acc["best"], F.log2(size) - grown / size)).otherwise(acc["best"])
    return F.struct(counts.alias("n"), grown.alias("sum"), best.alias("best"))


def _bits(piece: Column) -> Column:
    out = F.lit(float("inf"))
    for pattern, bits in reversed(CLASSES.values()):
        out = F.when(piece.rlike(pattern), F.lit(bits)).otherwise(out)
    return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """_row (the row of ``docs``), base_spans (assign, access, hex) and secret_spans (those, and entropy spans that overlap none of them).

    Null text counts as empty. Rows are independent: repeated rows give equal results, an empty table gives none.
    """
    t = F.col("_text")
    low = F.lower(t)
    word = low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token") | low.contains("api")
    assign = F.filter(sp.matches(t, "assign", 0, ASSIGN, word), lambda s: F.char_length(F.regexp_extract(s["piece"], ASSIGN, 1)) >= 8)
    access = F.filter(sp.matches(t, "access", 1, ACCESS, t.contains("AKIA")), lambda s: F.char_length(s["piece"]) >= 16)
    hexes = sp.matches(t, "hex", 2, HEX, t.rlike("[0-9a-f]{32}"))
    candidates = sp.matches(t, "entropy", 3, CANDIDATE, t.rlike("[0-9]") & t.rlike("[A-Za-z0-9+/_=-]{20}"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text_of().alias("_text"))
    rows = rows.withColumn("base_spans", F.concat(assign, access, hexes)).withColumn("_candidates", candidates)
    known = F.filter("_candidates", lambda s: ~s["piece"].rlike(ALLOWED) & ~s["before"].rlike(ALLOWED_BEFORE))
    fresh = sp.uncovered(known, F.col("base_spans"))
    random = F.filter(fresh, lambda s: best_window_entropy(s["piece"]) >= _bits(s["piece"]))
    return rows.withColumn("secret_spans", F.concat("base_spans", random)).drop("_text", "_candidates")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; one row per row of ``docs``. Counts are those of the base spans.

    Other columns are ignored; a null doc_id stays null.
    """
    found = find_secrets(docs.select("doc_id", "text"))
    return found.select("_row.doc_id", *[sp.count(F.col("base_spans"), k).alias(f"n_{k}") for k in KINDS[:3]],
                        F.sha2(sp.listed(F.col("base_spans")), 256).alias("base_sha256"), sp.listed(F.col("secret_spans")).alias("spans"))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns, each secret span of text replaced by its kind in brackets; null text stays null."""
    text = F.col("_row.text")
    new = F.when(text.isNotNull(), sp.redacted(text, F.col("secret_spans")))
    return find_secrets(docs).select(*[new.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
