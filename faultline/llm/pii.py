"""Personal data by weak supervision. DataFrame functions only.

Candidate spans come from patterns. Labelers (pattern, gazetteer, context) vote on each: 1, -1, or 0 for no opinion. The votes are
counted by vote pattern, of which there is a fixed number; expectation-maximisation over the counts estimates the labelers' reliabilities
and the chance of each pattern, and these chances train the final span classifier, naive Bayes over votes and span features.
Candidates of the base kinds are always spans; the others are, if the classifier says so.

Only counts by vote pattern and by feature meet in one place; their number is bounded by the labelers and features, not by the data.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, functions as F

from . import spans as sp
from .shared import cut, text_of

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "local_phone", "id_number", "account", "person"]
ROUNDS = 25

# \G lets a match start right after the one before; the lookbehind keeps long runs without a match linear
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
LOCAL_PHONE = r"(?<![0-9+(.\x20-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])|(?<=[A-Za-z:,;]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])"
ID_NUMBER = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
ACCOUNT = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
PERSON = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora?|Madame|Monsieur)\.?\x20[A-Z][a-zà-ÿ]+(?:\x20[A-Z][a-zà-ÿ]+)?"

#: Strict forms, by kind.
STRICT = {
    "email": r"^[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^[2-6][0-9]{13,18}$|^[2-6][0-9]{3}(?:[\x20-][0-9]{4}){2}[\x20-][0-9]{2,7}$|^3[47][0-9]{2}[\x20-][0-9]{6}[\x20-][0-9]{5}$",
    "phone": r"^\+[1-9][0-9]{0,2}(?:[\x20.-]?\(?[0-9]++\)?)++$",
    "local_phone": r"^\(?[2-9][0-9]{2}\)?[\x20.-]?[2-9][0-9]{2}[.-][0-9]{4}$",
    "id_number": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "account": r"^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)[0-9]{2}",
    "person": r"^[A-Z][a-zñ]+\.?\x20[A-Z]",
}
#: Gazetteers: top-level domains, issuers' numbers, calling codes, frequent given names. A kind without one has no opinion.
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|mil|int|info|biz|io|dev|app|eu|uk|us|de|fr|es|it|nl|be|at|ch|pl|pt|se|no|dk|fi|ie|ca|au|br|mx|in|jp|cn|ru|co)$",
    "ip": r"^(?!0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|2(?:2[4-9]|[3-5][0-9])\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[4-8]|60|6[245])",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})",
    "person": r"(?i)\x20(?:james|john|robert|michael|mary|patricia|jennifer|linda|elizabeth|anna|maria|peter|thomas|hans|jürgen|pierre|jean|marie|josé|carmen|carlos|laura|david|daniel|sarah)\b",
}
#: Words near a span that speak for its kind.
WORDS = {
    "email": r"(?i)e-?mail|contact|write\x20to|correo|courriel",
    "ip": r"(?i)\bip\b|address|server|host|login|adresse",
    "card": r"(?i)card|visa|credit|payment|tarjeta|karte|carte",
    "phone": r"(?i)phone|\btel|call|mobile|fax|telef|anruf|handy",
    "local_phone": r"(?i)phone|\btel|call|mobile|fax|telef|anruf|handy",
    "id_number": r"(?i)ssn|social\x20security|\bid\b|identity|tax",
    "account": r"(?i)iban|account|bank|konto|compte|cuenta",
    "person": r"(?i)name|born|dear|sincerely|regards",
}
AGAINST = r"(?i)(?:version|release|build|ver\.?|\bv|isbn|issn|doi|part|section|chapter|fig\.?|order|sku|item|#|no\.|rfc|iso)[\x20:=#-]*$"
LABELERS = ["pattern", "gazetteer", "context", "against", "border", "company"]


# --- candidates ---------------------------------------------------------------------------------

def _digits(piece: Column) -> Column:
    return F.regexp_replace(piece, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass: from the right, every second one doubled, its digits summed."""
    codes = F.reverse(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: F.ascii(c) - 48))
    total = F.aggregate(F.transform(codes, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)),
                        F.lit(0), lambda a, d: a + d)
    return total % 10 == 0


def base_candidates(t: Column) -> Column:
    """Spans of the base kinds: leftmost matches of each, those that fail its test dropped."""
    digit = t.rlike("[0-9]")
    email = sp.matches(t, "email", 0, EMAIL, t.contains("@"))
    ip = F.filter(sp.matches(t, "ip", 1, IP, t.rlike(r"[0-9]\.[0-9]")), lambda s: s["piece"].rlike(IP_PARTS))
    card = F.filter(sp.matches(t, "card", 2, CARD, digit),
                    lambda s: sp.let(_digits(s["piece"]), lambda d: F.when(F.char_length(d).between(14, 19), luhn(d)).otherwise(False)))
    phone = F.filter(sp.matches(t, "phone", 3, PHONE, t.contains("+")), lambda s: F.char_length(_digits(s["piece"])).between(10, 15))
    return F.concat(email, ip, card, phone)


def other_candidates(t: Column) -> Column:
    three = t.rlike("[0-9]{3}")
    return F.concat(sp.matches(t, "local_phone", 4, LOCAL_PHONE, three & t.rlike("[0-9]{3}[.-][0-9]{4}")),
                    sp.matches(t, "id_number", 5, ID_NUMBER, three & t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}")),
                    sp.matches(t, "account", 6, ACCOUNT, t.rlike("[A-Z]{2}[0-9]{2}")),
                    sp.matches(t, "person", 7, PERSON, t.rlike(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora?|Madame|Monsieur)\b")))


def _by_kind(s: Column, patterns: dict[str, str], on: Column, yes: int, no: int) -> Column:
    out = F.lit(0)
    for kind, pattern in patterns.items():
        out = F.when(s["kind"] == kind, F.when(on.rlike(pattern), F.lit(yes)).otherwise(F.lit(no))).otherwise(out)
    return out


def kinds_of(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, lambda s: s["kind"]))


def votes(s: Column, kinds: Column) -> Column:
    """The labelers' votes on a span, in the order of LABELERS; ``kinds`` are those of all candidates of its text."""
    near = F.concat_ws(" ", s["before"], s["after"])
    border = ~s["before"].rlike(r"[A-Za-z0-9_./=-]$") & ~s["after"].rlike(r"^(?:[A-Za-z0-9_/=%]|[.-][A-Za-z0-9])")
    return F.array(
        _by_kind(s, STRICT, s["piece"], 1, -1), _by_kind(s, GAZETTEER, s["piece"], 1, -1), _by_kind(s, WORDS, near, 1, 0),
        F.when(s["before"].rlike(AGAINST), F.lit(-1)).otherwise(F.lit(0)), F.when(border, F.lit(1)).otherwise(F.lit(-1)),
        F.when(F.exists(kinds, lambda k: k != s["kind"]), F.lit(1)).otherwise(F.lit(0)))


def _char_class(c: Column) -> Column:
    return (F.when(c == "", "edge").when(c.rlike(r"^\s$"), "space").when(c.rlike("^[0-9]$"), "digit").when(c.rlike("^[A-Za-z]$"), "letter")
            .otherwise("sign"))


def features(s: Column, vote: Column) -> Column:
    """name=value strings of a span: its kind with each vote, length, share of digits and the characters around it."""
    kind, n = s["kind"], F.char_length(s["piece"])
    digits = F.floor(F.char_length(_digits(s["piece"])) * 4 / n)
    named = [(name, vote[k]) for k, name in enumerate(LABELERS)]
    named += [("length", F.least(F.floor(n / 4), F.lit(12))), ("digits", digits), ("left", _char_class(F.right(s["before"], F.lit(1)))),
              ("right", _char_class(F.left(s["after"], F.lit(1))))]
    return F.array(*[F.concat_ws("=", F.lit(name), kind, value.cast("string")) for name, value in named])


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base and other: arrays of candidate spans (other ones only where they overlap no base span)."""
    docs = docs.withColumn("_t", text_of(text))
    docs = docs.withColumn("base", base_candidates(F.col("_t"))).withColumn("other", other_candidates(F.col("_t")))
    return docs.withColumn("other", sp.uncovered(F.col("other"), F.col("base"))).drop("_t")


# --- label model and classifier -----------------------------------------------------------------

def profiles(found: DataFrame) -> DataFrame:
    """vote, feature, n: how many candidates have each combination of votes and features."""
    both = found.filter((F.size("base") > 0) | (F.size("other") > 0)).select(F.concat("base", "other").alias("all"))
    each = lambda kinds: F.transform("all", lambda s: sp.let(votes(s, kinds), lambda v: F.struct(v.alias("vote"), features(s, v).alias("feature"))))
    rows = both.select(F.explode(sp.let(kinds_of(F.col("all")), each)).alias("c"))
    return rows.groupBy("c.vote", "c.feature").agg(F.count(F.lit(1)).cast("double").alias("n"))


def _log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def chance(vote: Column, state: Column) -> Column:
    """Probability that a candidate with these votes is personal data; state: reliability of each labeler, then the prior."""
    z = _log_odds(state[len(LABELERS)])
    for k in range(len(LABELERS)):
        z = z + vote[k] * _log_odds(state[k])
    return 1 / (1 + F.exp(-z))


def estimate(profile: DataFrame, rounds: int = ROUNDS) -> list[float]:
    """Reliabilities and prior by expectation-maximisation; one row of counts per vote pattern, at most 3^labelers of them.

    Reliabilities have a Beta(8, 2) prior and stay within [0.55, 0.99], so labelers keep their sense; without candidates they are 0.8.
    """
    one = (profile.groupBy("vote").agg(F.sum("n").alias("n")).agg(F.collect_list(F.struct("vote", "n")).alias("rows")))
    total = lambda rows, f: F.aggregate(rows, F.lit(0.0), lambda a, r: a + f(r))

    def maximise(rows: Column) -> Column:
        new = []
        for k in range(len(LABELERS)):
            right = total(rows, lambda r, k=k: r["n"] * F.when(r["vote"][k] == 1, r["p"]).when(r["vote"][k] == -1, 1 - r["p"]).otherwise(F.lit(0.0)))
            cast = total(rows, lambda r, k=k: r["n"] * F.abs(r["vote"][k]))
            new.append(F.greatest(F.lit(0.55), F.least(F.lit(0.99), (right + 8.0) / (cast + 10.0))))
        share = (total(rows, lambda r: r["n"] * r["p"]) + 1.0) / (total(rows, lambda r: r["n"]) + 2.0)
        return F.array(*new, F.greatest(F.lit(0.01), F.least(F.lit(0.99), share)))

    def step(state: Column, _: Column) -> Column:
        weighed = F.transform("rows", lambda r: F.struct(r["vote"].alias("vote"), r["n"].alias("n"), chance(r["vote"], state).alias("p")))
        return sp.let(weighed, maximise)

    start = F.array(*[F.lit(0.8)] * len(LABELERS), F.lit(0.5))
    return list(one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("state")).first()["state"])


def fit(profile: DataFrame, state: list[float]) -> tuple[dict[str, float], float]:
    """Naive Bayes weights of features, and the prior, from the label model's chances (a row per feature value: bounded)."""
    p = chance(F.col("vote"), F.array(*[F.lit(x) for x in state]))
    soft = profile.select("feature", (F.col("n") * p).alias("yes"), (F.col("n") * (1 - p)).alias("no"))
    rows = soft.select(F.explode("feature").alias("f"), "yes", "no").groupBy("f").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()
    sums = soft.agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).first()
    yes, no = (sums["yes"] or 0.0) + 2, (sums["no"] or 0.0) + 2
    return {r.f: log((r.yes + 1) / yes) - log((r.no + 1) / no) for r in rows}, log(yes / no)


def train(found: DataFrame) -> tuple[dict[str, float], float]:
    profile = cut(profiles(found), "profiles")
    return fit(profile, estimate(profile))


def accepted(found: DataFrame, model: tuple[dict[str, float], float]) -> DataFrame:
    """``found`` with spans: the base candidates and those others that the classifier takes for personal data."""
    weights, prior = model
    if not weights:
        return found.withColumn("spans", F.col("base"))
    table = F.create_map(*[x for f, w in sorted(weights.items()) for x in (F.lit(f), F.lit(w))])
    # votes are correlated, so their mean weight, not their sum, meets the prior
    score = lambda s, kinds: F.lit(prior) + F.aggregate(features(s, votes(s, kinds)), F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at(table, f), F.lit(0.0))) / 3
    kept = sp.let(kinds_of(F.concat("base", "other")), lambda kinds: F.filter("other", lambda s: score(s, kinds) >= 0))
    return found.withColumn("spans", F.concat("base", kept))


# --- uses ---------------------------------------------------------------------------------------

def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; one row per row of ``docs``. Counts are those of base spans.

    Null text counts as empty; repeated rows and null ids are rows like others; other columns are ignored; an empty table gives no rows.
    """
    found = cut(candidates(docs.select("doc_id", "text")).drop("text"), "candidates")
    out = accepted(found, train(found))
    base = F.col("base")
    return out.select("doc_id", *[sp.count(base, k).alias(f"n_{k}") for k in BASE], F.sha2(sp.listed(base), 256).alias("base_sha256"),
                      sp.listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns and rows, each span of text replaced by its kind in brackets; null text stays null."""
    model = train(cut(candidates(docs.select("text")).drop("text").filter((F.size("base") > 0) | (F.size("other") > 0)), "candidates"))
    spans = accepted(candidates(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("text"))), model)
    return spans.select("_row", F.when(F.col("text").isNotNull(), sp.redacted(F.col("text"), F.col("spans"))).alias("_new")).select(
        *[F.col("_new").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
