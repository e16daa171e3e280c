"""Kernel-version columns: as-of release lookup, parsing, distance and weights."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..rules.taxonomy import KERNEL_RELEASES


def iso_day(date: Column) -> Column:
    """The 10-character day prefix when it is a valid calendar date, else null."""
    day = F.substring(date, 1, 10)
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(day, "yyyy-MM-dd").isNotNull(), day)


def next_version(major: Column, minor: Column) -> Column:
    roll = minor >= 19
    return F.struct(F.when(roll, major + 1).otherwise(major).alias("major"),
                    F.when(roll, F.lit(0)).otherwise(minor + 1).alias("minor"))


def _release_case(day: Column, strict: bool, value) -> Column:
    """CASE over the fixed releases, newest first: ``value(major, minor)`` of the first one before
    (``strict``) or on/before ``day``; null when there is none.  An as-of lookup without a join."""
    out = F
    for a, b, d in KERNEL_RELEASES:
        major, minor = value(a, b)
        out = out.when((day > d) if strict else (day >= d), F.struct(F.lit(major).alias("major"), F.lit(minor).alias("minor")))
    return out


def _following(major: int, minor: int) -> tuple[int, int]:
    return (major + 1, 0) if minor >= 19 else (major, minor + 1)


def resolve_version(date: Column) -> Column:
    """First release that can contain a commit of this date: struct(major, minor), null if invalid."""
    day = iso_day(date)
    first = KERNEL_RELEASES[-1]
    oldest = F.struct(F.lit(first[0]).alias("major"), F.lit(first[1]).alias("minor"))
    return F.when(day.isNotNull(), _release_case(day, True, _following).otherwise(oldest))


def version_string(major: Column, minor: Column) -> Column:
    return F.concat(major.cast("string"), F.lit("."), minor.cast("string"), F.lit(".0"))


def normalize_version(raw: Column) -> Column:
    """First ``d.d`` as 'major.minor.0'; null when absent or a part exceeds 99."""
    a = F.try_to_number(F.regexp_extract(raw, r"(\d+)\.(\d+)", 1), F.lit("999999999999")).cast("int")
    b = F.try_to_number(F.regexp_extract(raw, r"(\d+)\.(\d+)", 2), F.lit("999999999999")).cast("int")
    return F.when((a <= 99) & (b <= 99), version_string(a, b))


def version_part(version: Column, index: int) -> Column:
    """Integer part of a dotted version, null unless that part is a plain integer."""
    part = F.trim(F.get(F.split(version, r"\."), index))
    return F.when(part.rlike(r"^[+-]?\d+$"), part.try_cast("int"))


def parse_version(version: Column) -> Column:
    """struct(major, minor, patch); a missing part is 0, a bad part makes the result null."""
    n = F.size(F.split(F.trim(version), r"\."))
    parts = [version_part(version, i) if i == 0 else
             F.when(n <= i, F.lit(0)).otherwise(version_part(version, i)) for i in range(3)]
    ok = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    return F.when(ok, F.struct(*[p.alias(a) for p, a in zip(parts, ("major", "minor", "patch"))]))


def parse_release(version: Column) -> Column:
    """Lenient triple: drops a non-digit prefix and an -rcN suffix."""
    v = F.regexp_replace(F.regexp_replace(version, r"^[^\d]*", ""), r"-rc\d+.*", "")
    return parse_version(v)


def compare_versions(a: Column, b: Column) -> Column:
    x, y = parse_release(a), parse_release(b)
    return F.when(x < y, F.lit(-1)).when(x > y, F.lit(1)).when(x == y, F.lit(0))


def version_distance(major1: Column, minor1: Column, major2: Column, minor2: Column) -> Column:
    return (major1 - major2) * 1000 + (minor1 - minor2)


def version_weight(distance: Column) -> Column:
    return (F.when(distance == 0, F.lit(1.30)).when(distance.between(1, 2), F.lit(1.15))
            .when(distance.between(3, 5), F.lit(1.00)).when(distance >= 6, F.lit(0.70))
            .when(distance < 0, F.lit(1.00)).otherwise(F.lit(0.90)))


def date_compatible(date: Column, major: Column, minor: Column, tolerance: int = 1) -> Column:
    """Tri-state: can a commit of this date apply to the target release?  Null = cannot tell."""
    rel = _release_case(F.substring(date, 1, 10), False, lambda a, b: (a, b))
    def verdict(r: Column) -> Column:
        return (F.when((F.coalesce(date, F.lit("")) == "") | r.isNull(), F.lit(None).cast("boolean"))
                .when(r["major"] - major > 1, F.lit(False))
                .when(r["major"] > major, F.lit(None).cast("boolean"))
                .when(r["major"] == major, r["minor"] <= minor + tolerance)
                .otherwise(F.lit(True)))
    # the release is looked up once, however often the verdict reads it
    return F.element_at(F.transform(F.array(rel), verdict), 1)


def release_date(major: Column, minor: Column) -> Column:
    table = F.create_map(*[F.lit(x) for a, b, d in KERNEL_RELEASES for x in (f"{a}.{b}", d)])
    return F.try_element_at(table, F.concat_ws(".", major.cast("string"), minor.cast("string")))
