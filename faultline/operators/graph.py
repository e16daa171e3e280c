"""Knowledge lookups: subsystem graph, lock rules, bug patterns.

The tables are fixed and tiny, so lookups are literal maps inside the row's
projection; edge tables are also offered as DataFrames for joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import sqltext as sq, text as tf
from ..plans.stage import cut
from ..rules import knowledge as kn

_C = F.col


def _empty() -> Column:
    return F.array().cast("array<string>")


def _list_map(table: dict[str, list[str]]) -> Column:
    return F.expr(sq.map_of(table))


def _members(key: Column, table: dict[str, list[str]]) -> Column:
    return F.coalesce(F.try_element_at(_list_map(table), key), _empty())


def parent_table() -> dict[str, str]:
    """child -> first parent listing it."""
    out: dict[str, str] = {}
    for parent, children in kn.GRAPH_HIERARCHY.items():
        for c in children:
            out.setdefault(c, parent)
    return out


def edges(spark: SparkSession) -> DataFrame:
    """Edge table (kind, src, dst): parent, coupled, calls."""
    rows = [(kind, s, d) for kind, t in (("parent", kn.GRAPH_HIERARCHY), ("coupled", kn.GRAPH_COUPLED),
                                         ("calls", kn.GRAPH_CALLS)) for s, ds in t.items() for d in ds]
    return spark.createDataFrame(rows, "kind string, src string, dst string")


def subsystem_title(s: Column) -> Column:
    return tf.lookup(s, {r[0]: r[1] for r in kn.SUBSYSTEMS})


def children(s: Column) -> Column:
    return _members(s, kn.GRAPH_HIERARCHY)


def parent(s: Column) -> Column:
    return tf.lookup(s, parent_table())


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth): all ancestors of every node of an edge table (node, parent), of any depth, nearest depth first.

    Each round joins the newest pairs with the edges and keeps those that are new, until there are none; a pair is kept once, so cycles end. A node
    on a cycle is not its own ancestor.
    """
    edges = cut(edges.where("node IS NOT NULL AND parent IS NOT NULL AND node <> parent").select("node", "parent").distinct())
    known = edges.select("node", _C("parent").alias("ancestor"), F.lit(1).alias("depth"))
    new, depth = known, 1
    step = edges.select(_C("node").alias("ancestor"), "parent")
    while True:
        depth += 1
        found = new.join(step, "ancestor").select("node", _C("parent").alias("ancestor")).where("node <> ancestor").distinct()
        new = cut(found.join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            return known
        known = cut(known.unionByName(new))


def _above(parents: dict[str, str]) -> dict[str, list[str]]:
    """Ancestors of every entry of a fixed table, nearest first, at any depth; a cycle is an error in the table."""
    out: dict[str, list[str]] = {}
    for child in parents:
        chain, at = [], parents.get(child)
        while at is not None:
            if at in chain or at == child:
                raise ValueError(f"{child} is on a cycle of the hierarchy")
            chain.append(at)
            at = parents.get(at)
        out[child] = chain
    return out


def ancestors(s: Column, parents: dict[str, str] | None = None) -> Column:
    """Nearest to farthest, at any depth of the hierarchy."""
    return F.coalesce(F.try_element_at(F.expr(sq.map_of(_above(parents or parent_table()))), s), _empty())


def related_subsystems(s: Column, include_children: bool = True) -> Column:
    """self ∪ coupled ∪ parent(+coupled) ∪ children(+coupled) ∪ callees, sorted."""
    p = parent(s)
    parts = [F.array(s), _members(s, kn.GRAPH_COUPLED), F.array_compact(F.array(p)),
             F.coalesce(F.try_element_at(_list_map(kn.GRAPH_COUPLED), p), _empty()), _members(s, kn.GRAPH_CALLS)]
    if include_children:
        below = {k: sorted({x for c in v for x in kn.GRAPH_COUPLED.get(c, [])}) for k, v in kn.GRAPH_HIERARCHY.items()}
        below = {k: v for k, v in below.items() if v}
        parts += [children(s), _members(s, below)]
    return F.sort_array(F.array_distinct(F.concat(*parts)))


def subsystem_of_path(path: Column) -> Column:
    """First subsystem with a matching path prefix (trailing slash dropped), else null."""
    out = None
    for name, _, prefixes, _, _ in kn.SUBSYSTEMS:
        cond = reduce(lambda a, b: a | b, [path.startswith(p.rstrip("/")) for p in prefixes])
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def subsystem_of_function(func: Column) -> Column:
    low = F.lower(func)
    out = None
    for name, _, _, funcs, _ in kn.SUBSYSTEMS:
        cond = tf.any_contains(low, [f.lower() for f in funcs])
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def subsystems_of_bug_type(bug: Column) -> Column:
    return F.array_compact(F.array(*[F.when(bug.isin(bugs), F.lit(n)) for n, _, _, _, bugs in kn.SUBSYSTEMS]))


def bug_pattern_key(bug: Column) -> Column:
    """Pattern lookup: exact, underscored lower case, then containment in table order."""
    low = F.translate(F.lower(bug), " ", "_")
    fuzzy = None
    for k in kn.BUG_PATTERNS:
        cond = F.contains(low, F.lit(k)) | F.contains(F.lit(k), low)
        fuzzy = F.when(cond, F.lit(k)) if fuzzy is None else fuzzy.when(cond, F.lit(k))
    keys = list(kn.BUG_PATTERNS)
    return F.coalesce(F.when(bug.isin(keys), bug), F.when(low.isin(keys), low), fuzzy)


def bug_pattern_list(key: Column, field: str) -> Column:
    """fixes / keywords / tools / subsystems / symptoms / causes / options of a pattern key; empty when unknown."""
    return _members(key, {k: p[field] for k, p in kn.BUG_PATTERNS.items()})


def bug_patterns(spark: SparkSession, category: str | None = None) -> DataFrame:
    rows = [(k, p["name"], p["severity"], p["category"], p["symptoms"], p["fixes"], p["keywords"], p["tools"],
             p["subsystems"]) for k, p in kn.BUG_PATTERNS.items()]
    df = spark.createDataFrame(rows, "bug_type string, name string, severity string, category string, symptoms "
                                     "array<string>, fixes array<string>, keywords array<string>, tools array<string>, "
                                     "subsystems array<string>")
    return df.where(_C("category") == category) if category else df


def lock_type(name: Column) -> Column:
    """By type name, else first type with an API containing the given text."""
    low = F.lower(name)
    out = F.when(name.isin([t for t, _ in kn.LOCK_APIS]), name)
    for t, apis in kn.LOCK_APIS:
        out = out.when(reduce(lambda a, b: a | b, [F.contains(F.lit(a), low) for a in apis]), F.lit(t))
    return out


def lock_type_of_function(func: Column) -> Column:
    """First lock type with an API name inside the function name, else null."""
    low = F.lower(func)
    out = None
    for t, apis in kn.LOCK_APIS:
        cond = tf.any_contains(low, apis)
        out = F.when(cond, F.lit(t)) if out is None else out.when(cond, F.lit(t))
    return out


def lock_ordering(subsystem: Column) -> Column:
    return F.array_compact(F.array(*[F.when(subsystem.isin(subs), F.lit(i)) for i, _, subs in kn.LOCK_ORDERING]))


def lock_fix(kind: Column) -> Column:
    return F.coalesce(tf.lookup(kind, kn.LOCK_FIXES), F.lit(kn.LOCK_FIX_DEFAULT))


def deadlock_patterns(text: Column) -> Column:
    """Names of deadlock patterns by lockdep message, else by generic wording."""
    low = F.lower(text)
    exact = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(m)), F.lit(n)) for n, m, _ in kn.DEADLOCK_PATTERNS]))
    loose = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(n))
                                      for n, _, g in kn.DEADLOCK_PATTERNS if g]))
    return F.when(F.size(exact) > 0, exact).otherwise(loose)


def lock_usage(df: DataFrame, trace: str = "call_trace") -> DataFrame:
    """Lock acquisitions/releases (frame-major), lock types (sorted) and lock issues."""
    acquire = [(a, t) for t, apis in kn.LOCK_APIS for a in apis if "lock" in a and "unlock" not in a]
    release = [(a, t) for t, apis in kn.LOCK_APIS for a in apis if "unlock" in a or ("up_" in a and "lock" not in a)]

    def per_frame(pairs) -> Column:
        return F.expr(f"flatten(transform(_frames, f -> {sq.found_words('f', [a for a, _ in pairs])}))")
    pairs = acquire + release
    types = F.expr(sq.kept([(sq.any_contains("_text", [a for a, k in pairs if k == t]), sq.lit(t))
                            for t in sorted(t for t, _ in kn.LOCK_APIS)]))
    df = df.withColumns({"_text": F.lower(F.array_join(trace, "\n")), "_frames": F.transform(trace, F.lower)}).withColumns({
        "lock_types": types, "locks_acquired": per_frame(acquire), "locks_released": per_frame(release)}).drop("_text")
    has = lambda test: F.exists("_frames", test)
    sleeps = has(lambda f: tf.any_contains(f, ["schedule", "sleep"]))
    spin = F.arrays_overlap("lock_types", F.array(F.lit("spinlock"), F.lit("rwlock")))
    plain = has(lambda f: F.contains(f, F.lit("spin_lock")) & ~F.contains(f, F.lit("irq")))
    irq = has(lambda f: tf.any_contains(f, ["irq", "interrupt"]))
    rcu = has(lambda f: F.contains(f, F.lit("rcu_read_lock")))
    issues = [spin & sleeps, plain & irq, rcu & sleeps]
    return df.withColumn("lock_issues", F.array_compact(F.array(*[
        F.when(c, F.lit(t)) for c, t in zip(issues, kn.LOCK_ISSUES)]))).drop("_frames")


def lock_context(df: DataFrame, trace: str = "call_trace", width: int = 80) -> DataFrame:
    """``lock_usage`` with a text context for a prompt in ``lock_context``: lock types, acquisitions with their frames (``width`` characters, as the
    layout has it), issues.  All acquisitions are listed."""
    acquire = [a for _, apis in kn.LOCK_APIS for a in apis if "lock" in a and "unlock" not in a]
    said = sq.kept([(f"contains(lower(f), {sq.lit(a)})", f"concat({sq.lit(f'- `{a}()` in `')}, left(f, {width}), '`')") for a in acquire])
    titles = {t: f"- **{t}**: {name} — {use}" for t, (name, use) in kn.LOCK_TITLES.items()}
    part = lambda head, lines: F.when(F.size(lines) > 0, F.concat(F.lit(f"### {head}\n"), F.array_join(lines, "\n"), F.lit("\n")))
    df = lock_usage(df, trace)
    types = F.transform("lock_types", lambda t: F.element_at(F.expr(sq.map_of(titles)), t))
    nothing = F.when((F.size("lock_types") == 0) & (F.size("lock_issues") == 0), F.lit("*(No lock operations detected in call trace)*"))
    return df.withColumn("lock_context", F.concat_ws("\n", F.lit("## Lock Usage Analysis\n"), part("Lock Types Detected", types),
                         part("Lock Acquire Operations", F.expr(f"flatten(transform({trace}, f -> {said}))")),
                         part("⚠️ Potential Lock Issues", F.transform("lock_issues", lambda i: F.concat(F.lit("- **"), i, F.lit("**")))), nothing))


def subsystem_context(s: Column) -> Column:
    """Text context of a subsystem for a prompt."""
    def joined(i: int) -> Column:
        return tf.lookup(s, {r[0]: ", ".join(r[i]) for r in kn.SUBSYSTEMS})
    others = F.array_join(F.filter(related_subsystems(s), lambda r: r != s), ", ")
    body = F.concat(F.lit("## Subsystem: "), subsystem_title(s), F.lit(" ("), s, F.lit(")\n\n**Key Functions**: "),
                    joined(3), F.lit("\n**Common Bug Types**: "), joined(4),
                    F.lit("\n\n**Related Subsystems**: "), others)
    return F.coalesce(body, F.concat(F.lit("Subsystem '"), s, F.lit("' not found.")))


def bug_context(bug: Column) -> Column:
    """Text context of a bug pattern for a prompt."""
    texts = {}
    for k, p in kn.BUG_PATTERNS.items():
        items = lambda name: "\n".join("- " + x for x in p[name])
        texts[k] = (f"## {p['name']}\n**Severity**: {p['severity']}\n**Category**: {p['category']}\n\n"
                    f"### Typical Symptoms\n{items('symptoms')}\n\n### Common Causes\n{items('causes')}\n\n### Fix Patterns\n{items('fixes')}\n\n"
                    f"### Detection Tools\n{', '.join(p['tools'])}\n\n### Related Subsystems\n"
                    f"{', '.join(p['subsystems'])}")
    return F.coalesce(tf.lookup(bug_pattern_key(bug), texts),
                      F.concat(F.lit("Bug type '"), bug, F.lit("' not found in knowledge base.")))
