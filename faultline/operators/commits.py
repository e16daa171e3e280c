"""Commit-side operators: parse, classify, score and describe commits.

Each operator adds columns to a commits DataFrame row by row (no shuffle), so a
chain of them runs as one scan stage.  Input columns: commit_hash, author,
email, date, committer_date, subject, body, files_changed array<string>,
file_changes array<struct>, diff_content, insertions, deletions, is_merge.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sqltext as sq, text as tf, versions as vf
from ..rules import commit_rules as cr, taxonomy as tx

_C = F.col


def _message() -> Column:
    return F.concat_ws(" ", F.coalesce(_C("subject"), F.lit("")), F.coalesce(_C("body"), F.lit("")))


def _diff_lines() -> Column:
    return F.split(F.coalesce(_C("diff_content"), F.lit("")), "\n")


def split_message(df: DataFrame, message: str = "message") -> DataFrame:
    """Commit message to (subject = first line, body = the whole message)."""
    return (df.withColumn("subject", F.substring_index(_C(message), "\n", 1))
            .withColumn("body", _C(message)))


def join_diffs(df: DataFrame) -> DataFrame:
    """diff_content = the non-empty per-file diffs joined by newlines."""
    diffs = F.filter(F.transform(_C("file_changes"), lambda f: f["diff"]),
                     lambda d: F.coalesce(d, F.lit("")) != "")
    return df.withColumn("diff_content", F.array_join(diffs, "\n"))


def changed_files(df: DataFrame) -> DataFrame:
    """files_changed, file_changes, insertions and deletions of a commit's unified diff.

    A file's section begins at its "diff --git" line and is named by its new path (the old one of a deleted file).  Lines count
    within hunks, so the file headers do not.  Merges and empty diffs have no files.
    """
    sections = F.filter(F.split(F.concat(F.lit("\n"), F.coalesce(_C("diff_content"), F.lit(""))), r"\ndiff --git "), lambda s: F.contains(s, F.lit(" b/")))

    def change(section: Column) -> Column:
        lines = F.split(section, "\n")
        hunks = F.slice(lines, F.greatest(F.coalesce(F.array_position(F.transform(lines, lambda l: l.startswith("@@")), True), F.lit(0)), F.lit(1)).cast("int"),
                        F.size(lines))
        body = F.when(F.contains(section, F.lit("\n@@")), hunks).otherwise(F.array().cast("array<string>"))
        count = lambda sign: F.size(F.filter(body, lambda l: l.startswith(sign)))
        gone = F.contains(section, F.lit("\n+++ /dev/null"))
        name = F.when(gone, F.regexp_extract(section, r"^a/(.*) b/", 1)).otherwise(F.regexp_extract(section, r"^.* b/(.*)", 1))
        return F.struct(name.alias("filename"), F.lit(0).alias("complexity"), F.array().cast("array<string>").alias("methods"),
                        F.transform(F.filter(body, lambda l: l.startswith("+")), lambda l: F.substring(l, F.lit(2), F.length(l))).alias("diff_parsed_added"),
                        count("+").alias("added_lines"), count("-").alias("deleted_lines"), F.concat(F.lit("diff --git "), section).alias("diff"))
    total = lambda name: F.aggregate(F.col("file_changes"), F.lit(0), lambda a, f: a + f[name])
    return (df.withColumn("file_changes", F.transform(sections, change))
            .withColumns({"files_changed": F.transform("file_changes", lambda f: f["filename"]),
                          "insertions": total("added_lines"), "deletions": total("deleted_lines")}))


def extract_keywords(df: DataFrame) -> DataFrame:
    """References, CVE ids, Cc: stable and person tags, in that order."""
    text = F.concat(F.coalesce(_C("subject"), F.lit("")), F.lit("\n"), F.coalesce(_C("body"), F.lit("")))

    def tagged(tag: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.concat(F.lit(tag + ":"), v))
    parts = [tagged(p, F.regexp_extract_all(text, F.lit(rf"(?i){p}:\s*([0-9a-f]+)"), 1))
             for p in tx.REFERENCE_PREFIXES]
    parts.append(F.regexp_extract_all(text, F.lit("(" + tx.CVE_PATTERN + ")"), 1))
    parts.append(F.when(text.rlike(r"(?i)Cc:\s*stable"), F.array(F.lit("Cc:stable")))
                 .otherwise(F.array().cast("array<string>")))
    for p in tx.PERSON_TAGS:
        names = F.filter(F.transform(F.regexp_extract_all(text, F.lit(rf"(?i){p}:\s*([^\n<]+)"), 1), tf.strip),
                         lambda n: F.length(n) > 2)
        parts.append(tagged(p, names))
    return df.withColumn("keywords", F.concat(*parts))


def extract_fix_tags(df: DataFrame) -> DataFrame:
    """Whole-word, case-insensitive tag hits, in table order."""
    src = df.withColumn("_msg", _message()).withColumn("_low", F.lower("_msg"))
    # a word's letters are looked for before the regex is tried, and in it before the sign in front of them
    tags = [F.when(F.contains(_C("_low"), F.lit(w.lower())) & _C("_msg").rlike(rf"(?i){w}(?<![{tf.WORD}]{w})(?![{tf.WORD}])"), F.lit(label))
            for w, label in tx.FIX_TAG_WORDS]
    return src.withColumn("fix_tags", F.array_compact(F.array(*tags))).drop("_msg", "_low")


def extract_functions(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Changed functions: parser-supplied methods, else names from three line shapes of the diff (``limit``: the first ones)."""
    methods = F.filter(F.array_distinct(F.flatten(F.transform(
        F.coalesce(_C("file_changes"), F.array().cast(_schema_of(df, "file_changes"))),
        lambda f: F.coalesce(f["methods"], F.array().cast("array<string>"))))),
        lambda m: F.coalesce(m, F.lit("")) != "")
    ident = "[a-zA-Z_][a-zA-Z0-9_]*"
    shapes = [rf"^{ident}\s+\*?{ident}\s*\([^)]*\)", rf"^{ident}\s*\([^)]*\)\s*\{{",
              rf"^\s*=\s*{ident}\s*\("]
    names = F.flatten(F.transform(_diff_lines(), lambda line: F.array(*[
        F.regexp_extract(F.regexp_extract(line, s, 0), ident, 0) for s in shapes])))
    found = F.array_distinct(F.filter(names, lambda n: n != ""))
    return df.withColumn("functions", upto(F.when(F.size(methods) > 0, methods).otherwise(found), limit))


def _schema_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def parse_subject(df: DataFrame) -> DataFrame:
    s = _C("subject")
    has = F.contains(s, F.lit(":"))
    return (df.withColumn("subject_prefix", F.when(has, tf.strip(F.substring_index(s, ":", 1))).otherwise(F.lit("")))
            .withColumn("subject_text", F.when(has, tf.strip(F.expr("substr(subject, instr(subject, ':') + 1)")))
                        .otherwise(s)))


def flag_fix_commit(df: DataFrame) -> DataFrame:
    return df.withColumn("is_fix", tf.any_contains(F.lower(_message()), tx.FIX_COMMIT_WORDS))


def detect_subsystem(df: DataFrame) -> DataFrame:
    """Subject prefix, then path prefixes (subsystem-major), then first path segment."""
    names = [n for n, _ in tx.SUBSYSTEM_PATHS]
    files = F.coalesce(_C("files_changed"), F.array().cast("array<string>"))
    prefix = tf.strip(F.substring_index(_C("subject"), ":", 1))
    by_subject = F.when(F.contains(_C("subject"), F.lit(":")) & prefix.isin(names), prefix)

    def any_file(starts: list[str]) -> Column:
        return F.exists(files, lambda f: reduce(lambda a, b: a | b, [f.startswith(p) for p in starts]))
    by_path = None
    for name, starts in tx.SUBSYSTEM_PATHS:
        cond = any_file(starts)
        by_path = F.when(cond, F.lit(name)) if by_path is None else by_path.when(cond, F.lit(name))
    heads = F.filter(F.transform(files, lambda f: F.substring_index(f, "/", 1)), lambda h: h.isin(names))
    out = F.coalesce(by_subject, by_path, F.get(heads, 0), F.lit("unknown"))
    return df.withColumn("subsystem", F.when(F.size(files) == 0, F.lit("unknown")).otherwise(out))


def subsystem_hierarchy(subsystem: Column) -> Column:
    """[self, parent?]; empty for 'unknown'."""
    parent = tf.lookup(subsystem, tx.COLLECTOR_PARENTS)
    return F.when(subsystem == "unknown", F.array().cast("array<string>")).otherwise(
        F.array_compact(F.array(subsystem, parent)))


def guess_subsystem(df: DataFrame, text: str, out: str = "guess") -> DataFrame:
    """Subsystem with the most content keywords in column ``text``."""
    return (df.withColumn("_low", F.lower(_C(text)))
            .withColumn(out, tf.most_hits("_low", tx.SUBSYSTEM_CONTENT_KEYWORDS)).drop("_low"))


def detect_bug_type(df: DataFrame) -> DataFrame:
    return (df.withColumn("_low", F.lower(_message()))
            .withColumn("bug_type", tf.first_group("_low", tx.BUG_TYPE_KEYWORDS, relabel=tf.normalize_bug_label))
            .drop("_low"))


def detect_all_bug_types(df: DataFrame) -> DataFrame:
    return (df.withColumn("_low", F.lower(_message()))
            .withColumn("bug_types", tf.all_groups("_low", tx.BUG_TYPE_KEYWORDS, relabel=tf.normalize_bug_label))
            .drop("_low"))


def added_lines(df: DataFrame) -> DataFrame:
    """Added code lines: parser-supplied lines if any, else '+' lines of the diff."""
    parsed = F.flatten(F.transform(
        F.coalesce(_C("file_changes"), F.array().cast(_schema_of(df, "file_changes"))),
        lambda f: F.coalesce(f["diff_parsed_added"], F.array().cast("array<string>"))))
    plus = F.transform(F.filter(_diff_lines(), lambda l: l.startswith("+") & ~l.startswith("+++")),
                       lambda l: F.substring(l, F.lit(2), F.length(l)))
    return df.withColumn("added_lines", F.when(F.size(parsed) > 0, parsed).otherwise(plus))


def fix_evidence(df: DataFrame) -> DataFrame:
    """lock_added, refcount_fix, rcu_fix from added lines and message patterns."""
    src = df if "added_lines" in df.columns else added_lines(df)
    src = src.withColumns({"_code": F.lower(F.array_join(_C("added_lines"), "\n")), "_msg": F.lower(_message())})
    # a regex is tried where the longest piece that its matches hold occurs
    anchored = lambda patterns: F.expr("(" + " OR ".join(f"({sq.contained('_msg', sq.anchor(p))}_msg RLIKE {sq.lit(p)})" for p in patterns) + ")")
    return src.withColumns({
        "lock_added": tf.any_contains("_code", tx.LOCK_KEYWORDS),
        "refcount_fix": tf.any_contains("_code", tx.REFCOUNT_KEYWORDS) | anchored(tx.REFCOUNT_PATTERNS),
        "rcu_fix": tf.any_contains("_code", tx.RCU_KEYWORDS) | anchored(tx.RCU_PATTERNS),
    }).drop("_code", "_msg")


def importance_score(df: DataFrame) -> DataFrame:
    """Bug base + fix evidence + size + CVE + complexity + merge, capped at 10."""
    base = F.coalesce(F.try_element_at(F.create_map(
        *[F.lit(x) for kv in tx.BUG_BASE_SCORES.items() for x in kv]), _C("bug_type")), F.lit(0.0))
    n_files = F.coalesce(F.size("files_changed"), F.lit(0))
    changes = F.coalesce(_C("insertions"), F.lit(0)) + F.coalesce(_C("deletions"), F.lit(0))
    cve = F.exists("fix_tags", lambda t: F.contains(F.upper(t), F.lit("CVE")))
    cx = F.coalesce(F.array_max(F.transform("file_changes", lambda f: f["complexity"])), F.lit(0))
    score = (base + F.when(_C("lock_added"), 2.0).otherwise(0.0) + F.when(_C("refcount_fix"), 3.0).otherwise(0.0)
             + F.when(_C("rcu_fix"), 3.0).otherwise(0.0) + F.least(n_files * 0.5, F.lit(5.0))
             + F.least(changes / 100, F.lit(3.0)) + F.when(cve, 10.0).otherwise(0.0)
             + F.when(cx > 50, 2.0).when(cx > 20, 1.0).otherwise(0.0)
             + F.when(_C("is_merge"), 0.5).otherwise(0.0))
    return df.withColumn("score", F.round(F.least(score, F.lit(10.0)), 2))


def analyze_commits(df: DataFrame) -> DataFrame:
    """The whole commit analysis: subsystem, bug type, tags, functions, evidence, score."""
    for step in (detect_subsystem, detect_bug_type, extract_fix_tags, extract_functions, added_lines,
                 fix_evidence, importance_score):
        df = df.transform(step)
    return df


def upto(items: Column, n: int | None) -> Column:
    """The first ``n`` items; all of them without a limit."""
    return items if n is None else F.slice(items, 1, n)


def _join(items: Column, n: int | None = None, sep: str = ", ") -> Column:
    return F.array_join(upto(items, n), sep)


def _py_bool(c: Column) -> Column:
    return F.when(c, F.lit("True")).otherwise(F.lit("False"))


def embedding_text_simple(df: DataFrame) -> DataFrame:
    """Plain labelled text of an analysed commit."""
    lines = [F.concat(F.lit("Title: "), _C("subject")), F.concat(F.lit("Subsystem: "), _C("subsystem")),
             F.concat(F.lit("BugType: "), _C("bug_type")),
             F.concat(F.lit("Files: "), _join(_C("files_changed"))),
             F.concat(F.lit("CommitMessage: "), _C("body")),
             F.concat(F.lit("FixTags: "), F.array_join("fix_tags", ", ")),
             F.concat(F.lit("LockAdded: "), _py_bool(_C("lock_added"))),
             F.concat(F.lit("RCUFix: "), _py_bool(_C("rcu_fix"))),
             F.concat(F.lit("RefcountFix: "), _py_bool(_C("refcount_fix")))]
    return df.withColumn("embedding_text", F.concat_ws("\n", *lines))


def apply_template(df: DataFrame) -> DataFrame:
    """Template layer: root cause (subsystem-specific when known), severity, typical fix, CVE tags."""
    t = F.when(_C("bug_type").isin(list(cr.BUG_TEMPLATES)), _C("bug_type")).otherwise(F.lit("unknown"))
    hints = {f"{b}/{s}": text for b, (_, _, _, h) in cr.BUG_TEMPLATES.items() for s, text in h.items()}
    sev = F.create_map(*[F.lit(x) for b, v in cr.BUG_TEMPLATES.items() for x in (b, v[1])])
    return (df.withColumn("root_cause", F.coalesce(
        tf.lookup(F.concat_ws("/", t, _C("subsystem")), hints),
        tf.lookup(t, {b: v[0] for b, v in cr.BUG_TEMPLATES.items()})))
        .withColumn("severity", F.element_at(sev, t))
        .withColumn("typical_fix", tf.lookup(t, {b: v[2] for b, v in cr.BUG_TEMPLATES.items()}))
        .withColumn("cves", F.filter("fix_tags", lambda x: F.upper(x).startswith("CVE")))
        .withColumn("confidence", F.lit(0.80)))


def score_diff_rules(df: DataFrame, rules: list = cr.DIFF_RULES) -> DataFrame:
    """Best diff rule per commit: one projection over literal rules, no row multiplication.

    Adds ``diff_rule`` and ``diff_score`` (null/0 when no rule scores above 0).
    """
    plus = F.array_join(F.filter(_diff_lines(), lambda l: l.startswith("+") & ~l.startswith("+++")), "\n")
    minus = F.array_join(F.filter(_diff_lines(), lambda l: l.startswith("-") & ~l.startswith("---")), "\n")
    src = df.withColumns({"_plus": plus, "_minus": minus, "_msg": F.lower(_message())})
    scored = []
    for i, (name, req_p, req_m, opt_p, min_hits, hints, _, _) in enumerate(rules):
        parts, gates = [], []
        for words, col, weight in ((req_p, "_plus", 3), (req_m, "_minus", 2)):
            if words:
                gates.append(sq.any_contains(col, words))
                parts.append(f"{weight} * {sq.count_hits(col, words)}")
        if opt_p:
            hits = sq.count_hits("_plus", opt_p)
            parts.append(f"CASE WHEN {hits} >= {min_hits} THEN {hits} ELSE 0 END")
        if hints:
            parts.append(f"CASE WHEN {sq.any_contains('_msg', hints)} THEN 2 ELSE -1 END")
        total = f"CASE WHEN {' AND '.join(gates)} THEN {' + '.join(parts)} ELSE 0 END"
        scored.append(f"named_struct('s', {total}, 'o', {-i}, 'r', {sq.lit(name)})")
    src = src.withColumn("_best", F.array_max(F.expr(sq.arr(scored))))
    hit = (F.coalesce(_C("diff_content"), F.lit("")) != "") & (_C("_best.s") > 0)
    return (src.withColumn("diff_rule", F.when(hit, _C("_best.r")))
            .withColumn("diff_score", F.when(hit, _C("_best.s")).otherwise(0))
            .drop("_plus", "_minus", "_msg", "_best"))


def apply_diff_rule(df: DataFrame) -> DataFrame:
    """Override root cause, fix pattern and confidence by the best diff rule."""
    hit = _C("diff_rule").isNotNull()
    return (df.withColumn("root_cause", F.coalesce(tf.lookup(_C("diff_rule"), {r[0]: r[6] for r in cr.DIFF_RULES}),
                                                   _C("root_cause")))
            .withColumn("fix_pattern", F.coalesce(tf.lookup(_C("diff_rule"), {r[0]: r[7] for r in cr.DIFF_RULES}),
                                                  F.lit("")))
            .withColumn("confidence", F.when(hit, F.least(F.lit(0.95), 0.80 + _C("diff_score") * 0.03))
                        .otherwise(_C("confidence")))
            .withColumn("evidence", F.when(hit, F.array(F.concat(
                F.lit("diff_rule:"), _C("diff_rule"), F.lit("(score="), _C("diff_score").cast("string"),
                F.lit(")")))).otherwise(F.array().cast("array<string>"))))


def adjust_confidence(df: DataFrame) -> DataFrame:
    """Confidence bonuses, then the message fallback for weak unknown commits."""
    def bonus(cond: Column, v: float) -> Column:
        return F.when(cond, v).otherwise(0.0)
    n = sum((F.coalesce(_C(c), F.lit(False)).cast("int") for c in ("lock_added", "refcount_fix", "rcu_fix")),
            F.lit(0))
    conf = (_C("confidence") + bonus(_C("bug_type") != "unknown", 0.05) + bonus(_C("subsystem") != "unknown", 0.02)
            + n * 0.03 + bonus(F.exists("fix_tags", lambda t: F.contains(F.lower(t), F.lit("cve"))), 0.05)
            + bonus(F.exists("fix_tags", lambda t: F.contains(t, F.lit("fixes:"))), 0.03))
    return message_fallback(df.withColumn("confidence", F.round(F.least(F.lit(0.98), conf), 4)))


def message_fallback(df: DataFrame, limit: float = 0.60) -> DataFrame:
    """First matching message group for unknown commits below ``limit`` confidence."""
    group = sq.first_of([(sq.any_rlike("_msg", patterns), f"named_struct('bug', {sq.lit(bug)}, 'cause', {sq.lit(cause)})")
                         for patterns, bug, cause in cr.MESSAGE_FALLBACK], "NULL")
    weak = (_C("confidence") < limit) & (_C("bug_type") == "unknown")
    src = df.withColumn("_msg", F.lower(_message())).withColumn("_fb", F.when(weak, F.expr(group))).drop("_msg")
    hit = _C("_fb").isNotNull()
    return (src.withColumn("bug_type", F.when(hit, _C("_fb.bug")).otherwise(_C("bug_type")))
            .withColumn("root_cause", F.when(hit, _C("_fb.cause")).otherwise(_C("root_cause")))
            .withColumn("confidence", F.when(hit, F.lit(0.55)).otherwise(_C("confidence")))
            .withColumn("evidence", F.when(hit, F.array_append(
                "evidence", F.lit("fallback:keyword_match_from_message"))).otherwise(_C("evidence")))
            .drop("_fb"))


def build_root_cause(df: DataFrame) -> DataFrame:
    """Template, diff rules and confidence in one pass over analysed commits."""
    for step in (apply_template, score_diff_rules, apply_diff_rule, adjust_confidence):
        df = df.transform(step)
    return df


def key_diff_lines(diff: Column, n: int | None = None, words: list[str] = tx.KEY_LINE_WORDS,
                   skip_header: bool = True) -> Column:
    """The '+' lines holding a fix keyword, stripped (``n``: the first ones)."""
    pattern = "(?i)" + "|".join(sorted({re.escape(w) for w in words}))

    def keep(l: Column) -> Column:
        plus = l.startswith("+") & ~l.startswith("+++") if skip_header else l.startswith("+")
        return plus & l.rlike(pattern)
    lines = F.filter(F.split(F.coalesce(diff, F.lit("")), "\n"), keep)
    return F.array_join(F.transform(upto(lines, n), lambda l: tf.strip(F.substring(l, F.lit(2), F.length(l)))), "\n")


def embedding_text(df: DataFrame) -> DataFrame:
    """Symmetric embedding text of a commit with its root-cause summary."""
    def line(label: str, value: Column, cond: Column | None = None) -> Column:
        out = F.concat(F.lit(label), value)
        return out if cond is None else F.when(cond, out)
    diff = F.coalesce(_C("diff_content"), F.lit(""))
    keys = key_diff_lines(_C("diff_content"))
    parts = [line("BugType: ", _C("bug_type")), line("Subsystem: ", _C("subsystem")),
             line("RootCause: ", _C("root_cause")), line("FixPattern: ", _C("fix_pattern"), _C("fix_pattern") != ""),
             F.when(_C("lock_added"), F.lit("FixAction: lock synchronization added")),
             F.when(_C("refcount_fix"), F.lit("FixAction: reference count correction applied")),
             F.when(_C("rcu_fix"), F.lit("FixAction: RCU synchronization/protection fix applied")),
             line("CommitTitle: ", _C("subject"), _C("subject") != ""),
             line("CommitMessage: ", _C("body"), _C("body") != ""),
             line("ModifiedFiles: ", _join(_C("files_changed")), F.size("files_changed") > 0),
             line("Tags: ", _join(_C("fix_tags")), F.size("fix_tags") > 0),
             line("CVEs: ", _join(_C("cves")), F.size("cves") > 0),
             F.when(_C("severity") >= 8, F.concat(F.lit("Severity: Critical (level "),
                                                  _C("severity").cast("string"), F.lit(")"))),
             line("KeyDiffLines:\n", keys, (diff != "") & (keys != ""))]
    return df.withColumn("embedding_text", F.concat_ws("\n", *parts))


def embedding_text_routed(df: DataFrame, use_root_cause: bool = True) -> DataFrame:
    """Root-cause text, or the simple text with its own key lines appended."""
    if use_root_cause:
        return embedding_text(df)
    keys = key_diff_lines(_C("diff_content"), None, tx.KEY_LINE_WORDS_SIMPLE, skip_header=False)
    return embedding_text_simple(df).withColumn("embedding_text", F.concat_ws(
        "\n", "embedding_text", F.when(keys != "", F.concat(F.lit("KeyDiffLines:\n"), keys))))


def to_crash_feature(df: DataFrame) -> DataFrame:
    """A commit seen as a crash: message as panic text, no trace."""
    empty = F.array().cast("array<string>")
    return df.select(
        "commit_hash", empty.alias("call_trace"), F.coalesce(tf.non_empty(_C("subsystem")), F.lit("unknown")).alias("subsystem"),
        F.coalesce(tf.non_empty(_C("bug_type")), F.lit("unknown")).alias("bug_type"), F.lit("").alias("kernel_version"),
        empty.alias("modules"),
        F.when(F.coalesce(_C("body"), F.lit("")) != "", F.concat_ws("\n", "subject", "body"))
        .otherwise(_C("subject")).alias("panic_msg"), F.lit("").alias("rip_function"))


def diff_preview(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Readable preview assembled from index metadata (raw diffs are not stored).

    ``limit``: the first files, functions and tags, with the number of the others.
    """
    n_fc = F.coalesce(F.size("file_changes"), F.lit(-1))
    from_changes = F.transform(upto(_C("file_changes"), limit), lambda f: F.concat(
        F.lit("  "), f["filename"], F.lit(" (+"), f["added_lines"].cast("string"), F.lit("/-"),
        f["deleted_lines"].cast("string"), F.lit(")")))
    more = F.lit(None).cast("string") if limit is None else F.when(
        n_fc > limit, F.concat(F.lit("  ... and "), (n_fc - limit).cast("string"), F.lit(" more files")))
    files = F.when(n_fc > 0, F.concat_ws("\n", F.array_join(from_changes, "\n"), more)).otherwise(
        tf.non_empty(F.array_join(F.transform(upto(_C("files_changed"), limit), lambda f: F.concat(F.lit("  "), f)), "\n")))
    n_fn = F.size("functions")
    feats = F.array_compact(F.array(*[F.when(_C(c), F.lit(c)) for c in ("lock_added", "refcount_fix", "rcu_fix")]))
    kv = tf.non_empty(F.coalesce(_C("kernel_version"), F.lit("")))
    ins, dele = F.coalesce("insertions", F.lit(0)), F.coalesce("deletions", F.lit(0))
    info = F.concat_ws(" | ", F.concat(F.lit("v"), kv), F.when((ins != 0) | (dele != 0), F.concat(
        F.lit("+"), ins.cast("string"), F.lit("/-"), dele.cast("string"))))
    text = F.concat_ws(
        "\n", F.concat(F.lit("Modified files:\n"), files),
        F.when(n_fn > 0, F.concat(F.lit("Functions: "), _join(_C("functions"), limit), F.lit("") if limit is None else F.when(
            n_fn > limit, F.concat(F.lit(" ... (+"), (n_fn - limit).cast("string"), F.lit(" more)"))).otherwise(F.lit("")))),
        F.when(F.size("fix_tags") > 0, F.concat(F.lit("Tags: "), _join(_C("fix_tags"), limit))),
        F.when(F.size(feats) > 0, F.concat(F.lit("Fix features: "), F.array_join(feats, ", "))),
        tf.non_empty(info),
        F.when(F.coalesce(_C("body"), F.lit("")) != "", F.concat(F.lit("\nCommit message:\n"), _C("body"))))
    return df.withColumn("diff_preview", F.when(text != "", text).otherwise(
        F.lit("(diff not available - raw diff not stored in index)")))


def annotate_version(df: DataFrame) -> DataFrame:
    """Back-fill kernel_version columns on rows that lack them, by committer date or date."""
    date = F.coalesce(tf.non_empty(_C("committer_date")), _C("date"))
    src = df.withColumn("_v", vf.resolve_version(date))
    had = {c: (_C(c) if c in df.columns else F.lit(None)) for c in
           ("kernel_version", "kernel_version_major", "kernel_version_minor", "kernel_version_patch")}
    keep = F.coalesce(had["kernel_version"].cast("string"), F.lit("")) != ""
    new = {"kernel_version": vf.version_string(_C("_v.major"), _C("_v.minor")),
           "kernel_version_major": _C("_v.major"), "kernel_version_minor": _C("_v.minor"),
           "kernel_version_patch": F.when(_C("_v").isNotNull(), F.lit(0))}
    return src.withColumns({c: F.when(keep, had[c]).otherwise(new[c]) for c in new}).drop("_v")


def metadata_projection(df: DataFrame) -> DataFrame:
    """The index metadata schema: everything but e-mail, raw diffs and parent hashes."""
    return df.drop("email", "diff_content", "parent_hashes", "added_lines").withColumn(
        "file_changes", F.transform("file_changes", lambda f: f.dropFields("diff_parsed_added"))
        if "file_changes" in df.columns else F.lit(None))


def to_json_row(df: DataFrame) -> DataFrame:
    return df.select("commit_hash", F.to_json(F.struct(*df.columns)).alias("json"))


def from_json_row(df: DataFrame, schema) -> DataFrame:
    """Parse rows written by :func:`to_json_row`; fields outside ``schema`` are ignored."""
    return df.select(F.from_json("json", schema).alias("r")).select("r.*")


# --- lookups over a commit source -------------------------------------------------------------

def by_hash(df: DataFrame, commit_hash: str) -> DataFrame:
    return df.where(_C("commit_hash") == commit_hash)


def since_date(df: DataFrame, day: str) -> DataFrame:
    return df.where(_C("date") >= day)


def by_author(df: DataFrame, pattern: str) -> DataFrame:
    """Case-insensitive substring of author or e-mail."""
    p = F.lit(pattern.lower())
    return df.where(F.contains(F.lower("author"), p) | F.contains(F.lower("email"), p))


def commit_history(df: DataFrame) -> DataFrame:
    return df.select("commit_hash", "date", "subject")
