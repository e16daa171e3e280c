"""ANSI/DuckDB SQL for the registered queries, written set-wise over rule tables.

Rule tables enter as VALUES; logs are split into line rows; best-of rules use arg_min/arg_max.
"""

from __future__ import annotations

import re

from faultline.functions.text import normalize_bug_label
from faultline.plans import catalog as cat, views as vw
from faultline.rules import texts as say, commit_rules as cr, crash_rules as kr, knowledge as kn, taxonomy as tx

W = r"\p{L}\p{N}_"
Q = vw.quote
_CTE: dict[str, tuple[list[str], str]] = {}
_SQL: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: str, sql: str) -> None:
    _CTE[name.split("(")[0]] = (deps.split(), f"{name} AS ({sql})")


def oracle(name: str, deps: str, sql: str) -> None:
    _SQL[name] = (deps.split(), sql)


def v(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, list):
        return "[" + ", ".join(v(i) for i in x) + "]::VARCHAR[]"
    return Q(x)


def values(name: str, rows) -> None:
    cte(name, "", "VALUES " + ", ".join("(" + ", ".join(v(x) for x in r) + ")" for r in rows))


def case(key: str, table: dict, default="NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN {v(k)} THEN {v(x)}" for k, x in table.items()) + f" ELSE {default} END"


def words(table):
    """(ord, label, word) rows of a first-match table."""
    return [(i, label, w) for i, (label, ws) in enumerate(table) for w in ws]


def one_of(items) -> str:
    return "(" + ", ".join(v(x) for x in items) + ")"


SP = r"[\s\p{Z}\x0B\x1C-\x1F\x{0085}]"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SP}+', ''), '{SP}+$', '')"


# --- base views ---------------------------------------------------------------------------------

cte("commits", "", vw.ansi_view(vw.COMMIT_COLUMNS, "documents"))
cte("crashes", "", vw.ansi_view(vw.CRASH_COLUMNS, "events"))
cte("dumps", "", vw.ansi_view(vw.DUMP_COLUMNS, "orders"))
cte("answers", "", vw.ansi_view(vw.ANSWER_COLUMNS, "conversations"))
cte("msg", "commits", "SELECT *, concat(subject, ' ', body) AS m, lower(concat(subject, ' ', body)) AS lm FROM commits")

# --- commit side --------------------------------------------------------------------------------

oracle("s2_split_message", "commits", "SELECT doc_id, split_part(body, chr(10), 1) AS subject, md5(body) AS body_md5 FROM commits")
oracle("s8_by_author", "commits", "SELECT doc_id, author, email, date FROM commits WHERE lower(author) LIKE '%example.org%' OR lower(email) LIKE '%example.org%'")
oracle("s8_since_date", "commits", "SELECT doc_id, commit_hash, date FROM commits WHERE date >= '2020-01-01'")

_person = " || ".join(
    f"list_transform(list_filter(list_transform(regexp_extract_all(t, '(?i){p}:\\s*([^\\n<]+)', 1), lambda x: {strip('x')}), lambda x: length(x) > 2), lambda x: concat('{p}:', x))"
    for p in tx.PERSON_TAGS)
_refs = " || ".join(f"list_transform(regexp_extract_all(t, '(?i){p}:\\s*([0-9a-f]+)', 1), lambda x: concat('{p}:', x))" for p in tx.REFERENCE_PREFIXES)
oracle("p1_keywords", "commits", f"""SELECT doc_id, array_to_string({_refs} || regexp_extract_all(t, 'CVE-\\d{{4}}-\\d{{4,}}')
    || CASE WHEN regexp_matches(t, '(?i)Cc:\\s*stable') THEN ['Cc:stable'] ELSE [] END || {_person}, '|') AS keywords
    FROM (SELECT doc_id, concat(subject, chr(10), body) AS t FROM commits)""")

_tags = ", ".join(f"CASE WHEN regexp_matches(m, {v(f'(?i)(?:^|[^{W}]){w}(?:$|[^{W}])')}) THEN {v(l)} END" for w, l in tx.FIX_TAG_WORDS)
cte("p2", "msg", f"SELECT doc_id, list_filter([{_tags}], lambda x: x IS NOT NULL) AS fix_tags FROM msg")
oracle("p2_fix_tags", "p2", "SELECT doc_id, array_to_string(fix_tags, '|') AS fix_tags FROM p2")

_id = "[a-zA-Z_][a-zA-Z0-9_]*"
_shapes = [rf"^{_id}\s+\*?{_id}\s*\([^)]*\)", rf"^{_id}\s*\([^)]*\)\s*\{{", rf"^\s*=\s*{_id}\s*\("]
cte("dl", "commits", """SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM
    (SELECT doc_id, string_split(diff, chr(10)) AS ls FROM commits WHERE diff IS NOT NULL)""")
cte("p3", "commits dl", f"""SELECT c.doc_id, CASE WHEN len(files_changed) > 0 AND len(methods) > 0 THEN a.fs ELSE b.fs END AS functions
    FROM commits c LEFT JOIN (SELECT doc_id, list(f ORDER BY i) AS fs FROM (SELECT doc_id, f, min(i) AS i FROM
      (SELECT doc_id, unnest(methods) AS f, generate_subscripts(methods, 1) AS i FROM commits) GROUP BY doc_id, f) GROUP BY doc_id) a USING (doc_id)
    LEFT JOIN (SELECT doc_id, list(f ORDER BY i) AS fs FROM (SELECT doc_id, f, min(i) AS i FROM (
      {" UNION ALL ".join(f"SELECT doc_id, regexp_extract(regexp_extract(l, {Q(s)}), '{_id}') AS f, i * 3 + {n} AS i FROM dl" for n, s in enumerate(_shapes))})
      WHERE f <> '' GROUP BY doc_id, f) GROUP BY doc_id) b USING (doc_id)""")
oracle("p3_functions", "p3", "SELECT doc_id, coalesce(array_to_string(functions, '|'), '') AS functions FROM p3")
oracle("p4_subject", "commits", """SELECT doc_id, CASE WHEN instr(subject, ':') > 0 THEN trim(split_part(subject, ':', 1)) ELSE '' END AS subject_prefix,
    CASE WHEN instr(subject, ':') > 0 THEN trim(substr(subject, instr(subject, ':') + 1)) ELSE subject END AS subject_text FROM commits""")
oracle("p5_fix_commit", "msg", "SELECT doc_id, regexp_matches(lm, 'fix|bug|cve|patch|revert|backport') AS is_fix FROM msg")

values("subp(o, name, pre)", words(tx.SUBSYSTEM_PATHS))
_subs = one_of([n for n, _ in tx.SUBSYSTEM_PATHS])
cte("cf", "commits", "SELECT doc_id, unnest(files_changed) AS f, generate_subscripts(files_changed, 1) AS i FROM commits")
cte("p6", "commits subp cf", f"""SELECT c.doc_id, CASE WHEN len(files_changed) = 0 THEN 'unknown'
      WHEN instr(subject, ':') > 0 AND trim(split_part(subject, ':', 1)) IN {_subs} THEN trim(split_part(subject, ':', 1))
      ELSE coalesce(a.name, b.head, 'unknown') END AS subsystem
    FROM commits c LEFT JOIN (SELECT doc_id, arg_min(name, o) AS name FROM cf JOIN subp ON starts_with(f, pre) GROUP BY doc_id) a USING (doc_id)
    LEFT JOIN (SELECT doc_id, arg_min(split_part(f, '/', 1), i) AS head FROM cf WHERE split_part(f, '/', 1) IN {_subs} GROUP BY doc_id) b USING (doc_id)""")
oracle("p6_subsystem", "p6", f"""SELECT doc_id, subsystem, CASE WHEN subsystem = 'unknown' THEN '' ELSE concat_ws('|', subsystem,
    {case('subsystem', tx.COLLECTOR_PARENTS)}) END AS hierarchy FROM p6""")
values("guessw(o, name, w)", words(tx.SUBSYSTEM_CONTENT_KEYWORDS))
oracle("p8_guess_subsystem", "commits guessw", """SELECT doc_id, coalesce(g, 'unknown') AS guess FROM commits LEFT JOIN
    (SELECT doc_id, arg_max(name, n * 100 - o) AS g FROM (SELECT doc_id, name, o, count(*) AS n FROM commits JOIN guessw
      ON contains(lower(body), w) GROUP BY ALL) GROUP BY doc_id) USING (doc_id)""")
values("bugw(o, label, w)", [(i, normalize_bug_label(l), w) for i, l, w in words(tx.BUG_TYPE_KEYWORDS)])
cte("p9", "msg bugw", """SELECT m.doc_id, coalesce(h.b, 'unknown') AS bug_type, coalesce(h.bs, 'unknown') AS bug_types FROM msg m LEFT JOIN (
    SELECT doc_id, arg_min(label, o) AS b, string_agg(label, '|' ORDER BY o) AS bs FROM
      (SELECT doc_id, label, min(o) AS o FROM msg JOIN bugw ON contains(lm, w) GROUP BY doc_id, label) GROUP BY doc_id) h USING (doc_id)""")
_cat = {b: c for c, bs in tx.BUG_CATEGORIES.items() for b in bs}
oracle("p9_bug_type", "p9", f"""SELECT doc_id, bug_type, bug_types, {case('bug_type', tx.BUG_DESCRIPTIONS, v(tx.BUG_DESCRIPTION_DEFAULT))} AS description,
    {case('bug_type', _cat, "'other'")} AS category FROM p9""")

cte("p12", "commits dl msg", f"""SELECT c.doc_id, CASE WHEN len(files_changed) > 0 AND len(parsed_added) > 0 THEN array_to_string(parsed_added, chr(10))
      ELSE coalesce(p.t, '') END AS code, lm FROM commits c JOIN msg USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(substr(l, 2), chr(10) ORDER BY i) AS t
      FROM dl WHERE starts_with(l, '+') AND NOT starts_with(l, '+++') GROUP BY doc_id) p USING (doc_id)""".replace("files_changed", "c.files_changed").replace("parsed_added", "c.parsed_added").replace(", lm FROM", ", msg.lm FROM"))


def _hit(col, ws):
    return "(" + " OR ".join(f"contains({col}, {v(w)})" for w in ws) + ")"


def _re(col, ps):
    return "(" + " OR ".join(f"regexp_matches({col}, {v(p)})" for p in ps) + ")"


cte("p13", "p12", f"""SELECT doc_id, code, {_hit('lower(code)', tx.LOCK_KEYWORDS)} AS lock_added,
    {_hit('lower(code)', tx.REFCOUNT_KEYWORDS)} OR {_re('lm', tx.REFCOUNT_PATTERNS)} AS refcount_fix,
    {_hit('lower(code)', tx.RCU_KEYWORDS)} OR {_re('lm', tx.RCU_PATTERNS)} AS rcu_fix FROM p12""")
oracle("p12_evidence", "p13", "SELECT doc_id, replace(code, chr(10), '|') AS added, lock_added, refcount_fix, rcu_fix FROM p13")

# --- releases -----------------------------------------------------------------------------------

values("rel(a, b, d)", tx.KERNEL_RELEASES)


def resolve(src: str, key: str, date: str) -> str:
    return f"""SELECT {key}, CASE WHEN ok IS NULL THEN NULL WHEN n = 0 THEN 4 WHEN pb >= 19 THEN pa + 1 ELSE pa END AS major,
      CASE WHEN ok IS NULL THEN NULL WHEN n = 0 THEN 9 WHEN pb >= 19 THEN 0 ELSE pb + 1 END AS minor FROM (
      SELECT {key}, any_value(try_cast(d10 AS DATE)) AS ok, count(a) AS n, arg_max(a, rel.d) AS pa, arg_max(b, rel.d) AS pb
      FROM (SELECT {key}, substr({date}, 1, 10) AS d10 FROM {src}) LEFT JOIN rel ON rel.d < d10 GROUP BY {key})"""


cte("v1c", "commits rel", resolve("commits", "doc_id", "coalesce(committer_date, date)"))
cte("analysed", "commits p2 p3 p6 p9 p13 v1c", f"""SELECT c.*, p2.fix_tags, coalesce(p3.functions, []) AS functions, p6.subsystem, p9.bug_type, p13.lock_added, p13.refcount_fix, p13.rcu_fix,
    CASE WHEN c.doc_id % 7 <> 3 THEN v1c.major END AS kmajor, CASE WHEN c.doc_id % 7 <> 3 THEN v1c.minor END AS kminor,
    CASE WHEN c.doc_id % 7 <> 3 THEN concat(v1c.major, '.', v1c.minor, '.0') END AS kver0,
    round(least(10, {case('p9.bug_type', tx.BUG_BASE_SCORES, '0')} + CASE WHEN lock_added THEN 2 ELSE 0 END + CASE WHEN refcount_fix THEN 3 ELSE 0 END
      + CASE WHEN rcu_fix THEN 3 ELSE 0 END + least(len(files_changed) * 0.5, 5) + least((insertions + deletions) / 100, 3)
      + CASE WHEN list_contains(fix_tags, 'CVE') THEN 10 ELSE 0 END + CASE WHEN len(files_changed) = 0 THEN 0 WHEN complexity > 50 THEN 2 WHEN complexity > 20 THEN 1 ELSE 0 END
      + CASE WHEN is_merge THEN 0.5 ELSE 0 END), 2)::DOUBLE AS score
    FROM commits c JOIN p2 USING (doc_id) JOIN p3 USING (doc_id) JOIN p6 USING (doc_id) JOIN p9 USING (doc_id) JOIN p13 USING (doc_id) JOIN v1c USING (doc_id)""")
cte("an", "analysed", "SELECT *, CASE WHEN kmajor IS NULL THEN NULL ELSE kver0 END AS kver FROM analysed")
oracle("p16_score", "an", "SELECT doc_id, subsystem, bug_type, score FROM an")

_kw20 = "|".join(sorted({__import__('re').escape(w) for w in tx.KEY_LINE_WORDS_SIMPLE}))
_kw15 = "|".join(sorted({__import__('re').escape(w) for w in tx.KEY_LINE_WORDS}))


def keylines(kw, header):
    plus = "starts_with(l, '+')" + (" AND NOT starts_with(l, '+++')" if header else "")
    return f"""SELECT doc_id, string_agg({strip('substr(l, 2)')}, chr(10) ORDER BY i) AS k
      FROM dl WHERE {plus} AND regexp_matches(l, {v('(?i)' + kw.replace(chr(92) + ' ', ' '))}) GROUP BY doc_id"""


cte("kl15", "dl", keylines(_kw15, True))
cte("kl20", "dl", keylines(_kw20, False))
oracle("p25_key_lines", "commits kl15", "SELECT doc_id, coalesce(k, '') AS key_lines FROM commits LEFT JOIN kl15 USING (doc_id)")
_tf = lambda c: f"CASE WHEN {c} THEN 'True' ELSE 'False' END"
oracle("p18_simple_text", "an kl20", f"""SELECT doc_id, concat('Title: ', subject, chr(10), 'Subsystem: ', subsystem, chr(10), 'BugType: ', bug_type, chr(10), 'Files: ',
    array_to_string(files_changed, ', '), chr(10), 'CommitMessage: ', body, chr(10), 'FixTags: ', array_to_string(fix_tags, ', '), chr(10),
    'LockAdded: ', {_tf('lock_added')}, chr(10), 'RCUFix: ', {_tf('rcu_fix')}, chr(10), 'RefcountFix: ', {_tf('refcount_fix')},
    CASE WHEN k IS NOT NULL THEN concat(chr(10), 'KeyDiffLines:', chr(10), k) ELSE '' END) AS embedding_text FROM an LEFT JOIN kl20 USING (doc_id)""")

values("rules(o, name, rp, rm, op, mh, hint, cause, fix)", [(i, *r) for i, r in enumerate(cr.DIFF_RULES)])
_n = lambda col, lst: f"len(list_filter({lst}, lambda x: contains({col}, x)))"
cte("p20", "msg dl rules", f"""SELECT doc_id, arg_max(name, s * 100 - o) FILTER (s > 0) AS diff_rule, coalesce(max(s) FILTER (s > 0), 0) AS diff_score FROM (
    SELECT doc_id, name, o, CASE WHEN (len(rp) > 0 AND np < 1) OR (len(rm) > 0 AND nm < 1) THEN 0 ELSE 3 * np + 2 * nm
      + CASE WHEN len(op) > 0 AND no >= mh THEN no ELSE 0 END + CASE WHEN nh > 0 THEN 2 ELSE -1 END END AS s FROM (
      SELECT d.doc_id, name, o, rp, rm, op, mh, {_n('pl', 'rp')} AS np, {_n('mi', 'rm')} AS nm, {_n('pl', 'op')} AS no, {_n('lm', 'hint')} AS nh FROM (
        SELECT m.doc_id, lm, coalesce(string_agg(l, chr(10)) FILTER (starts_with(l, '+') AND NOT starts_with(l, '+++')), '') AS pl,
          coalesce(string_agg(l, chr(10)) FILTER (starts_with(l, '-') AND NOT starts_with(l, '---')), '') AS mi
        FROM msg m LEFT JOIN dl USING (doc_id) GROUP BY m.doc_id, lm) d CROSS JOIN rules)) GROUP BY doc_id""")
oracle("p20_diff_rules", "p20", "SELECT doc_id, diff_rule, diff_score::BIGINT AS diff_score FROM p20")
_T = cr.BUG_TEMPLATES
_hints = {f"{b}/{s}": t for b, x in _T.items() for s, t in x[3].items()}
cte("caused", "an p20 rules", f"""SELECT an.*, diff_rule, diff_score, coalesce(r.cause, {case("concat(bug_type, '/', subsystem)", _hints)}, {case('bug_type', {b: x[0] for b, x in _T.items()})}) AS root_cause,
    ({case('bug_type', {b: x[1] for b, x in _T.items()})})::BIGINT AS severity, {case('bug_type', {b: x[2] for b, x in _T.items()})} AS typical_fix, coalesce(r.fix, '') AS fix_pattern,
    CASE WHEN diff_rule IS NULL THEN '' ELSE concat('diff_rule:', diff_rule, '(score=', diff_score, ')') END AS evidence,
    list_filter(fix_tags, lambda x: starts_with(upper(x), 'CVE')) AS cves,
    round(least(0.98, CASE WHEN diff_rule IS NULL THEN 0.80 ELSE least(0.95, 0.80 + diff_score * 0.03) END + CASE WHEN bug_type <> 'unknown' THEN 0.05 ELSE 0 END
      + CASE WHEN subsystem <> 'unknown' THEN 0.02 ELSE 0 END + (lock_added::INT + refcount_fix::INT + rcu_fix::INT) * 0.03
      + CASE WHEN list_contains(fix_tags, 'CVE') THEN 0.05 ELSE 0 END), 4)::DOUBLE AS confidence
    FROM an JOIN p20 USING (doc_id) LEFT JOIN rules r ON r.name = diff_rule""")
oracle("p23_root_cause", "caused", "SELECT doc_id, root_cause, severity, typical_fix, fix_pattern, evidence, array_to_string(cves, '|') AS cves, confidence FROM caused")
values("fbw(o, bug, cause, p)", [(i, b, c, p) for i, (ps, b, c) in enumerate(cr.MESSAGE_FALLBACK) for p in ps])
oracle("p22_message_fallback", "msg fbw", """SELECT doc_id, coalesce(b, 'unknown') AS bug_type, coalesce(c, 'none') AS root_cause, CASE WHEN b IS NULL THEN 0.5 ELSE 0.55 END::DOUBLE AS confidence
    FROM msg LEFT JOIN (SELECT doc_id, arg_min(bug, o) AS b, arg_min(cause, o) AS c FROM msg JOIN fbw ON regexp_matches(lm, p) GROUP BY doc_id) USING (doc_id)""")
cte("etext", "caused kl15", """SELECT doc_id, concat_ws(chr(10), concat('BugType: ', bug_type), concat('Subsystem: ', subsystem), concat('RootCause: ', root_cause),
    CASE WHEN fix_pattern <> '' THEN concat('FixPattern: ', fix_pattern) END, CASE WHEN lock_added THEN 'FixAction: lock synchronization added' END,
    CASE WHEN refcount_fix THEN 'FixAction: reference count correction applied' END, CASE WHEN rcu_fix THEN 'FixAction: RCU synchronization/protection fix applied' END,
    concat('CommitTitle: ', subject), concat('CommitMessage: ', body), CASE WHEN len(files_changed) > 0 THEN concat('ModifiedFiles: ', array_to_string(files_changed, ', ')) END,
    CASE WHEN len(fix_tags) > 0 THEN concat('Tags: ', array_to_string(fix_tags, ', ')) END, CASE WHEN len(cves) > 0 THEN concat('CVEs: ', array_to_string(cves, ', ')) END,
    CASE WHEN severity >= 8 THEN concat('Severity: Critical (level ', severity, ')') END, CASE WHEN k <> '' THEN concat('KeyDiffLines:', chr(10), k) END) AS embedding_text
    FROM caused LEFT JOIN kl15 USING (doc_id)""")
oracle("p24_embedding_text", "etext", "SELECT doc_id, embedding_text FROM etext")
oracle("p27_crash_feature", "an", """SELECT subsystem, bug_type, count(*) AS n, sum(length(subject) + 1 + length(body))::BIGINT AS chars FROM an
    WHERE commit_hash <> '' GROUP BY subsystem, bug_type""")
oracle("p29_diff_preview", "an", f"""SELECT doc_id, concat_ws(chr(10), CASE WHEN len(files_changed) > 0 THEN concat('Modified files:', chr(10), '  ', files_changed[1], ' (+', insertions, '/-', deletions, ')') END,
    CASE WHEN len(functions) > 0 THEN concat('Functions: ', array_to_string(functions, ', ')) END, CASE WHEN len(fix_tags) > 0 THEN concat('Tags: ', array_to_string(fix_tags, ', ')) END,
    nullif(concat('Fix features: ', concat_ws(', ', CASE WHEN lock_added THEN 'lock_added' END, CASE WHEN refcount_fix THEN 'refcount_fix' END, CASE WHEN rcu_fix THEN 'rcu_fix' END)), 'Fix features: '),
    nullif(concat_ws(' | ', 'v' || kver, CASE WHEN insertions <> 0 OR deletions <> 0 THEN concat('+', insertions, '/-', deletions) END), ''),
    concat(chr(10), 'Commit message:', chr(10), body)) AS diff_preview FROM an""")
oracle("p30_json_round_trip", "an", "SELECT doc_id, commit_hash, subject, array_to_string(fix_tags, '|') AS fix_tags, score FROM an")

cte("odays", "", "SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 7 THEN '2023-13-45' ELSE (o_orderdate::DATE + 8000)::VARCHAR END AS day FROM orders")
cte("v1o", "odays rel", resolve("odays", "o_orderkey", "day"))
oracle("v1_resolve_version", "v1o", "SELECT o_orderkey, major::BIGINT AS major, minor::BIGINT AS minor, CASE WHEN major IS NOT NULL THEN concat(major, '.', minor, '.0') END AS version FROM v1o")
oracle("v6_version_weight", "v1o", """SELECT o_orderkey, d::BIGINT AS distance, CASE WHEN d IS NULL THEN NULL WHEN d = 0 THEN 1.3 WHEN d IN (1, 2) THEN 1.15 WHEN d BETWEEN 3 AND 5 THEN 1.0
    WHEN d >= 6 THEN 0.7 ELSE 1.0 END::DOUBLE AS weight FROM (SELECT o_orderkey, (major - 5) * 1000 + minor - 4 AS d FROM v1o)""")
oracle("v7_date_compatible", "odays rel", """SELECT o_orderkey, CASE WHEN a IS NULL THEN 'unknown' WHEN a - 5 > 1 THEN 'false' WHEN a > 5 THEN 'unknown' WHEN a = 5 THEN CASE WHEN b <= 5 THEN 'true' ELSE 'false' END ELSE 'true' END AS compatible
    FROM (SELECT o_orderkey, arg_max(a, a * 100 + b) AS a, arg_max(b, a * 100 + b) AS b FROM odays LEFT JOIN rel ON d <= day GROUP BY o_orderkey)""")
oracle("s21_backfill", "v1c", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '4.4.0' WHEN major IS NULL THEN NULL ELSE concat(major, '.', minor, '.0') END AS kernel_version,
    CASE WHEN doc_id % 3 = 0 THEN 4 ELSE minor END::BIGINT AS minor FROM v1c""")

# --- text utilities -----------------------------------------------------------------------------

_email = f"[{W}.+-]+@[{W}-]+\\.[{W}.-]+"
_word = lambda n: f"nullif(regexp_extract(text, '(?:^|[^{W}])([0-9a-fA-F]{{{n}}})(?:$|[^{W}])', 1), '')"
cte("mails", "", f"""SELECT doc_id, string_agg(e, '|' ORDER BY i) AS emails FROM (SELECT doc_id, e, min(i) AS i FROM (SELECT doc_id, unnest(es) AS e, generate_subscripts(es, 1) AS i
    FROM (SELECT doc_id, regexp_extract_all(text, '{_email}') AS es FROM documents)) GROUP BY doc_id, e) GROUP BY doc_id""")
oracle("u1_text_scalars", "mails", f"""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE concat(CASE WHEN instr(cut, ' ') > 0 AND 197 - instr(reverse(cut), ' ') > 100
      THEN substr(cut, 1, 197 - instr(reverse(cut), ' ')) ELSE cut END, '...') END AS short,
    md5({strip("regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\x1b\\[[0-9;]*m', '', 'g'), chr(13) || chr(10) || '?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t\\f\\x0B\\x1C-\\x1F\\x{0085}\\p{Z}]+(\\n|$)', '\\1', 'g')")}) AS clean_md5,
    coalesce({_word(40)}, {_word(12)}) AS hash, coalesce(emails, '') AS emails, sha256(text) AS sha256, sha1(text) AS sha1, substr(md5(text), 1, 8) AS short_hash
    FROM (SELECT *, substr(text, 1, 197) AS cut FROM documents) LEFT JOIN mails USING (doc_id)""")
oracle("u4_cve_ids", "commits", """SELECT c.doc_id, coalesce(s, '') AS cves FROM commits c LEFT JOIN (SELECT doc_id, string_agg(e, '|' ORDER BY i) AS s FROM (SELECT doc_id, e, min(i) AS i FROM
    (SELECT doc_id, unnest(es) AS e, generate_subscripts(es, 1) AS i FROM (SELECT doc_id, regexp_extract_all(body, '(?i)CVE-\\d{4}-\\d{4,}') AS es FROM commits)) GROUP BY doc_id, e) GROUP BY doc_id) USING (doc_id)""")
oracle("u6_safe_filename", "", """SELECT page_id, CASE WHEN n = '' THEN 'unnamed' WHEN length(n) > 30 THEN concat(substr(substr(n, 1, length(n) - length(e)), 1, 30 - length(e)), e) ELSE n END AS name
    FROM (SELECT page_id, n, regexp_extract(n, '(?s)^.*[^.].*?(\\.[^.]*)$', 1) AS e FROM (SELECT page_id, trim(translate(url, '/\\<>:"|?*', '_________'), '. ') AS n FROM pages))""")
oracle("u8_numbers", "", """SELECT l_orderkey, l_linenumber::BIGINT AS line, CASE WHEN l_discount <> 0 THEN round(l_extendedprice / l_discount, 4) ELSE 0.0 END AS ratio,
    round(1 / (1 + exp(-(l_quantity / 25 - 1))), 8) AS sig, round(CASE WHEN s BETWEEN 0 AND 1 THEN s WHEN s > 1 AND s <= 2 THEN 1.0 WHEN s > 2 THEN 1 / (1 + exp(-(s - 2))) ELSE 1 / (1 + exp(-(s + 1))) END, 8) AS shown,
    CASE WHEN ms < 1 THEN printf('%.0fμs', ms * 1000) WHEN ms < 1000 THEN printf('%.0fms', ms) WHEN ms < 60000 THEN printf('%.2fs', ms / 1000)
      ELSE concat(floor(ms / 60000)::BIGINT, printf('m %.0fs', ms / 1000 - floor(ms / 60000) * 60)) END AS took
    FROM (SELECT *, l_quantity / 10 - 1 AS s, l_extendedprice * 7 - 8000 AS ms FROM lineitem)""")
oracle("u12_json_and_bool", "", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.k')::BIGINT % 3 = 1 AS flag FROM events")

# --- crash side ---------------------------------------------------------------------------------

cte("lines", "crashes", f"""SELECT crash_id, i, l, {strip('l')} AS s FROM (SELECT crash_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM
    (SELECT crash_id, string_split(content, chr(10)) AS ls FROM crashes))""")
cte("kinds", "lines", f"""SELECT *, f AS isf, NOT f AND ({" OR ".join(f"regexp_matches(s, {v(p)})" for p in kr.TRACE_END)}) AS ise FROM (SELECT *,
    regexp_matches(s, {v(kr.FRAME_FUNC)}) OR (NOT starts_with(s, '?') AND regexp_matches(s, {v(kr.FRAME_ADDR)})) AS f, ({" OR ".join(f"regexp_matches(l, {v(p)})" for p in kr.TRACE_START)}) AS ism FROM lines)""")
cte("t0", "kinds", "SELECT crash_id, coalesce(min(i) FILTER (ism), min(i) FILTER (isf)) AS st, max(i) AS n FROM kinds GROUP BY crash_id")
cte("t1", "kinds t0", "SELECT k.crash_id, st, n, min(i) FILTER (isf AND i > st) AS f, min(i) FILTER (ise AND i > st) AS e FROM kinds k JOIN t0 USING (crash_id) GROUP BY ALL")
cte("bounds", "kinds t1", """SELECT crash_id, coalesce(st, 0) - 1 AS a, CASE WHEN st IS NULL THEN -1 WHEN t1.f IS NOT NULL AND (e IS NULL OR t1.f < e) THEN coalesce(min(i) FILTER (NOT isf AND i > t1.f) - 2, n - 1) ELSE st - 1 END AS b
    FROM t1 JOIN kinds USING (crash_id) GROUP BY crash_id, st, n, t1.f, e""")
cte("frames", "kinds bounds", "SELECT crash_id, i, s, row_number() OVER (PARTITION BY crash_id ORDER BY i) AS r FROM kinds JOIN bounds USING (crash_id) WHERE isf AND i - 1 BETWEEN a AND b")
cte("trace", "crashes frames", "SELECT c.crash_id, coalesce(list(s ORDER BY i) FILTER (s IS NOT NULL), []) AS tr FROM crashes c LEFT JOIN frames USING (crash_id) GROUP BY c.crash_id")
oracle("d2_trace_bounds", "bounds trace lines", """SELECT b.crash_id, a::BIGINT AS trace_start, b::BIGINT AS trace_end, array_to_string(tr, '|') AS frames, coalesce(reg, '') AS trace_region FROM bounds b JOIN trace USING (crash_id)
    LEFT JOIN (SELECT crash_id, string_agg(l, chr(10) ORDER BY i) AS reg FROM lines JOIN bounds USING (crash_id) WHERE a >= 0 AND i - 1 BETWEEN a - 2 AND b + 2 GROUP BY crash_id) USING (crash_id)""")
_pp = [(i, n, v("(?i)" + p + "()" * (2 - g))) for i, (n, p, g) in enumerate(kr.PANIC_PATTERNS)]
cte("ph", "lines", " UNION ALL ".join(f"SELECT crash_id, i * 100 + {i} AS k, {v(n)} AS pname, trim(regexp_extract(l, {p})) AS msg, regexp_extract(l, {p}, 1) AS g0, regexp_extract(l, {p}, 2) AS g1 FROM lines WHERE regexp_matches(l, {p})" for i, n, p in _pp))
cte("d6", "crashes ph", """SELECT c.crash_id, content, coalesce(arg_min(pname, k), 'unknown') AS panic_type, coalesce(arg_min(msg, k), '') AS panic_msg, coalesce(string_agg(pname, '|' ORDER BY k), '') AS matched,
    arg_max(g0, k) FILTER (g0 <> '') AS g0, arg_max(g1, k) FILTER (g1 <> '') AS g1 FROM crashes c LEFT JOIN ph USING (crash_id) GROUP BY c.crash_id, content""")
oracle("d6_panic_info", "d6", "SELECT crash_id, panic_type, panic_msg, matched, g0, g1 FROM d6")
values("lsub(o, label, w)", words(kr.LOG_SUBSYSTEM_HINTS))
values("lbug(o, label, w)", [(i, normalize_bug_label(l), w) for i, l, w in words(kr.LOG_BUG_HINTS)])


def first_match(src, key, text, table, out):
    return f"(SELECT {key}, arg_min(label, o) AS {out} FROM {src} JOIN {table} ON contains({text}, w) GROUP BY {key})"


_kv = "coalesce(" + ", ".join(f"nullif(regexp_extract(content, {v('(?i)' + p)}, 1), '')" for p in kr.KERNEL_VERSION_PATTERNS) + ", '')"
cte("d11", "d6 lsub lbug trace", f"""SELECT d6.*, tr, lower(array_to_string(tr, chr(10))) AS tt, coalesce(sub, 'unknown') AS subsystem, coalesce(bug, 'unknown') AS bug_type, {_kv} AS kernel_version,
    regexp_extract(content, {v('(?i)' + kr.RIP_PATTERN)}, 1) AS rip, regexp_extract_all(content, {v(kr.MODULE_PATTERN)}, 1) AS modules FROM d6 JOIN trace USING (crash_id)
    LEFT JOIN {first_match('d6', 'crash_id', 'lower(content)', 'lsub', 'sub')} USING (crash_id) LEFT JOIN {first_match('d6', 'crash_id', 'lower(content)', 'lbug', 'bug')} USING (crash_id)""")
_any = lambda ws: "(" + " OR ".join(f"contains(pm, {v(w)})" for w in ws) + ")"
_pc = "CASE WHEN contains(pm, 'kernel panic') THEN CASE " + " ".join(f"WHEN {_any(ws)} THEN {v(l)}" for ws, l in kr.PANIC_CLASS_PANIC[1]) + " ELSE 'Kernel Panic' END " \
    + " ".join(f"WHEN {_any(ws)} THEN {v(l)}" for ws, l in kr.PANIC_CLASSES) + " ELSE 'Unknown' END"
_sv = f"""CASE WHEN {_any(["hard lockup", "machine check", "kernel panic"])} THEN 'critical' WHEN {_any(["use-after-free", "use after free", "double free", "general protection", "bug:", "null pointer"])} THEN 'high' ELSE 'medium' END"""
oracle("d11_parse", "d11", f"SELECT crash_id, subsystem, bug_type, kernel_version, rip AS rip_function, array_to_string(modules, '|') AS modules, {_pc} AS panic_class, {_sv} AS severity FROM (SELECT *, lower(panic_msg) AS pm FROM d11)")
values("tsub(o, label, w)", words(kr.TRACE_SUBSYSTEM_HINTS))
_set = lambda ws: f"list_filter({v(ws)}, lambda x: contains(tt, lower(x)))"
cte("fname", "frames", """SELECT crash_id, r, n FROM (SELECT crash_id, r, regexp_extract(ltrim(regexp_replace(regexp_replace(s, '^\\[\\s*[\\d]+[\\.\\d]*\\s*\\]\\s*', ''), '\\[\\s*<[0-9a-fA-F]+>\\s*\\]\\s*', '', 'g'), '? '),
    '^(\\w+)\\+0x[0-9a-fA-F]+/0x[0-9a-fA-F]+', 1) AS n FROM frames) WHERE n <> ''""")
cte("d15", "d11 tsub", f"""SELECT *, CASE WHEN len(lf) > 0 AND len(sf) > 0 THEN 'deadlock_or_lock_contention' WHEN len(lf) > 0 THEN 'possible_lock_issue' WHEN len(rf) > 0 THEN 'rcu_related'
      WHEN len(mf) > 0 THEN 'memory_related' WHEN len(sf) > 0 THEN 'scheduling_related' ELSE 'unknown' END AS issue FROM (
    SELECT d11.*, coalesce(ts, 'unknown') AS tsub, {_set(kr.LOCK_TRACE_FUNCTIONS)} AS lf, {_set(kr.MEMORY_TRACE_FUNCTIONS)} AS mf, {_set(kr.RCU_TRACE_FUNCTIONS)} AS rf, {_set(kr.SCHED_TRACE_FUNCTIONS)} AS sf
    FROM d11 LEFT JOIN {first_match('d11', 'crash_id', 'tt', 'tsub', 'ts')} USING (crash_id))""")
oracle("d15_trace_structure", "d15 fname", """SELECT d.crash_id, coalesce(ns, '') AS names, array_to_string(lf, '|') AS lock_f, array_to_string(mf, '|') AS mem_f, array_to_string(rf, '|') AS rcu_f, array_to_string(sf, '|') AS sched_f,
    issue AS inferred_issue, tsub AS involved_subsystem FROM d15 d LEFT JOIN (SELECT crash_id, string_agg(n, '|' ORDER BY r) AS ns FROM fname GROUP BY crash_id) USING (crash_id)""")
values("er(o, id, name, bug, sev, kws, pats, rsub, why)", [(i, *r) for i, r in enumerate(kr.EXPERT_RULES)])
cte("needles", "er", """SELECT o, id, 0.95 AS sc, 'panic_pattern:' || x AS how, 0 AS kind, x, j FROM (SELECT o, id, unnest(pats) AS x, generate_subscripts(pats, 1) AS j FROM er)
    UNION ALL SELECT o, id, 0.85, 'panic_keyword:' || x, 1, lower(x), j FROM (SELECT o, id, unnest(kws) AS x, generate_subscripts(kws, 1) AS j FROM er)
    UNION ALL SELECT o, id, 0.70, 'trace_keyword:' || x, 2, lower(x), j FROM (SELECT o, id, unnest(kws) AS x, generate_subscripts(kws, 1) AS j FROM er)""")
cte("d18", "d11 needles", """SELECT d.crash_id, h.id AS rule_id, h.sc::DOUBLE AS rule_score, h.how AS rule_match FROM d11 d LEFT JOIN (
    SELECT crash_id, arg_min(id, key) AS id, arg_min(sc, key) AS sc, arg_min(how, key) AS how FROM (SELECT crash_id, id, sc, how, (1 - sc) * 1000000 + o * 1000 + kind * 100 + j AS key
      FROM (SELECT crash_id, panic_msg, lower(panic_msg) AS pm, tt FROM d11) JOIN needles ON CASE kind WHEN 0 THEN panic_msg <> '' AND regexp_matches(panic_msg, '(?i)' || x) WHEN 1 THEN contains(pm, x) ELSE contains(tt, x) END)
    GROUP BY crash_id) h USING (crash_id)""")
oracle("d18_expert_rule", "d18", "SELECT crash_id, rule_id, rule_score, rule_match FROM d18")
values("sy(o, bug, name, sid, ws)", [(i, b, p["name"], f"{i}-{j}", s.lower().split()) for i, (b, p) in enumerate(kn.BUG_PATTERNS.items()) for j, s in enumerate(p["symptoms"])])
cte("a9", "d6 sy", """SELECT crash_id, o, bug, name, sum(n)::BIGINT AS sc, row_number() OVER (PARTITION BY crash_id ORDER BY sum(n) DESC, o) AS place FROM (
    SELECT crash_id, o, bug, name, len(ws) AS m, len(list_filter(ws, lambda x: contains(lower(panic_msg), x))) AS n FROM d6 CROSS JOIN sy) WHERE n >= m * 0.5 GROUP BY crash_id, o, bug, name HAVING sum(n) > 0""")
oracle("a9_symptoms", "a9", "SELECT crash_id, place::BIGINT AS place, bug AS bug_type, sc AS match_score FROM a9")

# --- knowledge ----------------------------------------------------------------------------------

_par: dict = {}
for _p, _cs in kn.GRAPH_HIERARCHY.items():
    for _c in _cs:
        _par.setdefault(_c, _p)
values("edges(kind, src, dst)", [(k, s, d) for k, t in (("c", kn.GRAPH_COUPLED), ("f", kn.GRAPH_CALLS), ("h", kn.GRAPH_HIERARCHY)) for s, ds in t.items() for d in ds]
       + [("p", c, p) for c, p in _par.items()])
cte("names", "edges", f"SELECT DISTINCT n FROM (SELECT src AS n FROM edges UNION SELECT dst FROM edges UNION SELECT unnest({v([n for n, *_ in kn.SUBSYSTEMS] + [n for n, _ in tx.SUBSYSTEM_PATHS] + ['unknown'])}))")
cte("related", "names edges", """SELECT n, string_agg(x, ', ' ORDER BY x) AS rel, string_agg(x, '|' ORDER BY x) AS relp, count(*) AS k FROM (SELECT n, n AS x FROM names
    UNION SELECT src, dst FROM edges UNION SELECT p.src, c.dst FROM edges p JOIN edges c ON p.kind IN ('p', 'h') AND c.kind = 'c' AND c.src = p.dst) GROUP BY n""")
values("si(o, n, title, pre, fs, bugs)", [(i, *r) for i, r in enumerate(kn.SUBSYSTEMS)])
cte("chil", "", f"SELECT unnest({v(list(kn.GRAPH_HIERARCHY))}) AS n, unnest({v(['|'.join(x) for x in kn.GRAPH_HIERARCHY.values()])}) AS cs")


def _anc(s):
    out = []
    while s in _par:
        s = _par[s]
        out.append(s)
    return "|".join(out)


oracle("g5_subsystem_graph", "an si chil related", f"""SELECT doc_id, title, coalesce(cs, '') AS children, {case('subsystem', _par)} AS parent, {case('subsystem', {c: _anc(c) for c in _par}, "''")} AS ancestors, relp AS related,
    coalesce((SELECT string_agg(n, '|' ORDER BY o) FROM si WHERE list_contains(bugs, an.bug_type)), '') AS by_bug FROM an LEFT JOIN si ON si.n = subsystem LEFT JOIN chil ON chil.n = subsystem JOIN related r ON r.n = subsystem""")
oracle("g6_path_and_function", "cf si p3", """SELECT doc_id, (i - 1)::BIGINT AS file_no, f AS path, (SELECT arg_min(n, o) FROM (SELECT n, o, unnest(pre) AS p FROM si) WHERE starts_with(f, rtrim(p, '/'))) AS subsystem,
    (SELECT arg_min(n, o) FROM (SELECT n, o, unnest(fs) AS k FROM si) WHERE contains(lower(coalesce(functions[1], '')), lower(k))) AS by_function FROM cf JOIN p3 USING (doc_id)""")
_keys = list(kn.BUG_PATTERNS)
values("bk(o, k)", list(enumerate(_keys)))
_bp = lambda f: case("pattern", {k: "|".join(p[f]) for k, p in kn.BUG_PATTERNS.items()}, "''")
oracle("g9_bug_pattern", "an bk", f"""SELECT doc_id, pattern, {_bp('fixes')} AS fixes, {_bp('keywords')} AS keywords, {_bp('tools')} AS tools, {_bp('causes')} AS causes, {_bp('options')} AS options FROM (SELECT doc_id, coalesce(CASE WHEN bug_type IN {one_of(_keys)} THEN bug_type END,
    (SELECT arg_min(k, o) FROM bk WHERE contains(bug_type, k) OR contains(k, bug_type))) AS pattern FROM an)""")
_acq = [(a, t) for t, apis in kn.LOCK_APIS for a in apis if "lock" in a and "unlock" not in a]
_rls = [(a, t) for t, apis in kn.LOCK_APIS for a in apis if "unlock" in a or ("up_" in a and "lock" not in a)]
values("api(o, a, t, rel)", [(i, a, t, False) for i, (a, t) in enumerate(_acq)] + [(i, a, t, True) for i, (a, t) in enumerate(_rls)])
cte("lockhits", "frames api", "SELECT crash_id, r, o, a, t, rel, s FROM frames JOIN api ON contains(lower(s), a)")
cte("locku", "crashes lockhits frames", f"""SELECT c.crash_id, coalesce(ty, '') AS types, coalesce(acq, '') AS acquired, coalesce(rl, '') AS released, list_filter([
      CASE WHEN spin AND slp THEN {v(kn.LOCK_ISSUES[0])} END, CASE WHEN plain AND irq THEN {v(kn.LOCK_ISSUES[1])} END, CASE WHEN rcu AND slp THEN {v(kn.LOCK_ISSUES[2])} END], lambda x: x IS NOT NULL) AS issues FROM crashes c
    LEFT JOIN (SELECT crash_id, string_agg(DISTINCT t, '|' ORDER BY t) AS ty, bool_or(t IN ('spinlock', 'rwlock')) AS spin FROM lockhits GROUP BY crash_id) USING (crash_id)
    LEFT JOIN (SELECT crash_id, string_agg(a, '|' ORDER BY r, o) AS acq FROM lockhits WHERE NOT rel GROUP BY crash_id) USING (crash_id)
    LEFT JOIN (SELECT crash_id, string_agg(a, '|' ORDER BY r, o) AS rl FROM lockhits WHERE rel GROUP BY crash_id) USING (crash_id)
    LEFT JOIN (SELECT crash_id, bool_or(regexp_matches(lower(s), 'schedule|sleep')) AS slp, bool_or(contains(lower(s), 'spin_lock') AND NOT contains(lower(s), 'irq')) AS plain,
      bool_or(regexp_matches(lower(s), 'irq|interrupt')) AS irq, bool_or(contains(lower(s), 'rcu_read_lock')) AS rcu FROM frames GROUP BY crash_id) USING (crash_id)""")
_ex = "concat_ws('|', " + ", ".join(f"CASE WHEN contains(pm, {v(m)}) THEN {v(n)} END" for n, m, _ in kn.DEADLOCK_PATTERNS) + ")"
_lo = "concat_ws('|', " + ", ".join(f"CASE WHEN contains(pm, {v(g)}) THEN {v(n)} END" for n, _, g in kn.DEADLOCK_PATTERNS if g) + ")"
_or = "concat_ws('|', " + ", ".join(f"CASE WHEN subsystem IN {one_of(s)} THEN {v(i)} END" for i, _, s in kn.LOCK_ORDERING) + ")"
oracle("g14_lock_usage", "locku d11", f"SELECT crash_id, types, acquired, released, array_to_string(issues, '|') AS issues, CASE WHEN {_ex} <> '' THEN {_ex} ELSE {_lo} END AS deadlocks, {_or} AS ordering FROM locku JOIN (SELECT *, lower(panic_msg) AS pm FROM d11) USING (crash_id)")
values("apis(o, t, a)", words(kn.LOCK_APIS))
oracle("g11_lock_type", "fname apis", f"""SELECT crash_id, (row_number() OVER (PARTITION BY crash_id ORDER BY r) - 1)::BIGINT AS frame_no, (SELECT arg_min(t, o) FROM apis WHERE contains(lower(n), a)) AS lock_type,
    CASE WHEN n IN {one_of([t for t, _ in kn.LOCK_APIS])} THEN n ELSE (SELECT arg_min(t, o) FROM apis WHERE contains(a, lower(n))) END AS by_name FROM fname""")
values("enum(o, b)", list(enumerate(tx.BUG_TYPES)))
_al = lambda k: case(k, tx.BUG_TYPE_ALIASES)
cte("g16", "enum", f"""SELECT p_partkey, CASE WHEN k = '' THEN 'unknown' ELSE coalesce(CASE WHEN k IN {one_of(tx.BUG_TYPES)} THEN k END, {_al('lower(k)')}, {_al('f')}, CASE WHEN f IN {one_of(tx.BUG_TYPES)} THEN f END,
    (SELECT arg_min(b, o) FROM enum WHERE contains(f, b) OR contains(b, f)), 'unknown') END AS bug_type FROM (SELECT *, replace(replace(lower(k), '-', '_'), ' ', '_') AS f FROM
    (SELECT p_partkey, trim({vw.pick('p_partkey % 12', cat.RAW_BUGS)}) AS k FROM part))""")
oracle("g16_normalize_bug_type", "g16", f"""SELECT p_partkey, bug_type, {case('bug_type', _cat, "'other'")} AS category FROM g16""")

# --- root cause ---------------------------------------------------------------------------------

_rule = lambda i: case("rule_id", {r[0]: r[i] for r in kr.EXPERT_RULES})
_sevtext = case("rule_id", {r[0]: "Severity: " + kr.SEVERITY_TEXT[r[3]] for r in kr.EXPERT_RULES})
_iss = lambda i: case("issue", {k: x[i] for k, x in kr.TRACE_ISSUES.items()})
_abs = lambda i: case("bug_type", {k: x[i] for k, x in kr.BUG_ABSTRACTIONS.items()})
_hint = lambda i: "CASE " + " ".join(f"WHEN regexp_matches(lower(panic_msg), {v(h[0])}) THEN {v(h[i])}" for h in kr.PANIC_HINTS) + " END"
cte("rc0", "d15 d18 a9 locku related", """SELECT d.* EXCLUDE (subsystem), rule_id, rule_score, rule_match, s.bug AS sbug, s.name AS sname, s.sc AS ssc, issues, sub AS subsystem, rel, k AS nrel,
    CASE WHEN rule_id IS NOT NULL THEN 'R' WHEN issue <> 'unknown' THEN 'T' WHEN s.bug IS NOT NULL THEN 'K' END AS early FROM (SELECT *, CASE WHEN subsystem = 'unknown' THEN tsub ELSE subsystem END AS sub FROM d15) d
    JOIN d18 USING (crash_id) LEFT JOIN (SELECT * FROM a9 WHERE place = 1) s USING (crash_id) JOIN locku USING (crash_id) LEFT JOIN related r ON r.n = sub""")
cte("rc1", "rc0", f"""SELECT *, coalesce(early, CASE WHEN {_abs(0)} IS NOT NULL THEN 'B' WHEN {_hint(1)} IS NOT NULL THEN 'H' ELSE 'U' END) AS lay FROM rc0""")
cte("rc2", "rc1", f"""SELECT *, CASE lay WHEN 'R' THEN {_rule(1)} WHEN 'T' THEN {_iss(0)} WHEN 'K' THEN sname WHEN 'B' THEN {_abs(0)} WHEN 'H' THEN {_hint(1)} ELSE {v(kr.UNKNOWN_CAUSE[0])} END AS root_cause,
    CASE lay WHEN 'R' THEN {_rule(2)} WHEN 'T' THEN issue WHEN 'K' THEN sbug WHEN 'U' THEN CASE WHEN bug_type = 'unknown' THEN 'crash' ELSE bug_type END ELSE bug_type END AS cbug,
    CASE lay WHEN 'R' THEN {_rule(7)} WHEN 'T' THEN {_iss(1)} WHEN 'K' THEN concat('匹配到知识库中的 ', sname, ' 模式') WHEN 'B' THEN {_abs(1)} WHEN 'H' THEN {_hint(2)} ELSE {v(kr.UNKNOWN_CAUSE[1])} END AS reason,
    CASE WHEN lay IN ('R', 'T') AND sbug IS NOT NULL THEN greatest(0.85, CASE lay WHEN 'R' THEN rule_score ELSE {_iss(2)} END) ELSE CASE lay WHEN 'R' THEN rule_score WHEN 'T' THEN {_iss(2)} WHEN 'K' THEN least(0.9, ssc * 0.2 + 0.6)
      WHEN 'B' THEN {_abs(2)} WHEN 'H' THEN {_hint(3)} ELSE 0.1 END END::DOUBLE AS score,
    CASE lay WHEN 'R' THEN [concat('Expert Rule: ', rule_id, ' (', rule_match, ')'), {_sevtext}] WHEN 'T' THEN list_filter([concat('Trace Structure: ', {_iss(0)}), CASE WHEN len(lf) > 0 THEN concat('Lock Functions in trace: ', array_to_string(lf, ', ')) END,
      CASE WHEN len(mf) > 0 THEN concat('Memory Functions in trace: ', array_to_string(mf, ', ')) END, CASE WHEN len(rf) > 0 THEN concat('RCU Functions in trace: ', array_to_string(rf, ', ')) END], lambda x: x IS NOT NULL)
      WHEN 'K' THEN [concat('Knowledge Base: ', sname, ' (score=', ssc, ')')] ELSE [] END
    || CASE WHEN len(tr) > 0 THEN list_transform(issues, lambda x: 'Lock Issue: ' || x) ELSE [] END || CASE WHEN subsystem <> 'unknown' AND nrel > 1 THEN ['Related Subsystems: ' || rel] ELSE [] END
    || CASE lay WHEN 'B' THEN ['Bug Type: ' || bug_type] WHEN 'H' THEN ['Panic Keyword: ' || {_hint(1)}] WHEN 'U' THEN ['Insufficient information for root cause determination'] ELSE [] END AS ch FROM rc1""")
cte("g16c", "enum rc2", f"""SELECT k, coalesce(CASE WHEN k IN {one_of(tx.BUG_TYPES)} THEN k END, {_al('k')}, (SELECT arg_min(b, o) FROM enum WHERE contains(k, b) OR contains(b, k)), 'unknown') AS nb FROM (SELECT DISTINCT cbug AS k FROM rc2)""")
cte("rc", "rc2 g16c", """SELECT *, ch || CASE WHEN subsystem <> 'unknown' AND len(list_filter(ch, lambda x: contains(x, 'Subsystem'))) = 0 THEN ['Affected Subsystem: ' || subsystem] ELSE [] END
    || CASE WHEN kernel_version <> '' THEN ['Kernel Version: ' || kernel_version] ELSE [] END || CASE WHEN len(modules) > 0 THEN ['Loaded Modules: ' || array_to_string(modules, ', ')] ELSE [] END AS chain,
    nb FROM rc2 JOIN g16c ON k = cbug""")
_svl = "CASE WHEN score >= 0.85 THEN 'CRITICAL' WHEN score >= 0.70 THEN 'HIGH' WHEN score >= 0.50 THEN 'MEDIUM' WHEN score >= 0.30 THEN 'LOW' ELSE 'UNCERTAIN' END"
oracle("d21_root_cause", "rc", f"SELECT crash_id, root_cause, nb AS bug_type, round(score, 4) AS score, reason, subsystem, array_to_string(chain, '|') AS chain, {_svl} AS severity FROM rc")
_flag = lambda k: f"cbug IN {one_of([b for b, (f, _) in kr.FIX_HINTS.items() if k in f])}"
cte("fx", "rc", f"""SELECT *, {_flag('needs_lock_fix')} OR len(lf) > 0 AS needs_lock_fix, {_flag('needs_refcount_fix')} OR contains(array_to_string(mf, '|'), 'kfree') AS needs_refcount_fix, {_flag('needs_rcu_fix')} OR len(rf) > 0 AS needs_rcu_fix,
    {_flag('needs_null_check')} OR contains(lower(panic_msg), 'null pointer') AS needs_null_check, {_flag('needs_bound_check')} OR regexp_matches(lower(panic_msg), 'out of bound|overflow') AS needs_bound_check,
    kw || CASE WHEN len(rf) > 0 AND NOT contains(array_to_string(kw, '|'), 'rcu') THEN ['kfree_rcu'] ELSE [] END AS kws FROM (SELECT *, base || CASE WHEN len(lf) > 0 AND NOT contains(array_to_string(base, '|'), 'spin_lock') THEN ['spin_lock', 'mutex_lock'] ELSE [] END AS kw
      FROM (SELECT *, {case('cbug', {b: k for b, (_, k) in kr.FIX_HINTS.items()}, '[]')} AS base FROM rc))""")
oracle("d16_fix_inference", "fx", "SELECT crash_id, needs_lock_fix, needs_refcount_fix, needs_rcu_fix, needs_null_check, needs_bound_check, array_to_string(list_sort(list_distinct(kws)), '|') AS keywords FROM fx")
cte("keyf", "fx fname", """SELECT crash_id, string_agg(f, ', ' ORDER BY o) AS keyf FROM (SELECT crash_id, f, min(o) AS o FROM (
    SELECT crash_id, n AS f, r AS o FROM fname UNION ALL SELECT crash_id, unnest(lf), 1000000 + generate_subscripts(lf, 1) FROM fx
    UNION ALL SELECT crash_id, unnest(mf), 2000000 + generate_subscripts(mf, 1) FROM fx UNION ALL SELECT crash_id, unnest(rf), 3000000 + generate_subscripts(rf, 1) FROM fx) GROUP BY crash_id, f) GROUP BY crash_id""")
_fixs = "concat_ws('; ', " + ", ".join(f"CASE WHEN {k} THEN {v(s)} END" for k, s in kr.FIX_SENTENCES) + ")"
cte("rq", "fx keyf", f"""SELECT fx.*, concat_ws(chr(10), 'RootCause: ' || root_cause, CASE WHEN cbug <> 'unknown' THEN 'BugType: ' || replace(cbug, '_', ' ') END, CASE WHEN subsystem <> 'unknown' THEN 'Subsystem: ' || subsystem END,
    CASE WHEN kernel_version <> '' THEN 'KernelVersion: ' || kernel_version END, CASE WHEN panic_msg <> '' THEN 'PanicInfo: ' || panic_msg END, 'KeyFunctions: ' || keyf, CASE WHEN rip <> '' THEN 'CrashFunction: ' || rip END,
    CASE WHEN {_fixs} <> '' THEN 'FixPattern: commit that ' || {_fixs} END, CASE WHEN len(chain) > 0 THEN 'CausalChain: ' || array_to_string(chain, ' -> ') END) AS retrieval_query FROM fx LEFT JOIN keyf USING (crash_id)""")
oracle("d17_retrieval_query", "rq", "SELECT crash_id, retrieval_query FROM rq")
_lab = "CASE " + " ".join(f"WHEN {' OR '.join(f'regexp_matches(panic_msg, {v(chr(40) + chr(63) + chr(105) + chr(41) + p)})' for p in ps)} THEN {v(l)}" for l, ps in kr.PANIC_LABELS) + " END"
cte("ev", "rc ranked", f"""SELECT *, coalesce(len(list_filter(fixed, lambda x: x = nb)) / len(fixed), 0) AS hist, {_lab} AS panic_keyword, nullif(regexp_extract(panic_msg, {v(kr.FAULT_ADDRESS_PATTERN)}, 1), '') AS fa, nullif(regexp_extract(panic_msg, {v(kr.ERROR_CODE_PATTERN)}), '') AS ec,
    rule_id IS NOT NULL AS hr, round(score * 100, 1) AS tot, regexp_matches(lower(panic_msg), 'virtual address|at 0x') AS hf FROM rc LEFT JOIN (SELECT query_id, list(bug_type) AS fixed FROM ranked GROUP BY query_id) p ON p.query_id = crash_id""")
cte("ev2", "ev", """SELECT *, CASE WHEN hf THEN round(tot * CASE WHEN hr THEN 0.18 ELSE 0.20 END, 1) ELSE 0.0 END AS pf, CASE WHEN subsystem <> 'unknown' THEN round(tot * CASE WHEN hr THEN 0.10 ELSE 0.15 END, 1) ELSE 0.0 END AS ps,
    CASE WHEN len(tr) > 0 THEN round(tot * CASE WHEN hr THEN 0.10 ELSE 0.20 END, 1) ELSE 0.0 END AS pt, CASE WHEN hist > 0 THEN round(hist * 100 * CASE WHEN hr THEN 0.12 ELSE 0.20 END, 1) ELSE 0.0 END AS ph, list_filter([CASE WHEN panic_msg = '' THEN 'Panic Keyword' END, CASE WHEN len(tr) = 0 THEN 'Call Trace' END, CASE WHEN kernel_version = '' THEN 'Kernel Version' END,
      CASE WHEN fixed IS NULL THEN 'Commit Diff' END, CASE WHEN NOT hr THEN 'Expert Rule' END], lambda x: x IS NOT NULL) AS miss, round((CASE WHEN panic_msg <> '' THEN 3 ELSE 0 END + CASE WHEN fa IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN len(tr) > 0 THEN 3 ELSE 0 END
      + CASE WHEN kernel_version <> '' THEN 3 ELSE 0 END + CASE WHEN ec IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN subsystem <> 'unknown' THEN 2 ELSE 0 END + CASE WHEN fixed IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN hr THEN 3 ELSE 0 END) / 21.0 * 100, 1)::DOUBLE AS pct FROM ev""")
oracle("d22_evidence", "ev2", f"""SELECT crash_id, panic_keyword, fa AS fault_address, ec AS error_code, {_rule(1)} AS matched_rule_name, array_to_string(tr, '|') AS frames, round(greatest(0.0, tot - (pf + ps + pt + ph)), 1) AS pct_rule, pf AS pct_fault,
    ps AS pct_subsystem, pt AS pct_trace, ph AS pct_history, pct AS coverage_pct, CASE WHEN pct >= 75 AND len(miss) = 0 THEN 'High' WHEN pct >= 50 AND len(miss) <= 1 THEN 'Medium' ELSE 'Low' END AS reliability, array_to_string(miss, '|') AS missing FROM ev2""")
_ch, _ct = kr.CAUSE_TRACE_FORMAT.split("{funcs}")
oracle("d23_possible_causes", "rc", f"""SELECT crash_id, array_to_string(list_filter([{case('subsystem', kr.SUBSYSTEM_CONTEXTS)}, {case('nb', {k: '|'.join(x) for k, x in kr.POSSIBLE_CAUSES.items()}, v('|'.join(kr.POSSIBLE_CAUSES_DEFAULT)))},
    CASE WHEN len(tr) > 0 THEN concat({v(_ch)}, array_to_string(list_transform(tr, lambda x: split_part(x, '+', 1)), ', '), {v(_ct)}) END], lambda x: x IS NOT NULL), '|') AS causes FROM rc""")
_jx = lambda f: f"CASE WHEN json_valid(answer) THEN json_extract_string(answer, '$.{f}') WHEN json_valid(br) THEN json_extract_string(br, '$.{f}') END"
cte("ans", "answers", f"""SELECT conv_id, turn, answer, ok, {', '.join(f'{_jx(f)} AS {f}' for f in ('subsystem', 'bug_type', 'severity', 'confidence', 'root_cause_hypothesis'))} FROM
    (SELECT *, json_valid(answer) OR (br <> '' AND json_valid(br)) AS ok FROM (SELECT *, regexp_extract(answer, '\\{{[\\s\\S]*\\}}') AS br FROM answers))""")
cte("ans2", "ans", f"""SELECT conv_id, turn, CASE WHEN ok AND subsystem IN {one_of(kr.VALID_SUBSYSTEMS)} THEN subsystem ELSE 'unknown' END AS ss, CASE WHEN ok AND bug_type IN {one_of(kr.VALID_BUG_TYPES)} THEN bug_type ELSE 'unknown' END AS sb,
    CASE WHEN NOT ok THEN 'low' WHEN severity IN {one_of(kr.VALID_SEVERITIES)} THEN severity ELSE 'medium' END AS sev, CASE WHEN NOT ok THEN 0.1 ELSE least(1, greatest(0, coalesce(confidence::DOUBLE, 0.5))) END::DOUBLE AS conf,
    CASE WHEN ok THEN coalesce(root_cause_hypothesis, '') ELSE concat('Failed to parse LLM response: ', answer) END AS hyp, ok FROM ans""")
oracle("d12_model_answers", "ans2", """SELECT conv_id, turn, ss AS said_subsystem, sb AS said_bug, sev AS severity, conf AS confidence, CASE WHEN conf >= 0.5 AND ss <> 'unknown' THEN ss ELSE 'fs' END AS subsystem,
    CASE WHEN conf >= 0.5 AND sb <> 'unknown' THEN sb ELSE 'hang' END AS bug_type, hyp AS hypothesis FROM ans2""")
oracle("x7_structured_output", "ans", "SELECT conv_id, turn, ok, subsystem, severity FROM ans")
oracle("d26_hybrid", "rc ans2", """SELECT crash_id, turn, CASE WHEN conv_id IS NULL THEN 'rule_only (llm failed)' WHEN score >= 0.6 THEN 'hybrid_rule_primary' ELSE 'hybrid_llm_primary' END AS analysis_source,
    CASE WHEN conv_id IS NOT NULL AND score < 0.6 AND hyp <> '' THEN hyp ELSE root_cause END AS root_cause, CASE WHEN conv_id IS NOT NULL AND score < 0.6 AND sb <> 'unknown' THEN sb ELSE nb END AS bug_type,
    round(CASE WHEN conv_id IS NOT NULL AND score < 0.6 AND conf > score THEN conf ELSE score END, 4) AS score,
    CASE WHEN conv_id IS NULL THEN array_to_string(chain, '|') WHEN score >= 0.6 THEN concat(array_to_string(chain, '|'), '|[LLM] step one|[LLM] step two') ELSE 'step one|step two' END AS chain
    FROM rc LEFT JOIN ans2 ON conv_id = crash_id""")
values("dsub(o, label, w)", words(kr.DUMP_SUBSYSTEM_HINTS))
cte("dmp", "dumps dsub", f"""SELECT d.*, coalesce(s, 'unknown') AS ds, CASE WHEN {_hit('t', kr.DUMP_LOCK_FUNCTIONS)} THEN 'deadlock' WHEN {_hit('t', kr.DUMP_MEMORY_FUNCTIONS)} THEN 'memory_corruption' ELSE 'unknown' END AS db FROM
    (SELECT *, lower(array_to_string(dump_trace, chr(10))) AS t FROM dumps) d LEFT JOIN (SELECT crash_id, arg_min(label, o) AS s FROM dumps JOIN dsub ON contains(lower(array_to_string(dump_trace, chr(10))), w) GROUP BY crash_id) USING (crash_id)""")
oracle("d28_fuse_dump_and_log", "dmp d11", """SELECT coalesce(d.crash_id, l.crash_id) AS crash_id, coalesce(nullif(ds, 'unknown'), subsystem, 'unknown') AS subsystem, coalesce(nullif(db, 'unknown'), bug_type, 'unknown') AS bug_type,
    array_to_string(CASE WHEN len(dump_trace) > 0 THEN dump_trace ELSE coalesce(tr, []) END, '|') AS trace, coalesce(nullif(panic_msg, ''), dump_panic, '') AS panic_msg, coalesce(nullif(dump_version, ''), kernel_version, '') AS kernel_version,
    array_to_string(list_sort(list_distinct(coalesce(dump_modules, []) || coalesce(modules, []))), '|') AS modules FROM dmp d FULL JOIN d11 l ON d.crash_id = l.crash_id""")
cte("v3", "crashes", f"SELECT crash_id, kv, regexp_extract(kv, '(\\d+)\\.(\\d+)', 1) AS a, regexp_extract(kv, '(\\d+)\\.(\\d+)', 2) AS b, regexp_replace(kv, '[-+].*', '') AS c FROM (SELECT crash_id, {_kv} AS kv FROM crashes)")
oracle("v3_parse_versions", "v3", """SELECT crash_id, CASE WHEN a <> '' THEN concat(a::INT, '.', b::INT, '.0') END AS normalized, nullif(a, '')::BIGINT AS major, nullif(b, '')::BIGINT AS minor,
    CASE WHEN c = '' THEN NULL WHEN [split_part(c, '.', 1)::INT, split_part(c, '.', 2)::INT, coalesce(nullif(split_part(c, '.', 3), ''), '0')::INT] < [5, 15, 0] THEN -1
      WHEN [split_part(c, '.', 1)::INT, split_part(c, '.', 2)::INT, coalesce(nullif(split_part(c, '.', 3), ''), '0')::INT] = [5, 15, 0] THEN 0 ELSE 1 END::BIGINT AS vs_5_15 FROM v3""")

# --- vectors and ranking ------------------------------------------------------------------------

_targets = ", ".join(f"{e.replace('{arr}', 'list_value')} AS {n}" for n, e in cat.TARGETS)
cte("lq", "", f"""SELECT label::BIGINT AS query_id, q, {_targets} FROM (SELECT label, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM
    (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)""")
cte("vi", "an", """SELECT vec_id AS id, embedding::DOUBLE[] AS vec, an.* EXCLUDE (subsystem, bug_type, score), coalesce(subsystem, 'unknown') AS subsystem, coalesce(bug_type, 'unknown') AS bug_type FROM embeddings LEFT JOIN an ON doc_id = vec_id""")
cte("sims", "lq", "SELECT query_id, vec_id AS id, round(list_inner_product(embedding::DOUBLE[], q), 6) AS s FROM lq CROSS JOIN embeddings")
cte("rk", "sims", "SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM sims")
_top = lambda k, extra="": f"SELECT query_id, id, round(s, 6) AS score, rank::BIGINT AS rank FROM rk WHERE rank <= {k}{extra}"
oracle("r2_topk", "rk", _top(10, " AND query_id = 3"))
oracle("r10_batch_topk", "rk", _top(50))
oracle("r3_auto_index", "rk", _top(20))
oracle("r5_prefilter", "sims vi", """SELECT query_id, id, rank::BIGINT AS rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM sims JOIN vi USING (id)
    WHERE subsystem IN ('mm', 'fs', 'block', 'kernel') AND bug_type = 'use_after_free' AND date >= '2017-01-01' AND date <= '2024-12-31') WHERE rank <= 10""")
oracle("r4_postfilter", "rk vi", "SELECT query_id, id, bug_type, round(s, 6) AS distance FROM rk JOIN vi USING (id) WHERE rank <= 50 AND bug_type = 'memory_leak'")
oracle("r11_recall_stats", "rk", "SELECT query_id, count(*) AS hit_count, round(avg(s), 5) AS avg_distance FROM rk WHERE rank <= 100 GROUP BY query_id")
oracle("r11_recall_counts", "rk vi", """SELECT query_id, facet, value, n, row_number() OVER (PARTITION BY query_id, facet ORDER BY n DESC, value) AS place FROM (SELECT query_id, 'subsystem' AS facet, subsystem AS value, count(*) AS n FROM rk JOIN vi USING (id)
    WHERE rank <= 100 GROUP BY ALL UNION ALL SELECT query_id, 'bug_type', bug_type, count(*) FROM rk JOIN vi USING (id) WHERE rank <= 100 GROUP BY ALL)""")
oracle("p28_confirmed_fixes", "an", f"""SELECT doc_id, lk OR lock_added AS needs_lock_fix, rf OR refcount_fix AS needs_refcount_fix, rc OR rcu_fix AS needs_rcu_fix, array_to_string(list_sort(list_distinct(base
    || CASE WHEN lock_added THEN ['spin_lock', 'mutex_lock', 'lock_irqsave'] ELSE [] END || CASE WHEN refcount_fix THEN ['kref_get', 'kref_put', 'refcount_inc', 'refcount_dec'] ELSE [] END
    || CASE WHEN rcu_fix THEN ['kfree_rcu', 'synchronize_rcu', 'rcu_read_lock', 'rcu_read_unlock'] ELSE [] END)), '|') AS keywords FROM (SELECT *, {case('bug_type', {b: k for b, (_, k) in kr.FIX_HINTS.items()}, '[]')} AS base,
      {', '.join(f"bug_type IN {one_of([b for b, (f, _) in kr.FIX_HINTS.items() if k in f])} AS {n}" for k, n in (('needs_lock_fix', 'lk'), ('needs_refcount_fix', 'rf'), ('needs_rcu_fix', 'rc')))} FROM an)""")
oracle("a8_usage", "", """SELECT coalesce(role, 'unknown') AS role, count(*) AS calls, sum(length(coalesce(text, '')))::BIGINT AS characters,
    sum(len(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')))::BIGINT AS words FROM conversations GROUP BY 1""")
oracle("u11_flatten", "", "SELECT doc_id, lang AS meta_lang, source AS meta_of_source, n_chars AS meta_of_n_chars FROM documents")
oracle("g12_lock_fix", "", f"""SELECT p_partkey, kind, {case('kind', kn.LOCK_FIXES, v(kn.LOCK_FIX_DEFAULT))} AS fix FROM (SELECT p_partkey, ([{', '.join(v(k) for k in [*kn.LOCK_FIXES, 'other'])}])[(p_partkey % 9 + 1)::INT] AS kind FROM part)""")
oracle("a1_facets", "an", """SELECT 'subsystem' AS facet, subsystem AS value, count(*) AS n FROM an GROUP BY ALL UNION ALL SELECT 'bug_type', bug_type, count(*) FROM an GROUP BY ALL
    UNION ALL SELECT 'kernel_version', coalesce(kver, 'unknown'), count(*) FROM an GROUP BY ALL""")


def tokens(src, key, text):
    return f"""SELECT {key} AS k, b, count(*) AS n FROM (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 512 AS b FROM (SELECT {key}, unnest(regexp_split_to_array(lower({text}), '[^{W}]+')) AS t FROM {src}) WHERE t <> '') GROUP BY ALL"""


cte("ctok", "etext", tokens("etext", "doc_id", "embedding_text"))
cte("cnorm", "ctok", "SELECT k, sqrt(sum(n * n)) AS z FROM ctok GROUP BY k")
cte("btok", "", tokens("benchmark", "item_id", "text"))
oracle("r12_similar_commits", "ctok cnorm btok", """SELECT query_id, id, round(s, 6) AS score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (
    SELECT q.k AS query_id, c.k AS id, round(coalesce(d, 0) / (q.z * c.z), 6) AS s FROM (SELECT k, sqrt(sum(n * n)) AS z FROM btok GROUP BY k) q CROSS JOIN cnorm c
    LEFT JOIN (SELECT b1.k AS qk, c1.k AS ck, sum(b1.n * c1.n)::DOUBLE AS d FROM btok b1 JOIN ctok c1 USING (b) GROUP BY ALL) ON qk = q.k AND ck = c.k)) WHERE rank <= 10""")
oracle("s12_normalize_and_number", "", """SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS row_no, round(list_inner_product(e, e) / (z * z), 5) AS norm, round(e[1] / z, 5) AS x0
    FROM (SELECT vec_id, e, sqrt(list_inner_product(e, e)) + 1e-8 AS z FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))""")
oracle("s13_store_rows", "an", """SELECT commit_hash, subject, subsystem, bug_type, author, date, array_to_string(files_changed, ', ') AS files_changed,
    array_to_string(fix_tags, ', ') AS fix_tags, score FROM an""")
oracle("f1_dedupe", "commits", """SELECT doc_id, CASE WHEN commit_hash = '' OR row_number() OVER (PARTITION BY commit_hash ORDER BY pos) = 1 THEN 'passed' ELSE 'rejected' END AS verdict FROM commits""")


def allowed_sub(t, rel=True):
    s = [t] + [p for p, cs in kn.FILTER_HIERARCHY.items() if t in cs] + (kn.FILTER_RELATED.get(t, []) if rel else [])
    return f"subsystem IN {one_of(s)}"


def allowed_bug(t):
    return f"bug_type IN {one_of(kn.BUG_TYPE_GROUPS.get(t, [t]))}"


_pr = lambda c: f"CASE WHEN {c} THEN 'passed' ELSE 'rejected' END"
cte("anv", "an rel", r"""SELECT an.*, regexp_extract(concat(subject, ' ', body), '(?:^|\s)(?:v|linux-)?(\d+)\.(\d+)', 1) AS ta, regexp_extract(concat(subject, ' ', body), '(?:^|\s)(?:v|linux-)?(\d+)\.(\d+)', 2) AS tb, da, db
    FROM an LEFT JOIN (SELECT doc_id, arg_max(a, a * 100 + b) AS da, arg_max(b, a * 100 + b) AS db FROM an JOIN rel ON d <= substr(date, 1, 10) GROUP BY doc_id) USING (doc_id)""")


def vver(a, b, tol=1, strict=False):
    un = "'rejected'" if strict else "'uncertain'"
    return f"""CASE WHEN kmajor IS NOT NULL THEN CASE WHEN kmajor > {a} THEN 'uncertain' ELSE 'passed' END WHEN ta <> '' THEN CASE WHEN ta::HUGEINT = {a} AND abs(tb::HUGEINT - {b}) <= {tol} THEN 'passed' ELSE 'rejected' END
      WHEN da IS NULL THEN {un} WHEN da - {a} > 1 THEN 'rejected' WHEN da > {a} THEN {un} WHEN da = {a} AND db > {b} + {tol} THEN 'rejected' ELSE 'passed' END"""


oracle("f2_scalar_verdicts", "anv", f"""SELECT doc_id, {_pr(allowed_sub('rcu'))} AS rcu, {_pr(allowed_sub('mm'))} AS mm, {_pr(allowed_sub('mm', False))} AS mm_only, {_pr(allowed_bug('use_after_free'))} AS uaf, {_pr("bug_type = 'race_condition'")} AS race,
    {vver(5, 4)} AS v54, {vver(4, 19, 1, True)} AS v419, 'passed' AS vjunk, {_pr("regexp_matches(lower(subject), 'fix|leak')")} AS any_kw, {_pr("contains(lower(subject), 'fix') AND contains(lower(subject), 'leak')")} AS all_kw FROM anv""")
_boost = """CASE WHEN list_contains(fix_tags, 'CVE') THEN 1.44 WHEN contains(lower(subject), 'fixes:') OR list_contains(fix_tags, 'Fixes') THEN 1.2 WHEN list_contains(fix_tags, 'security') THEN 1.32 ELSE 1.0 END"""


def vweight(a, b):
    d = f"((kmajor - {a}) * 1000 + kminor - {b})"
    return f"CASE WHEN kmajor IS NULL THEN 0.9 WHEN {d} = 0 THEN 1.3 WHEN {d} IN (1, 2) THEN 1.15 WHEN {d} BETWEEN 3 AND 5 THEN 1.0 WHEN {d} >= 6 THEN 0.7 ELSE 1.0 END"


oracle("w2_boosts", "an", f"SELECT doc_id, round(score * {_boost}, 4)::DOUBLE AS boosted, ({vweight(5, 10)})::DOUBLE AS weight FROM an")
oracle("f6_filter_chain", "anv", f"""SELECT doc_id, vv = 'uncertain' AS uncertain, w::DOUBLE AS version_weight, round(score * {_boost} * w, 4)::DOUBLE AS boosted FROM (SELECT *, {vver(5, 10)} AS vv, {vweight(5, 10)} AS w,
    commit_hash = '' OR row_number() OVER (PARTITION BY commit_hash ORDER BY pos) = 1 AS uniq FROM anv) WHERE uniq AND {allowed_sub('fs')} AND {allowed_bug('use_after_free')} AND vv <> 'rejected' AND contains(lower(subject), 'fix')""")
cte("cand", "rk vi lq anv", f"""SELECT r.query_id, r.rank AS pos, r.id, r.s AS distance, CASE WHEN mx > 1 AND s > 0 THEN round(s / mx, 4) ELSE greatest(0, least(1, s)) END AS score0, vi.* EXCLUDE (id, vec, pos), ta, tb, da, db, lq.* EXCLUDE (query_id, q),
    CASE WHEN regexp_matches(target_version, '\\d+\\.\\d+') THEN regexp_extract(target_version, '(\\d+)\\.(\\d+)', 1)::INT END AS tmaj, CASE WHEN regexp_matches(target_version, '\\d+\\.\\d+') THEN regexp_extract(target_version, '(\\d+)\\.(\\d+)', 2)::INT END AS tmin
    FROM (SELECT *, max(s) OVER (PARTITION BY query_id) AS mx FROM rk WHERE rank <= 100) r JOIN vi USING (id) JOIN lq USING (query_id) LEFT JOIN (SELECT doc_id, ta, tb, da, db FROM anv) x ON x.doc_id = r.id""")
_subq = "CASE target_subsystem " + " ".join(f"WHEN {v(t)} THEN {allowed_sub(t)}" for t in ("net", "mm", "drivers", "block", "rcu", "fs", "kernel")) + " ELSE TRUE END"
_bugq = "CASE target_bug_type " + " ".join(f"WHEN {v(t)} THEN {allowed_bug(t)}" for t in ("null_pointer", "use_after_free", "memory_leak", "race_condition", "double_free")) + " ELSE TRUE END"
cte("filt", "cand", f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(boosted, 10) DESC, unc, pos) AS ord FROM (SELECT *, score0 * CASE WHEN fix_tags IS NULL THEN 1.0 ELSE {_boost} END * w AS boosted, vv = 'uncertain' AS unc FROM (
    SELECT *, CASE WHEN tmaj IS NULL THEN 'passed' WHEN ta IS NULL AND kmajor IS NULL THEN 'uncertain' ELSE {vver('tmaj', 'tmin')} END AS vv, CASE WHEN tmaj IS NULL THEN 1.0 ELSE {vweight('tmaj', 'tmin')} END AS w,
      coalesce(commit_hash, '') = '' OR row_number() OVER (PARTITION BY query_id, commit_hash ORDER BY pos) = 1 AS uniq FROM cand) WHERE uniq AND {_subq} AND {_bugq} AND vv <> 'rejected')""")
oracle("k15_fast", "filt", "SELECT query_id, ord::BIGINT AS rank, id, round(score0, 6)::DOUBLE AS final_score, round(boosted, 10)::DOUBLE AS boosted FROM filt")
_wsplit = lambda t: f"list_distinct(list_filter(regexp_split_to_array(lower({t}), '{SP}+'), lambda x: x <> ''))"
cte("rr", "filt", f"""SELECT *, CASE WHEN len(qw) = 0 THEN 0.5 ELSE len(list_intersect(qw, {_wsplit('doc')})) / len(qw) END AS rer, CASE WHEN mb IS NULL THEN boosted WHEN mb > 1 OR mb < 0.01 THEN round(least(0.99, boosted / mb), 4) ELSE greatest(0, least(1, boosted)) END AS vs0
    FROM (SELECT *, {_wsplit('query_text')} AS qw, max(boosted) FILTER (boosted > 0) OVER (PARTITION BY query_id) AS mb, concat('[', subsystem, '] [', bug_type, '] ', subject,
      CASE WHEN len(fix_tags) > 0 THEN concat(' Fixes: [''', array_to_string(fix_tags, ''', '''), ''']') ELSE '' END) AS doc FROM filt)""")
cte("ranked", "rr", """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fin DESC, ord) AS rank FROM (SELECT *, greatest(0, least(1, vs0)) AS vs, round(greatest(0, least(1, 0.2 * greatest(0, least(1, vs0)) + 0.4 * coalesce(rer, 0.5) + 0.4 * 0.5)), 12) AS fin FROM rr)""")
oracle("k15_standard", "ranked", """SELECT query_id, rank::BIGINT AS rank, id, round(vs, 10)::DOUBLE AS vector_score, round(rer, 10)::DOUBLE AS reranker_score, round(fin, 12)::DOUBLE AS final_score,
    concat_ws('; ', CASE WHEN fin >= 0.85 THEN '高度匹配' WHEN fin >= 0.7 THEN '显著相关' WHEN fin >= 0.5 THEN '中度相关' ELSE '低度相关' END, concat('子系统=', subsystem), concat('Bug类型=', bug_type), CASE WHEN rer >= 0.8 THEN '语义高度相似' END) AS rank_reason FROM ranked""")


def relpairs(t):
    return one_of([f"{k}>{s}" for k, xs in t.items() for s in xs])


_ccat = "concat(target_subsystem, '>', subsystem)"
_pcat = "concat(subsystem, '>', target_subsystem)"
cte("bd", "ranked", f"""SELECT *, CASE WHEN target_bug_type IN ('', 'unknown') THEN 0.5 WHEN bug_type = target_bug_type THEN 0.95 WHEN rule_id <> '' THEN 0.7 ELSE 0.3 END AS er,
    CASE WHEN len(crash_trace) = 0 THEN 0.3 WHEN len(list_filter(coalesce(files_changed, []), lambda x: contains(lower(array_to_string(crash_trace, ' ')), lower(x)))) > 0 THEN 0.9 WHEN len(list_filter(coalesce(functions, []), lambda x: contains(lower(array_to_string(crash_trace, ' ')), lower(x)))) > 0 THEN 1.0
      WHEN subsystem = target_subsystem THEN 0.5 ELSE 0.1 END AS cs, CASE WHEN subsystem = target_subsystem THEN 1.0 WHEN {_ccat} IN {relpairs(kn.FILTER_HIERARCHY)} THEN 0.8 WHEN {_pcat} IN {relpairs(kn.FILTER_HIERARCHY)} THEN 0.75
      WHEN {_ccat} IN {relpairs(kn.FILTER_RELATED)} THEN 0.6 WHEN {_pcat} IN {relpairs(kn.FILTER_RELATED)} THEN 0.55 ELSE 0.2 END AS ss, (kmajor - cm) * 1000 + kminor - cn AS gap FROM (SELECT *,
      CASE WHEN regexp_matches(target_version, '^[2-7]\\.\\d+') THEN split_part(target_version, '.', 1)::INT END AS cm, CASE WHEN regexp_matches(split_part(target_version, '.', 2), '^\\d+$') THEN split_part(target_version, '.', 2)::INT END AS cn FROM ranked)""")
_vm = "CASE WHEN gap IS NULL THEN 0.5 WHEN gap = 0 THEN 1.0 WHEN gap IN (1, 2) THEN 0.9 WHEN gap BETWEEN 3 AND 5 THEN 0.7 WHEN gap > 5 THEN 0.5 ELSE 0.65 END"
oracle("k7_breakdown", "bd", f"""SELECT query_id, rank::BIGINT AS rank, er::DOUBLE AS expert_rule_score, cs::DOUBLE AS callstack_match_score, ss::DOUBLE AS subsystem_match_score, ({_vm})::DOUBLE AS version_match_score,
    round((({_vm}) - 1.0) * 0.1, 4)::DOUBLE AS version_penalty, round(cs * 0.1, 4)::DOUBLE AS callstack_part FROM bd""")
oracle("k14_version_analysis", "bd rel", """SELECT query_id, rank::BIGINT AS rank, CASE WHEN cm IS NULL OR cn IS NULL THEN 'Unknown — Crash Kernel Version 未提供' WHEN gap IS NULL THEN 'Unknown' WHEN gap = 0 THEN 'Same Version' WHEN gap BETWEEN 1 AND 5 THEN concat(gap, ' Minor Release')
      WHEN gap > 5 THEN concat(gap, ' Minor Release (Cross Minor)') ELSE concat(abs(gap), ' Minor Release Behind') END AS version_distance, CASE WHEN gap IS NULL THEN 'Unknown' WHEN gap BETWEEN 0 AND 2 THEN 'High' WHEN gap BETWEEN 3 AND 5 OR gap < 0 THEN 'Medium' ELSE 'Low' END AS compatibility,
    CASE WHEN cm IS NULL OR cn IS NULL THEN -1 WHEN gap IS NULL THEN 0 ELSE abs(gap) END::BIGINT AS distance_value, CASE WHEN kmajor IS NOT NULL THEN concat(kmajor, '.', kminor, '.0') END AS patch_kernel_version,
    CASE WHEN cm IS NOT NULL THEN (SELECT d FROM rel WHERE a = cm AND b = cn) END AS crash_release_date FROM bd""")
_num = lambda x, n: f"printf('%.{n}f', {x})"
oracle("k13_why_not", "ranked", f"""SELECT query_id, rank::BIGINT AS rank, CASE WHEN rank > 1 THEN array_to_string(sa, '|') END AS same, CASE WHEN rank > 1 THEN array_to_string(dlist, '|') END AS different,
    CASE WHEN rank > 1 THEN concat('综合 ', len(dlist), ' 个差异维度 vs ', len(sa), ' 个相同维度，排名第 ', rank, '（综合分差 ', {_num('f1 - fin', 4)}, '）') END AS ranking_reason, CASE WHEN rank > 1 THEN round(f1 - fin, 12) END::DOUBLE AS gap FROM (SELECT *, list_filter([
      CASE WHEN bug_type = b1 AND bug_type <> 'unknown' THEN concat('同属于 ', bug_type, ' 修复') END, CASE WHEN subsystem = s1 AND subsystem <> 'unknown' THEN concat('同一子系统 ', subsystem) END,
      CASE WHEN vs = v1 THEN 'Embedding 相似度相同，差异来自后续排序阶段' END, CASE WHEN abs(w - w1) > 0.01 AND w > w1 THEN concat('版本兼容性相当 (权重 ', {_num('w', 2)}, ' vs Top1 ', {_num('w1', 2)}, ')') END], lambda x: x IS NOT NULL) AS sa, list_filter([
      CASE WHEN bug_type <> b1 THEN concat('Bug 类型不同 (', bug_type, ' vs ', b1, ')，Top-1 更匹配当前根因') END, CASE WHEN subsystem <> s1 THEN concat('属于 ', subsystem, ' 子系统，与崩溃子系统关联度低于 ', s1) END,
      concat('综合评分: Top1=', {_num('f1', 3)}, ' vs Top', rank, '=', {_num('fin', 3)}, ' (差 ', {_num('f1 - fin', 4)}, ')'), CASE WHEN vs <> v1 THEN concat('Embedding 相似度: Top1=', {_num('v1', 3)}, ' > Top', rank, '=', {_num('vs', 3)}) END,
      concat('Cross Encoder 重排: Top1=', {_num('r1', 3)}, ' vs Top', rank, '=', {_num('rer', 3)}, ' (差 ', {_num('r1 - rer', 4)}, ')'), CASE WHEN abs(w - w1) > 0.01 THEN CASE WHEN w < w1 THEN concat('版本兼容性较低 (权重 ', {_num('w', 2)}, ' vs Top1 ', {_num('w1', 2)}, ')') END
        WHEN w <> 1.0 THEN concat('版本匹配权重 ', {_num('w', 2)}, ' (偏离中性值 1.0)') END], lambda x: x IS NOT NULL) AS dlist
    FROM (SELECT *, first_value(bug_type) OVER x AS b1, first_value(subsystem) OVER x AS s1, first_value(vs) OVER x AS v1, first_value(rer) OVER x AS r1, first_value(w) OVER x AS w1, first_value(fin) OVER x AS f1 FROM ranked WINDOW x AS (PARTITION BY query_id ORDER BY rank)))""")
oracle("k15_deep", "rr", """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY fin DESC, ord)::BIGINT AS rank, id, j AS judge_score, CASE WHEN ord - 1 = query_id % 3 THEN 'same lock' WHEN ord = 5 THEN '' WHEN ord = 62 THEN 'far' ELSE 'Not found in response' END AS judge_reason, fin::DOUBLE AS final_score
    FROM (SELECT *, round(greatest(0, least(1, 0.2 * greatest(0, least(1, vs0)) + 0.4 * coalesce(rer, 0.5) + 0.4 * j)), 12) AS fin FROM (SELECT *, CASE WHEN ord - 1 = query_id % 3 THEN 0.9 WHEN ord = 5 THEN 0.1 WHEN ord = 62 THEN 0.8 ELSE 0.5 END::DOUBLE AS j FROM rr))""")
oracle("k3_judge_answers", "", f"""SELECT conv_id, turn, i::BIGINT AS index, CASE WHEN z = 0 AND i = conv_id % 5 THEN 0.75 ELSE 0.5 END::DOUBLE AS judge_score, CASE WHEN z = 2 THEN 'Parse failed' WHEN z = 0 AND i = conv_id % 5 THEN said ELSE 'Not found in response' END AS judge_reason
    FROM (SELECT conv_id, turn, {vw.QUOTED} AS said, (conv_id + turn) % 3 AS z, unnest(range(5)) AS i FROM conversations)""")
oracle("a6_normalizers", "", """SELECT event_id, round(nv, 6) AS normalized, round(1000 * exp(nv - mx) / sum(exp(nv - mx)) OVER (PARTITION BY event_type), 6) AS permille FROM (SELECT *, max(nv) OVER (PARTITION BY event_type) AS mx FROM (
    SELECT event_id, event_type, CASE WHEN hi = lo THEN 0.5 ELSE (value - lo) / (hi - lo) END AS nv FROM (SELECT *, min(value) OVER (PARTITION BY event_type) AS lo, max(value) OVER (PARTITION BY event_type) AS hi FROM events)))""")
cte("x1", "ranked", """SELECT *, CASE WHEN coalesce(functions[1], '') <> '' THEN functions[1] WHEN instr(subject, ':') > 0 THEN regexp_extract(subject, '(\\w+)\\s*\\(\\)', 1) ELSE '' END AS ft,
    coalesce(nullif(CASE WHEN lock_added OR refcount_fix OR rcu_fix THEN concat_ws(', ', CASE WHEN lock_added THEN 'add_lock' END, CASE WHEN refcount_fix THEN 'fix_refcount' END, CASE WHEN rcu_fix THEN 'add_rcu_sync' END)
      ELSE concat_ws(', ', CASE WHEN contains(tg, 'null') THEN 'NULL check' END, CASE WHEN regexp_matches(tg, 'overflow|bound') THEN 'bound check' END, CASE WHEN contains(tg, 'leak') THEN 'fix leak' END) END, ''), 'unknown') AS fm,
    coalesce(nullif(array_to_string(list_sort(list_distinct(list_transform(list_filter(files_changed, lambda x: contains(x, '/')), lambda x: split_part(x, '/', 1)))), ', '), ''), 'unknown') AS ap,
    concat_ws('|', CASE WHEN subsystem <> 'unknown' AND subsystem = target_subsystem THEN 'same subsystem' END, CASE WHEN bug_type <> 'unknown' AND bug_type = target_bug_type THEN 'same bug' END,
      CASE WHEN len(sh) > 0 THEN 'same path: ' || array_to_string(sh, ', ') END, CASE WHEN list_contains(fix_tags, 'stable') THEN 'Cc: stable' END) AS rs FROM (SELECT *, lower(array_to_string(fix_tags, ' ')) AS tg,
      list_sort(list_distinct(list_filter(functions, lambda x: length(x) > 3 AND contains(lower(array_to_string(crash_trace, chr(10))), lower(x))))) AS sh FROM ranked)""")
oracle("x1_patch_explain", "x1", """SELECT query_id, rank::BIGINT AS rank, ft AS fix_target, fm AS fix_method, ap AS affected_path, rs AS reasons, round(CASE WHEN subsystem <> 'unknown' AND subsystem = target_subsystem THEN 0.6 ELSE 0 END
    + CASE WHEN bug_type <> 'unknown' AND bug_type = target_bug_type THEN 0.4 ELSE 0 END, 2)::DOUBLE AS rep_expert, CASE WHEN len(sh) > 0 THEN 0.2 ELSE 0.0 END::DOUBLE AS rep_callstack, round(least(len(functions) / 10.0, 1), 2)::DOUBLE AS rep_functions,
    round(round(least(vs / coalesce(nullif(max(vs) OVER (PARTITION BY query_id), 0), 1), 1), 2), 1)::DOUBLE AS rep_embedding,
    round(round(least(rer / coalesce(nullif(max(rer) OVER (PARTITION BY query_id), 0), 1), 1), 2), 1)::DOUBLE AS rep_rerank,
    concat_ws('|', CASE WHEN subsystem <> 'unknown' AND subsystem = target_subsystem THEN subsystem || '子系统一致' END, CASE WHEN bug_type <> 'unknown' AND bug_type = target_bug_type THEN bug_type || '一致' END,
      CASE WHEN contains(rs, 'same path') THEN '调用路径一致' END, CASE WHEN contains(rs, 'stable') THEN 'Cc: stable 标记' END) AS rank_reasons FROM x1""")
_dims = [(0, "子系统", "subsystem"), (1, "Bug类型", "bug_type"), (2, "Embedding", "printf('%.3f', vs)"), (3, "Rerank", "printf('%.3f', rer)"), (4, "修复方法", "fm"), (5, "内核版本", "coalesce(kver, '')"), (6, "匹配原因", "coalesce(nullif(replace(rs, '|', '; '), ''), '无')")]
oracle("x2_comparison", "x1", " UNION ALL ".join(f"""SELECT query_id, {o}::BIGINT AS ord, {v(d)} AS dimension, {", ".join(f"max(CASE WHEN rank = {r} THEN {e} END) AS top{r}" for r in range(1, 6))} FROM x1 GROUP BY query_id""" for o, d, e in _dims))
oracle("x5_reports", "rc ranked", f"""SELECT crash_id, {_svl} AS severity, {_pc} AS panic_class, coalesce(n, 0)::BIGINT AS n_patches, root_cause AS json_cause, concat_ws(chr(10), '# Kernel Crash Report', concat('**Panic Type**: ', {_pc}), concat('**Severity**: ', {_svl}),
    concat('**Subsystem**: ', subsystem), concat('**Root Cause**: ', root_cause), array_to_string(list_transform(chain, lambda x, i: concat(i, '. ', x)), chr(10)), CASE WHEN n IS NULL THEN '*(No matching patches found)*' ELSE concat('| # | Commit | Subsystem | Bug Type | Score | Subject |',
      chr(10), '|---|--------|-----------|----------|-------|---------|', chr(10), coalesce(rows, '')) END) AS report_markdown FROM (SELECT *, lower(panic_msg) AS pm FROM rc) LEFT JOIN (SELECT query_id, count(*) AS n, string_agg('| ' || rank || ' | `' || commit_hash || '` | ' || subsystem || ' | '
        || bug_type || ' | ' || {_num('fin', 3)} || ' | ' || subject || ' |', chr(10) ORDER BY rank) AS rows FROM ranked GROUP BY query_id) ON query_id = crash_id""")

oracle("x3_evidence_summary", "x1", r"""SELECT query_id, string_agg(concat('Evidence ', rank, ':', chr(10), '  Crash:  ', CASE WHEN len(crash_trace) = 0 THEN 'unknown' ELSE
    array_to_string(list_sort(list_transform(crash_trace, lambda x: split_part(x, '+', 1))), ', ') END, chr(10), '  Patch:  ', coalesce(nullif(ft, ''), nullif(array_to_string(functions, ', '), ''), 'unknown'), chr(10),
    '  共同:   ', coalesce(nullif(replace(rs, '|', '; '), ''), 'N/A'), chr(10)), chr(10) ORDER BY rank) AS evidence_summary FROM x1 GROUP BY query_id""")
oracle("x3_evidence_table", "rc ranked", """SELECT crash_id, (u).o::BIGINT AS ord, (u).f AS field, coalesce((u).x, 'N/A') AS value, CASE WHEN (u).x IS NULL THEN 'Unavailable' ELSE 'Available' END AS status FROM (SELECT crash_id, unnest([
    {'o': 0, 'f': 'Rule Match', 'x': coalesce(rule_id, 'unknown')}, {'o': 1, 'f': 'Bug Type', 'x': nb}, {'o': 2, 'f': 'Subsystem', 'x': subsystem}, {'o': 3, 'f': 'Embedding Score', 'x': CASE WHEN vs IS NOT NULL THEN printf('%.2f', vs) END},
    {'o': 4, 'f': 'Rerank Score', 'x': CASE WHEN rer IS NOT NULL THEN printf('%.3f', rer) END}, {'o': 5, 'f': 'Call Trace', 'x': nullif(array_to_string(tr, ', '), '')}, {'o': 6, 'f': 'Kernel Version', 'x': nullif(kernel_version, '')}]) AS u
    FROM (SELECT rc.crash_id, rc.rule_id, nb, rc.subsystem, tr, rc.kernel_version, vs, rer FROM rc LEFT JOIN (SELECT query_id, vs, rer FROM ranked WHERE rank = 1) r ON r.query_id = rc.crash_id))""")
oracle("g15_bug_context", "an bk", f"""SELECT doc_id, coalesce({case("pattern", {k: f"## {p['name']}{chr(10)}**Severity**: {p['severity']}{chr(10)}**Category**: {p['category']}{chr(10)}{chr(10)}### Typical Symptoms{chr(10)}" + chr(10).join('- ' + x for x in p['symptoms'])
    + f"{chr(10)}{chr(10)}### Common Causes{chr(10)}" + chr(10).join('- ' + x for x in p['causes']) + f"{chr(10)}{chr(10)}### Fix Patterns{chr(10)}" + chr(10).join('- ' + x for x in p['fixes']) + f"{chr(10)}{chr(10)}### Detection Tools{chr(10)}{', '.join(p['tools'])}{chr(10)}{chr(10)}### Related Subsystems{chr(10)}{', '.join(p['subsystems'])}" for k, p in kn.BUG_PATTERNS.items()})},
    concat('Bug type ' || chr(39), bug_type, chr(39) || ' not found in knowledge base.')) AS bug_context FROM (SELECT doc_id, bug_type, coalesce(CASE WHEN bug_type IN {one_of(_keys)} THEN bug_type END,
    (SELECT arg_min(k, o) FROM bk WHERE contains(bug_type, k) OR contains(k, bug_type))) AS pattern FROM an)""")
oracle("g15_contexts", "an si related", """SELECT doc_id, CASE WHEN title IS NULL THEN concat('Subsystem ''', subsystem, ''' not found.') ELSE concat('## Subsystem: ', title, ' (', subsystem, ')', chr(10), chr(10), '**Key Functions**: ',
    array_to_string(fs, ', '), chr(10), '**Common Bug Types**: ', array_to_string(bugs, ', '), chr(10), chr(10), '**Related Subsystems**: ',
    array_to_string(list_filter(string_split(relp, '|'), lambda x: x <> subsystem), ', ')) END AS subsystem_context FROM an LEFT JOIN si ON si.n = subsystem JOIN related r ON r.n = subsystem""")
cte("kq", "an", """SELECT min(doc_id) AS qid, subsystem AS tsb, concat('RootCause: ', replace(bug_type, '_', ' '), chr(10), 'BugType: ', bug_type, CASE WHEN subsystem <> 'unknown' THEN concat(chr(10), 'Subsystem: ', subsystem) ELSE '' END) AS qt
    FROM an GROUP BY subsystem, bug_type""")
cte("kqtok", "kq", tokens("kq", "qid", "qt"))
cte("kqtop", "kqtok ctok cnorm", """SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS pos FROM (SELECT q.k AS qid, c.k AS id, round(coalesce(d, 0) / (q.z * c.z), 6) AS s FROM (SELECT k, sqrt(sum(n * n)) AS z FROM kqtok GROUP BY k) q
    CROSS JOIN cnorm c LEFT JOIN (SELECT a.k AS qk, b.k AS ck, sum(a.n * b.n)::DOUBLE AS d FROM kqtok a JOIN ctok b USING (b) GROUP BY ALL) ON qk = q.k AND ck = c.k) QUALIFY pos <= 50""")
values("fsub2(t, a)", [(t, a) for t in [n for n, _ in tx.SUBSYSTEM_PATHS] for a in [t] + [p for p, cs in kn.FILTER_HIERARCHY.items() if t in cs] + kn.FILTER_RELATED.get(t, [])])
cte("kf", "kq kqtop an fsub2", f"""SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(boosted, 10) DESC, pos) AS ord FROM (SELECT z.*, greatest(0, least(1, s)) * {_boost} AS boosted FROM (
    SELECT t.*, qt, tsb, a.subject, a.subsystem, a.bug_type, a.fix_tags, a.commit_hash = '' OR row_number() OVER (PARTITION BY t.qid, a.commit_hash ORDER BY t.pos) = 1 AS uniq FROM kqtop t JOIN an a ON a.doc_id = t.id JOIN kq USING (qid)) z
    WHERE uniq AND (tsb = 'unknown' OR EXISTS (SELECT 1 FROM fsub2 f WHERE f.t = tsb AND f.a = z.subsystem)))""")
cte("kr", "kf", f"""SELECT *, len(list_intersect(qw, {_wsplit('doc')})) / len(qw) AS rer, CASE WHEN mb IS NULL THEN boosted WHEN mb > 1 OR mb < 0.01 THEN round(least(0.99, boosted / mb), 4) ELSE greatest(0, least(1, boosted)) END AS vs FROM (SELECT *, {_wsplit('qt')} AS qw,
    max(boosted) FILTER (boosted > 0) OVER (PARTITION BY qid) AS mb, concat('[', subsystem, '] [', bug_type, '] ', subject, CASE WHEN len(fix_tags) > 0 THEN concat(' Fixes: [''', array_to_string(fix_tags, ''', '''), ''']') ELSE '' END) AS doc FROM kf)""")
oracle("k16_search_by_bug_type", "kr", """SELECT qid AS query_id, rank::BIGINT AS rank, id, round(vs, 10)::DOUBLE AS vector_score, round(rer, 10)::DOUBLE AS reranker_score, fin::DOUBLE AS final_score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fin DESC, ord) AS rank
    FROM (SELECT *, round(greatest(0, least(1, 0.2 * greatest(0, least(1, vs)) + 0.4 * rer + 0.4 * 0.5)), 12) AS fin FROM kr)) WHERE rank <= 5""")

cte("bq", "", "SELECT item_id AS qid, 'unknown' AS tsb, text AS qt FROM benchmark")
_free = {"kq": "bq", "kqtok": "bqtok", "kqtop": "bqtop", "kf": "bf", "kr": "br"}
_swap = lambda t: re.sub(r"\b(" + "|".join(_free) + r")\b", lambda m: _free[m[1]], t)
for _old in ("kqtok", "kqtop", "kf", "kr"):
    cte(_free[_old], " ".join(_swap(d) for d in _CTE[_old][0]), _swap(_CTE[_old][1].split(" AS (", 1)[1][:-1]))
oracle("k16_quick_search", "br", _swap(_SQL["k16_search_by_bug_type"][1]))

# crash logs against all commits: distinct queries, cosine over hashed terms, filters, top 3
cte("qs", "rq", "SELECT retrieval_query, subsystem AS tsb, nb AS tbt, kernel_version AS tkv, min(crash_id) AS qid FROM rq GROUP BY ALL")
cte("qtok", "qs", tokens("qs", "qid", "retrieval_query"))
cte("qsim", "qtok ctok cnorm", """SELECT q.k AS qid, c.k AS id, round(coalesce(d, 0) / (q.z * c.z), 6) AS s FROM (SELECT k, sqrt(sum(n * n)) AS z FROM qtok GROUP BY k) q CROSS JOIN cnorm c
    LEFT JOIN (SELECT a.k AS qk, b.k AS ck, sum(a.n * b.n)::DOUBLE AS d FROM qtok a JOIN ctok b USING (b) GROUP BY ALL) ON qk = q.k AND ck = c.k""")
values("fsub(t, a)", [(t, a) for t in [n for n, _ in kr.LOG_SUBSYSTEM_HINTS] for a in [t] + [p for p, cs in kn.FILTER_HIERARCHY.items() if t in cs] + kn.FILTER_RELATED.get(t, [])])
_qtop = """SELECT z.*, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS pos FROM (SELECT qsim.*, tsb, tbt, a.subsystem AS asub, a.bug_type AS abug FROM qsim JOIN qs USING (qid) JOIN an a ON a.doc_id = qsim.id) z
    WHERE (tsb = 'unknown' OR EXISTS (SELECT 1 FROM fsub WHERE fsub.t = tsb AND fsub.a = asub)) AND (tbt = 'unknown' OR EXISTS (SELECT 1 FROM fbug WHERE fbug.t = tbt AND fbug.a = abug)) QUALIFY pos <= 100"""
values("fbug(t, a)", [(t, a) for t in tx.BUG_TYPES if t != "unknown" for a in kn.BUG_TYPE_GROUPS.get(t, [t])])
cte("qtop", "qsim qs an fsub fbug", _qtop)
cte("qrank", "qs qtop commits an v1c fsub fbug", f"""SELECT qid, id, s, commit_hash, subject, row_number() OVER (PARTITION BY qid ORDER BY round(bs, 10) DESC, unc, pos) AS rank FROM (
    SELECT *, greatest(0, least(1, s)) * {_boost} * CASE WHEN tm IS NULL THEN 1.0 ELSE {vweight('tm', 'tn').replace('kmajor', 'v_major').replace('kminor', 'v_minor')} END AS bs, tm IS NOT NULL AND coalesce(v_major > tm, TRUE) AS unc FROM (
      SELECT t.qid, t.id, t.s, t.pos, a.commit_hash, a.subject, a.fix_tags, v1c.major AS v_major, v1c.minor AS v_minor, CASE WHEN tkv <> '' THEN regexp_extract(tkv, '(\\d+)\\.(\\d+)', 1)::INT END AS tm,
        CASE WHEN tkv <> '' THEN regexp_extract(tkv, '(\\d+)\\.(\\d+)', 2)::INT END AS tn, a.commit_hash = '' OR row_number() OVER (PARTITION BY t.qid, a.commit_hash ORDER BY t.pos) = 1 AS uniq
      FROM qtop t JOIN an a ON a.doc_id = t.id JOIN v1c ON v1c.doc_id = t.id JOIN qs USING (qid)) z
    WHERE uniq)""")
oracle("k18_diagnose", "rq qs qrank", """SELECT crash_id, rank::BIGINT AS rank, root_cause, commit_hash, subject, CASE WHEN s IS NOT NULL THEN round(greatest(0, least(1, s)), 6)::DOUBLE END AS final_score FROM rq JOIN qs ON qs.retrieval_query = rq.retrieval_query AND tsb = subsystem AND tbt = nb AND tkv = kernel_version
    LEFT JOIN (SELECT * FROM qrank WHERE rank <= 3) r USING (qid)""")

# --- aggregation, paging, maintenance -----------------------------------------------------------

oracle("k19_deep_page", "", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 725")
oracle("k19_page", "an", "SELECT doc_id, score, subsystem FROM an ORDER BY score DESC, doc_id LIMIT 20 OFFSET 40")
oracle("s19_index_stats", "vi", "SELECT count(*) AS rows, count(vec) AS vectors, count(DISTINCT commit_hash) AS hashes, min(date) AS first_date, max(date) AS last_date FROM vi")
oracle("s22_stratified", "an", """SELECT doc_id, ver, r::BIGINT AS rank FROM (SELECT doc_id, ver, row_number() OVER (PARTITION BY ver ORDER BY coalesce(committer_date, date) DESC, doc_id) AS r, (SELECT count(DISTINCT coalesce(concat(kmajor, '.', kminor), '0.0')) FROM an) AS g
    FROM (SELECT *, CASE WHEN kmajor IS NULL THEN '0.0' ELSE concat(kmajor, '.', kminor) END AS ver FROM an)) WHERE r <= greatest(1, 200 // g) ORDER BY ver DESC, r LIMIT 200""")
oracle("u10_batches", "", """SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000)::BIGINT AS batch_no, (ntile(7) OVER (ORDER BY o_orderkey) - 1)::BIGINT AS chunk_no FROM orders""")
oracle("a7_status_counts", "", "SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS \"n_O\", count(*) FILTER (o_orderstatus = 'F') AS \"n_F\", count(*) FILTER (o_orderstatus = 'P') AS \"n_P\" FROM orders GROUP BY 1")
oracle("st4_attempts", "", "SELECT a.event_id, count(*) AS attempts FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 1 HOUR GROUP BY a.event_id")
oracle("s23_latest_tasks", "", """SELECT task_id, status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated FROM (SELECT user_id AS task_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY user_id)
    WHERE status <> 'error' AND epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(ts)) < 86400""")
oracle("s24_store_cap", "", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
oracle("s15_new_rows", "commits", "SELECT doc_id, commit_hash FROM commits WHERE commit_hash = '' OR commit_hash NOT IN (SELECT commit_hash FROM commits WHERE date < '2019-01-01')")


_titles = case("x", {t: f"- **{t}**: {n} — {u}" for t, (n, u) in kn.LOCK_TITLES.items()})
oracle("g15_lock_context", "locku lockhits", f"""SELECT crash_id, concat('## Lock Usage Analysis', chr(10),
    CASE WHEN types <> '' THEN chr(10) || '### Lock Types Detected' || chr(10) || array_to_string(list_transform(string_split(types, '|'), lambda x: {_titles}), chr(10)) || chr(10) ELSE '' END,
    CASE WHEN said IS NOT NULL THEN chr(10) || '### Lock Acquire Operations' || chr(10) || said || chr(10) ELSE '' END,
    CASE WHEN len(issues) > 0 THEN chr(10) || '### ⚠️ Potential Lock Issues' || chr(10) || array_to_string(list_transform(issues, lambda x: '- **' || x || '**'), chr(10)) || chr(10) ELSE '' END,
    CASE WHEN types = '' AND len(issues) = 0 THEN chr(10) || '*(No lock operations detected in call trace)*' ELSE '' END) AS lock_context
    FROM locku LEFT JOIN (SELECT crash_id, string_agg('- `' || a || '()` in `' || left(s, 80) || '`', chr(10) ORDER BY r, o) AS said FROM lockhits WHERE NOT rel GROUP BY crash_id) USING (crash_id)""")
oracle("g4_closure", "cf", """SELECT DISTINCT array_to_string(p[1:j], '/') AS node, array_to_string(p[1:i], '/') AS ancestor, (j - i)::BIGINT AS depth
    FROM (SELECT string_split(f, '/') AS p FROM cf) t, range(1, 40) a(i), range(2, 41) b(j) WHERE i < j AND j <= len(p)""")
_SQL["k1_scorer_hook"], _SQL["r1_encoder_hook"] = _SQL["k15_standard"], _SQL["r12_similar_commits"]
oracle("k6_extended_reason", "bd", f"""SELECT query_id, rank::BIGINT AS rank, id, concat_ws(' | ', CASE WHEN fin >= 0.85 THEN '高度匹配' WHEN fin >= 0.7 THEN '显著相关' WHEN fin >= 0.5 THEN '中度相关' ELSE '低度相关' END,
    CASE WHEN ss >= 0.8 THEN '子系统精确匹配' WHEN ss >= 0.5 THEN '子系统部分匹配' END, CASE WHEN cs >= 0.8 THEN '调用栈直接命中' WHEN cs >= 0.4 THEN '调用栈间接关联' END,
    CASE WHEN {_vm} >= 1.0 THEN '版本兼容' WHEN {_vm} < 0.8 THEN '版本兼容性偏低' END, CASE WHEN er >= 0.85 THEN '专家规则高度匹配' END) AS reason_extended FROM bd""")


_say = {k: v(x) for k, x in vars(say).items() if k.startswith("RULES_")}
_miss = "concat_ws(', ', CASE WHEN len(tr) = 0 THEN 'Call Trace' END, CASE WHEN coalesce(kernel_version, '') = '' THEN 'Kernel Version' END)"
_dimrows = " || chr(10) || ".join(f"'| {n} | {w} | ' || {_num(x, 3)} || ' | ' || {_num(f'round({x} * {f}, 4)', 3)} || ' |'" for n, w, f, x in (
    ("Embedding", "15%", 0.15, "round(vs, 4)"), ("Reranker", "25%", 0.25, "round(rer, 4)"), ("Expert Rule", "15%", 0.15, "round(er, 4)"), ("Call Stack", "10%", 0.10, "round(cs, 4)"),
    ("Subsystem", "10%", 0.10, "round(ss, 4)"), ("Version", "10%", 0.10, f"round({_vm}, 4)"), ("LLM Judge", "15%", 0.15, "0.5")))
oracle("x6_rule_explanation", "rc ev2 ranked bd", f"""SELECT rc.crash_id, CASE WHEN n IS NULL THEN {_say['RULES_NONE']} ELSE concat_ws(chr(10), {_say['RULES_HEAD']}, {_say['RULES_CAUSE']} || rc.root_cause, {_say['RULES_SUBSYSTEM']} || rc.subsystem || '`',
    {_say['RULES_CONFIDENCE']} || {_num('rc.score * 100', 0)} || '%', {_say['RULES_EVIDENCE']}, {_say['RULES_KEYWORD']} || panic_keyword, {_say['RULES_ADDRESS']} || fa || '`', {_say['RULES_RULE']} || rc.rule_id || ' — ' || coalesce({_rule(1)}, ''),
    CASE WHEN len(tr) > 0 THEN {_say['RULES_FUNCTIONS']} || array_to_string(tr, ', ') END, {_say['RULES_PATCHES']}, rows_, {_say['RULES_SCORES']}, dims, '| **Total** | — | — | **' || {_num('f1', 3)} || '** |', {_say['RULES_REASONS']}, why,
    CASE WHEN {_miss} <> '' THEN {_say['RULES_LIMITS']} || {_miss} || {_say['RULES_LIMITS_END']} || {_miss} || {_say['RULES_LIMITS_CLOSE']} END, {_say['RULES_DECISION']} || h1 || '` — *' || s1 || '*', {_say['RULES_WHY']} || {_num('f1', 3)} || ')',
    {_say['RULES_BY_RULE']} || coalesce(rc.rule_id, 'N/A'), {_say['RULES_KIND']} || b1 || {_say['RULES_KIND_MIDDLE']} || rc.root_cause || {_say['RULES_KIND_END']},
    CASE WHEN f1 - f2 < 0.01 THEN {_say['RULES_CLOSE_RACE']} || {_num('f1 - f2', 4)} || {_say['RULES_CLOSE_RACE_END']} WHEN f1 - f2 >= 0.01 THEN {_say['RULES_CLEAR']} || {_num('f1 - f2', 4)} || {_say['RULES_CLEAR_END']} END, {_say['RULES_STEPS']},
    CASE WHEN {_miss} <> '' THEN {_say['RULES_RISK']} || {_miss} || {_say['RULES_RISK_END']} || {_miss} || {_say['RULES_RISK_CLOSE']} ELSE {_say['RULES_TRUST']} END, {_say['RULES_SCOPE']}) END AS explanation
    FROM rc JOIN (SELECT crash_id, panic_keyword, fa FROM ev2) e USING (crash_id) LEFT JOIN (SELECT query_id, count(*) AS n, string_agg('| ' || rank || ' | ' || {_num('fin', 3)} || ' | `' || commit_hash || '` | ' || subject || ' |', chr(10) ORDER BY rank) AS rows_,
      string_agg(concat_ws(chr(10), '**Top' || rank || '** — ' || subject || '...', {_say['RULES_MATCH']} || rank_reason, {_say['RULES_DIFFERENCE']} || replace(nullif(different, ''), '|', '; '), {_say['RULES_PLACE']} || ranking_reason, ''), chr(10) ORDER BY rank) AS why,
      max(fin) FILTER (rank = 1) AS f1, max(fin) FILTER (rank = 2) AS f2, max(commit_hash) FILTER (rank = 1) AS h1, max(subject) FILTER (rank = 1) AS s1, max(bug_type) FILTER (rank = 1) AS b1, max({_dimrows}) FILTER (rank = 1) AS dims
      FROM bd JOIN (SELECT query_id, rank, different, ranking_reason FROM ({_SQL['k13_why_not'][1]})) w USING (query_id, rank) JOIN (SELECT query_id, rank, rank_reason FROM ({_SQL['k15_standard'][1]})) k USING (query_id, rank) GROUP BY query_id) p ON p.query_id = rc.crash_id""")


def _build(deps: list[str], sql: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in order:
            for d in _CTE[n][0]:
                visit(d)
            order.append(n)
    for d in deps:
        visit(d)
    return (("WITH " + ", ".join(_CTE[n][1] for n in order) + " ") if order else "") + sql


def oracle_sql() -> dict[str, str]:
    return {n: _build(d, s) for n, (d, s) in _SQL.items()}
