import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["p2_fix_tags", "p3_functions", "p9_bug_type", "p16_score", "p23_root_cause", "p24_embedding_text", "v1_resolve_version", "u1_text_scalars",
           "d2_trace_bounds", "d6_panic_info", "d18_expert_rule", "d21_root_cause", "d17_retrieval_query", "d26_hybrid", "d28_fuse_dump_and_log",
           "g14_lock_usage", "r10_batch_topk", "r12_similar_commits", "f1_dedupe", "f6_filter_chain", "k15_standard", "k13_why_not", "k18_diagnose",
           "x1_patch_explain", "s22_stratified", "st4_attempts", "r3_auto_index", "g15_lock_context", "g4_closure", "d16_fix_inference", "k3_judge_answers", "k19_deep_page"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    from faultline.plans.catalog import queries
    assert set(queries()) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    r = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    fix = lambda x: round(x, 9) + 0.0 if isinstance(x, float) else x
    want = sorted(str([fix(row[names.index(c)]) for c in cols]) for row in r.fetchall())
    got = sorted(str([fix(row[c]) for c in cols]) for row in df.collect())
    assert got == want
