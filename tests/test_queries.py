"""Named queries against their SQL twins. By default one or more per family; set
CARRYOVER_ALL=1 to run every one."""

import importlib.util
import os
import sys
from collections import Counter

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
import __spark_entry__ as entry  # noqa: E402
from carryover.plans.registry import TABLES  # noqa: E402

spec = importlib.util.spec_from_file_location("check", os.path.join(ROOT, "tools", "check.py"))
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

SF = os.environ.get("CARRYOVER_SF", "/root/testdata/sf0.001")
SPREAD = [
    "select_where", "safe_cast", "not_in_null", "join_cross_unnest", "join_multi", "agg_unnest_sum", "date_hierarchy_rollup", "intersect_all", "recursive_cte",
    "win_rank", "win_lag_lead", "qualify_topn", "date_arith", "net_host", "merge_upsert", "script_loop", "multi_statement", "wildcard_scan", "materialize_models",
    "storage_path_map", "type_map", "decimal_fit_profile", "parity_report", "parity_sample", "parity_row_diff", "estate_drift", "dedupe_exact_keep_conflicts",
    "row_filter", "data_masking", "semantic_query", "explore_join", "period_over_period", "trend_series", "waves", "external_deps", "map_component",
    "required_evidence", "summary_cube", "credential_scan", "credential_redact", "sql_split", "code_verdict", "table_manifest", "ledger_sequence",
    "bq_tables_ingest", "export_ingest", "dataform_graph_ingest", "stream_dedupe", "stream_session", "sql_udf", "remote_fn_batch",
    "parity_row_diff_bags", "parity_checksum_nested", "custom_udaf", "table_fn", "ml_linear_fit",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_registry_is_complete():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) >= 253 and set(o) <= set(q)
    own = {k for k in q if k != "pipeline" and not k.startswith("op")}
    assert own - set(o) == set()


@pytest.mark.parametrize("key", sorted(entry.ORACLES) if os.environ.get("CARRYOVER_ALL") else SPREAD)
def test_query(spark, con, key):
    df = entry.queries()[key](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(names) == cols
    idx = [names.index(c) for c in cols]
    got = Counter(tuple(check.norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    assert got == Counter(tuple(check.norm(r[i]) for i in idx) for r in want)
