"""Registered queries against their DuckDB SQL. ALL_QUERIES=1 runs every one of them."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = [
    "traffic_by_provider", "p7_to_identity_actions", "p13_render_event_lines", "f2_search_events", "f7_high_rate_tls", "j4_asof_sni", "j8_join_pods",
    "j10_asof_fd_path", "a1_process_stats", "a3_kpis", "a16_events_per_second", "k1_recent_events", "c10_scan_pii", "c12_parse_llm_requests",
    "w5_timing_features", "t7_first_chunks", "r2_default_policy", "i6_best_composite_match", "g1_relay_edges", "m1_simhash", "s8_upsert_identities",
]
ORACLES = entry.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return f"{type(v).__name__}:{v}"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("ALL_QUERIES") else QUICK)
def test_query_equals_oracle(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted([norm(r[c]) for c in cols] for r in df.collect())
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted([norm(r[names.index(c)]) for c in cols] for r in cur.fetchall())
    assert got == want


def test_registry():
    assert set(ORACLES) <= set(entry.queries()) and len(ORACLES) > 110


def test_entry(spark):
    assert entry.entry(spark).count() > 0
