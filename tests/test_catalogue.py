"""Catalogue queries against the oracle SQL, where the test tables are there."""

import os

import pytest

from relspark.operators.constraints import violations
from relspark.queries import ORACLES, QUERIES
from relspark.sources.tables import load

TABLES = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")

SOME = ["walk_customer_orders", "triangle_part_supp_order", "or_tree", "gate_empty_negated", "customers_without_orders", "union_overlap", "bool_any_all", "global_sum_empty", "point_in_span", "allen_intersects", "ship_overlaps", "interval_ne", "duration_filter", "pack_union", "roots_not_reached", "fk_elim_on", "fk_elim_off", "pointwise_violations", "change_violations", "capacity_violations", "union_dead_first", "union_dead_last", "graph_triangles", "ring_of_four", "olap_buyers_of_brand", "join_chain_back", "calendar_conflict_free", "keyless_overlap", "keyless_point", "keyless_not_covered", "overlap_hot_users", "revenue_by_nation"]


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in os.listdir(TABLES):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{t}'")
    return c


def test_tables_keep_their_statements(spark):
    at = load(spark, TABLES)
    assert at.admitted and violations(at.frames, at.schema, loose=at.loose).isEmpty()


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, oracle, name):
    df = QUERIES[name](spark, TABLES)
    want = oracle.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [df.columns.index(c) for c in sorted(df.columns)]
    to = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted((tuple(r[i] for i in at) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in to) for r in want.fetchall()), key=repr)
