"""Queries over the test tables against their SQL in DuckDB, where both are there."""

from __future__ import annotations

from pathlib import Path

import pytest

from graphline import module_queries, queries

duckdb = pytest.importorskip("duckdb")
QUERIES, ORACLE_SQL = queries.QUERIES | module_queries.QUERIES, queries.ORACLE_SQL | module_queries.ORACLE_SQL
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The rest runs in the driver's comparison.
SOME = ["degree_all", "nodes_per_layer", "balanced_topk", "khop_inbound", "shortest_path_len", "inbound_paths", "ancestors", "has_path", "coverage_report", "cover_steps", "wcc_sizes", "balanced_subgraph", "pagerank_dangling", "betweenness_tiers", "dense_index", "node_sizes", "hubs"]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) and len(QUERIES) == len(queries.QUERIES) + len(module_queries.QUERIES)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    told = con.sql(ORACLE_SQL[name])
    columns = sorted(told.columns)
    found = QUERIES[name](spark, str(DATA))
    assert sorted(found.columns) == columns
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, told.select(*columns).fetchall()))


#: Queries over all targets or nodes, beside those whose SQL names some.
WHOLE = ["ancestors_suppliers", "has_path_all", "orphans_all", "balanced_topk_all", "reach_counts_parts", "shortest_path_whole", "coverage_lists"]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", WHOLE)
def test_whole_against_sql(spark, name):
    test_against_sql(spark, name)


#: Scans, unification and records over module documents.
MODULES = ["unify_layers", "unify_edges", "audit", "undeclared_ends", "codeview", "betweenness_small", "unify_acceptance", "metadata_index", "binary_records"]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", MODULES)
def test_modules_against_sql(spark, name):
    test_against_sql(spark, name)
