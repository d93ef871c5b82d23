"""Registered queries against their DuckDB texts on the smallest tables."""

import duckdb
import pytest

from seamline import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "part lineitem supplier events documents pages".split()
#: One of each kind, with all those that iterate.
NAMES = (
    "link_calls", "rank_apis", "search", "dependents", "graph_reach", "merged_graphs", "api_impact", "file_impact", "match_api_keys", "contract_messages", "checked_apis", "type_walk",
    "dto_usage", "field_impact", "search_types", "diff_params", "diff_contracts", "change_sites", "bound_parameters", "java_types", "scanned_calls", "index_sync", "touched_apis", "merged_ranges", "url_functions", "endpoint_shapes", "inherited_fields", "function_summaries", "api_flow", "api_wrappers", "stored_index", "streamed_index", "enclosing_functions", "rank_files", "scoped_constants",
)


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    got = sorted((plain(tuple(r[c] for c in columns)) for r in found.collect()), key=repr)
    answer = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted((plain(tuple(r[names.index(c)] for c in columns)) for r in answer.fetchall()), key=repr)
    assert got and got == want
