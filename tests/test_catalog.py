"""Catalog queries against their SQL on the smallest tables, where they are there."""

import os

import pytest

import __spark_entry__ as entry
from orrery.plans import catalog, lifecycle, records, reports  # noqa: F401 (the others register their queries in the catalog)

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
SOME = ("search_legs", "search_turns", "route_parameters", "paged_scan", "fetched_cards", "resolved_ids", "full_texts", "loaded_themes", "home_notes", "text_forms", "run_lines", "rendered_entries", "model_rows", "percolated_ladders", "percolated_filters", "fair_shares_by_brand", "lexical_baseline", "two_hop_fair_share", "facet_counts", "repository_pillars", "submission_report", "normalize_works", "maxmin_select", "bridge_pool_full", "rejection_log", "anchor_rank", "bridge_two_hop", "bridge_usage", "hybrid_rank", "post_gates", "facet_interleave", "keyword_fit", "pool_relative_lift", "inverted_index_restore")


def plain(v):
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert sorted(names) == cols and got == want


def test_entry_is_the_flagship(spark):
    assert entry.entry(spark).count() == 60
