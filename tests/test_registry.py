import os

import duckdb
import pytest

import __spark_entry__
from vexel.registry import registry

D = "/root/testdata/sf0.001"
SOME = ["exact_topk", "filter_and", "filter_exists", "filter_regex", "metadata_encode_keys", "filter_bitmap_algebra", "ivf_assign_spill", "ivf_search_filtered", "ivf_adaptive_probes", "tq4_encode", "residual_encode", "live_rejected_ops", "live_merge_topk", "calib_bernstein_bound", "vec_dot_i8", "tq_prefix_topk", "live_split_once", "residual_score_topk", "ivf_assign_hierarchical", "f16_decode", "http_filters", "collection_search_live", "collection_search_residual", "collection_capacity"]


def test_every_query_has_sql_and_a_name():
    r = registry()
    assert len(r) > 95 and all(sql for _, sql in r.values()) and set(SOME) <= set(r) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
def test_queries_match_their_sql(spark):
    db = duckdb.connect()
    for t in os.listdir(D):
        db.execute(f"create view {t.split('.')[0]} as select * from '{D}/{t}'")
    for name in SOME:
        query, sql = registry()[name]
        df, want = query(spark, D), db.sql(sql)
        cols = sorted(df.columns)
        assert sorted(want.columns) == cols, name
        a = sorted((tuple(r) for r in df.select(*(f"`{c}`" for c in cols)).collect()), key=str)
        assert a == sorted(want.project(",".join(f'"{c}"' for c in cols)).fetchall(), key=str), name
    assert __spark_entry__.entry(spark).count() > 0
