"""Queries against their SQL on the smallest tables, where these are there. ALL_ORACLES=1 runs every one."""

import os

import pandas as pd
import pytest

from quadrille import plans

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUICK = ("j1_room_overlaps", "j3_cohort_overlaps", "g2_n39_n40_w1_detect_conflicts", "n1_subject_key", "n5_norm_name_roman", "n21_parse_range", "j13_match_rooms_u2_key_variants", "x8_parse_cells", "g11_g12_g13_g14_assess_quality", "g1_schedule_summary", "w6_overlap_clusters", "m1_sync_conflicts", "m9_apply_session_batch", "m13_check_constraints")
NAMES = sorted(plans.oracle_sql()) if os.environ.get("ALL_ORACLES") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for name in ("events", "part", "orders", "supplier", "documents", "lineitem", "customer"):
        path = f"{SF}/{name}.parquet"
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "-"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    df = df.reindex(sorted(df.columns), axis=1)
    for c in df:
        df[c] = df[c].map(text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, duck, name):
    got = plain(plans.queries()[name](spark, SF).toPandas())
    want = plain(duck.sql(plans.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


def test_every_query_is_registered_with_its_own_name():
    assert set(plans.oracle_sql()) <= set(plans.queries()) and len(plans.queries()) > 130
