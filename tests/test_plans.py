"""Plan shape checks (explain output)."""

import contextlib
import io

from wattlane.operators.ordering import with_positions
from wattlane.operators.quality import building_stats
from wattlane.sources import tables as T
from tests.conftest import SF_MID


def _plan(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def test_hot_global_positions_never_use_single_partition(spark):
    r = T.readings(spark, SF_MID)
    df = with_positions(r, [], ["timestamp", "reading_id"], "pos", limit=0)
    df.collect()
    plan = _plan(df)
    assert "SinglePartition" not in plan
    # the numbered rows are read back from the staged table; the numbering
    # itself ran behind a range exchange


def test_numbering_sorts_by_range_once(spark, monkeypatch):
    """The rows are range-partitioned once and then read from the staged
    table; running sums stay in that layout."""
    from wattlane.operators import ordering
    plans = []
    real = ordering.materialize
    monkeypatch.setattr(ordering, "materialize", lambda df, name="stage": (plans.append(_plan(df, "simple").lower()), real(df, name))[1])
    ordering.running_totals(T.readings(spark, SF_MID), [], ["timestamp", "reading_id"], ["anomaly"]).collect()
    assert len(plans) == 1 and plans[0].count("exchange rangepartitioning") == 1 and "hashpartitioning" not in plans[0]


def test_one_pass_queries_stage_nothing(spark):
    from wattlane import session
    from wattlane.plans.catalog import QUERIES
    held = lambda: sum(map(len, session._STAGED.values()))
    before = held()
    for name in ("F12_null_to_zero", "F25_hourly_spine", "A5_null_counts", "A35_anomaly_count_and_rate_by_hour"):
        for q in (k for k in QUERIES if k.split("_")[0] == name.split("_")[0]):
            QUERIES[q][0](spark, SF_MID).limit(1).collect()
    assert held() == before


def test_stats_join_back_is_broadcast_after_aqe(spark):
    r = T.readings(spark, SF_MID)
    j = r.join(building_stats(r), "building_id", "left")
    j.collect()
    assert "BroadcastHashJoin" in _plan(j)


def test_scan_prunes_columns_and_pushes_filters(spark):
    r = T.readings(spark, SF_MID).where("building_id = 7").select("meter_reading")
    plan = _plan(r)
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,7)]" in plan
    assert "ReadSchema: struct<user_id:bigint,value:double>" in plan


def test_value_filter_pushdown_when_nan_free(spark):
    r = T.readings(spark, SF_MID, nan_safe=False).where("meter_reading > 100").select("building_id")
    assert "GreaterThan(value,100.0)" in _plan(r)


import pytest  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from tests.conftest import SF_SMALL  # noqa: E402


@pytest.mark.parametrize("name", ["C0_flagship_outliers_by_building_hour", "D1_median_imputation",
                                  "F25_hourly_spine", "A24_correlation_matrix", "J7_interval_overlay",
                                  "W7_surrogate_row_id", "L8_stratified_split", "J1_building_stats_join"])
def test_no_cross_join_or_row_udf(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL), "simple")
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan
