"""The hot-group (range-partitioned) paths give exactly the results of the
bounded-group built-in plans. ``limit=0`` forces every group to be hot."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattlane.operators.ordering import quantiles, running_totals, with_positions
from wattlane.operators.windows import lag_rolling
from wattlane.sources import tables as T
from tests.conftest import SF_MID


def test_positions_hot_equals_row_number(spark):
    r = T.readings(spark, SF_MID)
    hot = with_positions(r, ["building_id"], ["timestamp", "reading_id"], "p", limit=0)
    ref = r.withColumn("p", F.row_number().over(Window.partitionBy("building_id").orderBy("timestamp", "reading_id")) - 1)
    assert hot.select("reading_id", "p").exceptAll(ref.select("reading_id", "p")).count() == 0
    assert hot.count() == r.count()


def test_global_positions_hot(spark):
    r = T.readings(spark, SF_MID)
    hot = with_positions(r, [], ["timestamp", "reading_id"], "p", limit=0)
    assert hot.agg(F.min("p"), F.max("p"), F.count_distinct("p")).first() == (0, 9999, 10000)


def test_quantiles_hot_equals_percentile(spark):
    r = T.readings(spark, SF_MID)
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    hot = {x.building_id: x for x in quantiles(r, "meter_reading", probs, ["building_id"], limit=0).collect()}
    cold = {x.building_id: x for x in quantiles(r, "meter_reading", probs, ["building_id"]).collect()}
    assert hot.keys() == cold.keys()
    for k in hot:
        for a, b in zip(hot[k], cold[k]):
            assert abs(a - b) < 1e-9


def test_lag_rolling_hot_blocks_equal_plain_window(spark):
    r = T.readings(spark, SF_MID)
    args = (["building_id"], ["timestamp", "reading_id"], "meter_reading", (1, 24), 24)
    hot = lag_rolling(r, *args, block_rows=30, limit=0)
    cold = lag_rolling(r, *args)
    cols = ["reading_id", "meter_reading_lag_1", "meter_reading_lag_24",
            "meter_reading_rolling_mean_24", "meter_reading_rolling_std_24"]
    h = {x.reading_id: x for x in hot.select(*cols).collect()}
    c = {x.reading_id: x for x in cold.select(*cols).collect()}
    assert h.keys() == c.keys()
    for k in h:
        for a, b in zip(h[k], c[k]):
            assert (a is None and b is None) or abs(a - b) < 1e-9


def test_windows_wider_than_a_block_equal_plain_windows(spark):
    """Blocks below the reach of windows and lags, with NULLs, a null key,
    short series and a large offset."""
    rows = [(b, i, None if (i * 7 + (b or 0)) % 11 == 0 and b != 2 else 1e6 + (i * 37 % 101)) for b, n in ((1, 90), (2, 140), (None, 60), (4, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "b int, i int, v double")
    for block, size in ((1, 24), (7, 24), (24, 24), (23, 5), (3, 1)):
        args = (["b"], ["i"], "v", (1, 24), size)
        want = {(r.b, r.i): r[3:] for r in lag_rolling(df, *args).collect()}
        got = {(r.b, r.i): r[3:] for r in lag_rolling(df, *args, block_rows=block, limit=0).collect()}
        assert got.keys() == want.keys()
        for k in want:
            for a, b in zip(got[k], want[k]):
                assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-5), (block, k, got[k], want[k])


def test_running_totals_hot(spark):
    r = T.readings(spark, SF_MID).select("building_id", "reading_id", F.col("anomaly").cast("long").alias("a"))
    hot = running_totals(r, ["building_id"], ["reading_id"], ["a"], limit=0)
    cold = running_totals(r, ["building_id"], ["reading_id"], ["a"])
    assert hot.select("reading_id", "a_cum").exceptAll(cold.select("reading_id", "a_cum")).count() == 0


def test_mixed_hot_and_cold_groups(spark):
    """With a limit between the smallest and largest group both paths run
    in one call and the union equals the plain plans."""
    r = T.readings(spark, SF_MID)
    sizes = [x["count"] for x in r.groupBy("building_id").count().collect()]
    limit = (min(sizes) + max(sizes)) // 2
    hot = {x.building_id: x for x in quantiles(r, "meter_reading", [0.5], ["building_id"], limit=limit).collect()}
    cold = {x.building_id: x for x in quantiles(r, "meter_reading", [0.5], ["building_id"]).collect()}
    assert hot.keys() == cold.keys() and all(abs(hot[k][1] - cold[k][1]) < 1e-9 for k in hot)
    args = (["building_id"], ["timestamp", "reading_id"], "meter_reading", (1, 24), 24)
    a = lag_rolling(r, *args, block_rows=40, limit=limit).select("reading_id", "meter_reading_rolling_mean_24")
    b = lag_rolling(r, *args).select("reading_id", "meter_reading_rolling_mean_24")
    da = {x[0]: x[1] for x in a.collect()}
    db = {x[0]: x[1] for x in b.collect()}
    assert da.keys() == db.keys()
    assert all((da[k] is None and db[k] is None) or abs(da[k] - db[k]) < 1e-9 for k in da)


def test_approx_quantiles_are_near_in_rank(spark):
    """An approximate quantile is a value of the group whose rank is off by
    no more than the accuracy allows (1 / 10000 of the rows, plus one)."""
    r = T.readings(spark, SF_MID)
    values = {}
    for x in r.select("building_id", "meter_reading").collect():
        values.setdefault(x.building_id, []).append(x.meter_reading)
    for row in quantiles(r, "meter_reading", [0.25, 0.5, 0.75], ["building_id"], method="approx").collect():
        v = sorted(values[row.building_id])
        for i, p in enumerate((0.25, 0.5, 0.75), 1):
            assert row[i] in v and abs(v.index(row[i]) - p * (len(v) - 1)) <= len(v) / 10000 + 1


def test_column_quantiles_in_one_sort(spark):
    from wattlane.operators.ordering import column_quantiles
    r = T.readings(spark, SF_MID).select("meter_reading", F.col("building_id").cast("double").alias("b"))
    pick = lambda q: r.limit(1).select(*[c.alias(n) for n, c in q.items()]).first().asDict()
    a, b = (pick(column_quantiles(r, ["meter_reading", "b"], [0.25, 0.5], limit=n)) for n in (0, None))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_null_keys_are_a_hot_group(spark):
    df = spark.range(100).select(F.when(F.col("id") >= 10, F.lit(None)).otherwise(F.lit(1)).alias("k"), "id")
    got = with_positions(df, ["k"], ["id"], "p", limit=50).collect()
    assert len(got) == 100 and sorted(x.p for x in got if x.k is None) == list(range(90))


def test_keyless_plans_have_no_single_partition(spark):
    from wattlane.plans.catalog import QUERIES
    for name in ("W7_surrogate_row_id", "W8_chronological_split", "A32_roc_curve"):
        df = QUERIES[name][0](spark, SF_MID)
        assert "SinglePartition" not in df._jdf.queryExecution().toString(), name
