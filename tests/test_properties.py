"""Properties of splits, evaluation and detectors."""

from pyspark.sql import functions as F

from wattlane.operators import evaluate as EV
from wattlane.operators import explore as X
from wattlane.operators.split import stratified_split
from wattlane.operators.windows import chronological_split
from wattlane.sources import tables as T
from tests.conftest import SF_MID, SF_SMALL


def test_stratified_split_disjoint_cover_and_rate(spark):
    r = T.readings(spark, SF_MID)
    sp = stratified_split(r, "anomaly", "reading_id", 0.2, 42)
    assert sp.count() == r.count() and sp.select("reading_id").distinct().count() == r.count()
    for row in sp.groupBy("anomaly").agg(F.avg("is_validation").alias("v"), F.count("*").alias("n")).collect():
        assert abs(row.v - 0.2) <= 1.0 / row.n


def test_chronological_split_is_ordered(spark):
    r = T.readings(spark, SF_MID)
    sp = chronological_split(r, ["timestamp", "building_id", "reading_id"], 0.2)
    last_train = sp.where("is_test = 0").agg(F.max("timestamp")).first()[0]
    first_test = sp.where("is_test = 1").agg(F.min("timestamp")).first()[0]
    assert last_train <= first_test and sp.where("is_test = 1").count() == 2000


def test_confusion_sums_to_n_and_auc_symmetry(spark):
    s = T.scored(spark, SF_MID).withColumn("prediction", (F.col("score") > 100).cast("int"))
    assert sum(r["count"] for r in EV.confusion_matrix(s).collect()) == s.count()
    a = EV.roc_auc_table(s).first().auc
    b = EV.roc_auc_table(s.withColumn("score", -F.col("score"))).first().auc
    assert abs(a + b - 1.0) < 1e-12


def test_roc_curve_ends_at_one(spark):
    roc = EV.roc_curve(T.scored(spark, SF_SMALL))
    last = roc.orderBy("threshold").first()
    assert last.tpr == 1.0 and last.fpr == 1.0


def test_pca_ratios_sum_at_most_one(spark):
    from wattlane.operators.detect.pca import pca_view
    r = T.readings(spark, SF_SMALL).withColumns({"h": F.hour("timestamp").cast("double"),
                                                 "d": F.weekday("timestamp").cast("double")})
    _, var = pca_view(r, ["meter_reading", "h", "d"], 2)
    ratios = [x.explained_ratio for x in var.collect()]
    assert 0 < sum(ratios) <= 1.0 + 1e-9 and ratios[0] >= ratios[1]


def test_profile_counts_in_one_scan(spark, tmp_path):
    """Distinct values and NULLs of columns of all kinds, as count(DISTINCT)
    has them; one scan and one exchange of values in the plan."""
    rows = [(i % 5, None if i % 4 == 0 else float(i % 3 - 1), "x" * (i % 70), i % 2 == 0, bytes([i % 6]), [i % 3, None]) for i in range(210)]
    rows += [(1, -0.0, None, None, None, None), (1, float("nan"), "", True, b"", []), (1, float("nan"), "", True, b"", [])]
    schema = "a int, b double, c string, d boolean, e binary, f array<int>"
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, schema).write.parquet(path)
    df = spark.read.parquet(path)
    out = X.column_profile(df)
    got = [tuple(r) for r in out.orderBy("ordinal").collect()]
    for i, c in enumerate(df.columns):
        d, z = df.select(F.count_distinct(c), F.count_if(F.col(c).isNull())).first()
        assert got[i][:5] == (i, c, df.schema[c].dataType.simpleString(), d, z)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1
    rough = [tuple(r)[:3] for r in X.column_profile(df, approx=True).orderBy("ordinal").collect()]
    assert rough == [g[:3] for g in got]
    empty = X.column_profile(df.limit(0)).collect()
    assert len(empty) == 6 and all(r.distinct_values == 0 and r.null_values == 0 and r.completeness is None for r in empty)
