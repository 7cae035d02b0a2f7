"""Binary-classification evaluation as aggregates over one scored table.

The scored table keeps key, label, prediction and score together; nothing
is zipped by position. Every metric is a single aggregate (conditional
sums), except the ROC curve, which needs running totals by score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlane.operators.ordering import one_row, running_totals


def _div0(a: Column, b: Column) -> Column:
    """a / b with 0 for an empty denominator (sklearn's zero_division=0)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """One row: tn, fp, fn, tp."""
    y, p = F.col(label), F.col(pred)
    return df.select(F.count_if((y == 0) & (p == 0)).alias("tn"),
                     F.count_if((y == 0) & (p == 1)).alias("fp"),
                     F.count_if((y == 1) & (p == 0)).alias("fn"),
                     F.count_if((y == 1) & (p == 1)).alias("tp"))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Full 2x2 grid (label, prediction, count), zero cells included."""
    return confusion_counts(df, label, pred).selectExpr(
        "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (label, prediction, count)")


def accuracy(df: DataFrame, label: str = "label", pred: str = "prediction") -> Column:
    return F.avg((F.col(label) == F.col(pred)).cast("int"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """precision / recall / f1 / support for classes 0 and 1, accuracy,
    macro and weighted averages; 0 where a denominator is empty."""
    c = confusion_counts(df, label, pred)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    p1, r1 = _div0(tp, tp + fp), _div0(tp, tp + fn)
    p0, r0 = _div0(tn, tn + fn), _div0(tn, tn + fp)
    f1 = _div0(2 * p1 * r1, p1 + r1)
    f0 = _div0(2 * p0 * r0, p0 + r0)
    s0, s1 = (tn + fp), (fn + tp)
    acc = _div0(tn + tp, n)
    wide = c.select(
        p0.alias("p0"), r0.alias("r0"), f0.alias("f0"), s0.alias("s0"),
        p1.alias("p1"), r1.alias("r1"), f1.alias("f1"), s1.alias("s1"),
        acc.alias("acc"), n.alias("n"),
        ((p0 + p1) / 2).alias("pm"), ((r0 + r1) / 2).alias("rm"), ((f0 + f1) / 2).alias("fm"),
        _div0(p0 * s0 + p1 * s1, n).alias("pw"), _div0(r0 * s0 + r1 * s1, n).alias("rw"),
        _div0(f0 * s0 + f1 * s1, n).alias("fw"))
    return wide.selectExpr(
        "stack(5, '0', p0, r0, f0, s0, '1', p1, r1, f1, s1, 'accuracy', acc, acc, acc, n, "
        "'macro avg', pm, rm, fm, n, 'weighted avg', pw, rw, fw, n) "
        "AS (class, precision, recall, f1_score, support)")


def score_counts(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score (partial aggregation)."""
    return (df.where(F.col(score).isNotNull())
            .groupBy(F.col(score).alias("threshold"))
            .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")))


def roc_auc_table(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row, ``auc``: area under ROC with ties counted half
    (Mann-Whitney); NULL when only one class is present.

    AUC = sum_s pos(s) * (neg_below(s) + neg(s)/2) / (P * N), where
    neg_below comes from running totals over distinct scores.
    """
    sc = running_totals(score_counts(df, label, score), [], ["threshold"], ["neg"], "_le")
    return sc.select(
        F.try_divide(F.sum(F.col("pos") * (F.col("neg_le") - F.col("neg") / 2.0)),
                     F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> Column:
    """``roc_auc_table`` as a scalar subquery."""
    return one_row(roc_auc_table(df, label, score))["auc"]


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) at every distinct score, descending;
    scores at or above the threshold are predicted positive."""
    sc = running_totals(score_counts(df, label, score), [], [F.col("threshold").desc()],
                        ["pos", "neg"], "_ge")
    tot = one_row(df.where(F.col(score).isNotNull())
                  .select(F.count_if(F.col(label) == 1).alias("P"),
                          F.count_if(F.col(label) == 0).alias("N")))
    return sc.select("threshold", F.col("pos_ge").alias("tp"), F.col("neg_ge").alias("fp"),
                     F.try_divide(F.col("pos_ge").cast("double"), tot["P"]).alias("tpr"),
                     F.try_divide(F.col("neg_ge").cast("double"), tot["N"]).alias("fpr"))


def evaluate(df: DataFrame, model: str, label: str = "label", pred: str = "prediction",
             score: str | None = "score") -> DataFrame:
    """One metrics row: model, accuracy, precision, recall, f1 (class 1),
    auc (NULL when single-class or no score), support, tn, fp, fn, tp."""
    c = confusion_counts(df, label, pred)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    p1, r1 = _div0(tp, tp + fp), _div0(tp, tp + fn)
    auc = roc_auc(df, label, score) if score else F.lit(None).cast("double")
    return c.select(F.lit(model).alias("model"), _div0(tn + tp, tn + fp + fn + tp).alias("accuracy"),
                    p1.alias("precision"), r1.alias("recall"), _div0(2 * p1 * r1, p1 + r1).alias("f1_score"),
                    auc.alias("auc"), "tn", "fp", "fn", "tp")


def results_summary(metrics: DataFrame) -> DataFrame:
    """Text table: title-cased model name, 3-decimal metrics, 'N/A' for a
    missing AUC. Values are rounded half-even before formatting."""
    def fmt(c: str) -> Column:
        return F.format_string("%.3f", F.bround(F.col(c), 3))
    return metrics.select(
        F.initcap(F.regexp_replace("model", "_", " ")).alias("model_name"),
        fmt("precision").alias("precision_txt"), fmt("recall").alias("recall_txt"),
        fmt("f1_score").alias("f1_txt"),
        F.when(F.col("auc").isNull(), F.lit("N/A")).otherwise(fmt("auc")).alias("auc_txt"))


def metrics_long(metrics: DataFrame, names: Sequence[str] = ("precision", "recall", "f1_score", "auc")) -> DataFrame:
    """(model, metric, score) long form, NULL scores dropped."""
    stack = ", ".join(f"'{n}', CAST({n} AS DOUBLE)" for n in names)
    return (metrics.selectExpr("model", f"stack({len(names)}, {stack}) AS (metric, score)")
            .where(F.col("score").isNotNull())
            .withColumn("metric_name", F.initcap(F.regexp_replace("metric", "_", " ")))
            .withColumn("model_name", F.initcap(F.regexp_replace("model", "_", " "))))


def detected_rate(pred: str = "prediction") -> Column:
    return F.avg(F.col(pred)) * 100.0
