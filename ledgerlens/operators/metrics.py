"""Binary-classification metrics over a scored table.

Rows are first reduced to one line per distinct score; everything that needs an order runs on that
table through the chunked scan, never through a single sorted partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import label
from ledgerlens.operators.scan import running_total

SCORE, LABEL = "fraud_probability", "isFraud"


def _share(part: Column, whole: Column) -> Column:
    """Quotient with a zero denominator giving 0."""
    return F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def _hit(y: int, predicted: Column) -> Column:
    positive = label(F.col(LABEL)) == 1
    return F.count_if((positive if y else ~positive) & predicted)


def confusion(df: DataFrame, threshold: float) -> DataFrame:
    yes = F.col(SCORE) >= threshold
    return df.agg(
        _hit(1, yes).alias("true_positives"),
        _hit(0, yes).alias("false_positives"),
        _hit(0, ~yes).alias("true_negatives"),
        _hit(1, ~yes).alias("false_negatives"),
    )


def precision_recall_f1(df: DataFrame, threshold: float) -> DataFrame:
    return _with_rates(confusion(df, threshold))


def _with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    return counts.withColumns(
        {
            "precision": _share(tp, tp + fp),
            "recall": _share(tp, tp + fn),
            "f1": _share(2 * tp, 2 * tp + fp + fn),
        }
    )


def score_table(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score: how many fraud and legitimate rows have it."""
    y = label(F.col(LABEL)).cast("bigint")
    return df.groupBy(*by, SCORE).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def curve_table(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The score table with ``tp``/``fp`` at or above each score."""
    return running_total(
        score_table(df, by),
        SCORE,
        {"tp": "pos", "fp": "neg"},
        segment=by,
        descending=True,
        source=df,
    )


def _areas() -> list[Column]:
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    p, n = F.sum(pos), F.sum(neg)
    # Each fraud row beats the legitimate rows scored below it; ties count half.
    beaten = p * n - F.sum(pos * (fp - neg / 2))
    return [
        _share(beaten, p * n).alias("auc_roc"),
        F.when((p > 0) & (n > 0), _share(F.sum(pos * tp / (tp + fp)), p))
        .otherwise(F.lit(0.0))
        .alias("auc_pr"),
    ]


def roc_auc(df: DataFrame) -> DataFrame:
    return curve_table(df).agg(_areas()[0])


def average_precision(df: DataFrame) -> DataFrame:
    return curve_table(df).agg(_areas()[1])


def collect_metrics(df: DataFrame, threshold: float) -> DataFrame:
    """All headline metrics as one row, from one curve scan."""
    at = F.col(SCORE) >= threshold

    def total(column: str, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(column))), F.lit(0)).cast("bigint")

    row = curve_table(df).agg(
        *_areas(),
        total("pos", at).alias("true_positives"),
        total("neg", at).alias("false_positives"),
        total("neg", ~at).alias("true_negatives"),
        total("pos", ~at).alias("false_negatives"),
    )
    return _with_rates(row)


def quality_gate(metrics: DataFrame, min_auc_pr: float = 0.20, min_recall: float = 0.65) -> DataFrame:
    """Whether a metrics row may be promoted."""
    passed = (F.col("auc_pr") >= min_auc_pr) & (F.col("recall") >= min_recall)
    return metrics.select("auc_pr", "recall", passed.alias("passed"))


def pr_curve(df: DataFrame) -> DataFrame:
    """Precision and recall when everything at or above each distinct score is flagged."""
    positives = df.select(F.sum(label(F.col(LABEL)))).scalar()
    return curve_table(df).select(
        F.col(SCORE).alias("threshold"),
        _share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _share(F.col("tp"), positives).alias("recall"),
    )


def roc_curve(df: DataFrame) -> DataFrame:
    y = label(F.col(LABEL))
    totals = df.agg(F.struct(F.sum(y).alias("p"), F.sum(1 - y).alias("n"))).scalar()
    return curve_table(df).select(
        F.col(SCORE).alias("threshold"),
        _share(F.col("fp"), totals.getField("n")).alias("fpr"),
        _share(F.col("tp"), totals.getField("p")).alias("tpr"),
    )


def f2_threshold(df: DataFrame) -> DataFrame:
    """The score with the best recall-weighted F measure; the lowest one among equals."""
    p, r = F.col("precision"), F.col("recall")
    scored = pr_curve(df).withColumn("f2", 5 * p * r / (4 * p + r + F.lit(1e-9)))
    rank = F.struct(F.round("f2", 12), -F.col("threshold"))
    return scored.agg(
        F.max_by("threshold", rank).alias("threshold"),
        F.max_by("precision", rank).alias("precision"),
        F.max_by("recall", rank).alias("recall"),
        F.max_by("f2", rank).alias("f2"),
    )


def classification_report(df: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro, weighted and accuracy rows."""
    c = confusion(df, threshold)
    tp, fp, tn, fn = (
        F.col(x) for x in ("true_positives", "false_positives", "true_negatives", "false_negatives")
    )

    def block(name: str, hit: Column, over: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            _share(hit, hit + over).alias("precision"),
            _share(hit, hit + missed).alias("recall"),
            _share(2 * hit, 2 * hit + over + missed).alias("f1"),
            (hit + missed).cast("bigint").alias("support"),
        )

    c = c.withColumns({"_0": block("0", tn, fn, fp), "_1": block("1", tp, fp, fn)})
    total = F.col("_0.support") + F.col("_1.support")

    def mean(name: str, weighted: bool) -> Column:
        left, right = F.col(f"_0.{name}"), F.col(f"_1.{name}")
        if not weighted:
            return (left + right) / 2
        return _share(left * F.col("_0.support") + right * F.col("_1.support"), total)

    def summary(name: str, weighted: bool) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            *[mean(m, weighted).alias(m) for m in ("precision", "recall", "f1")],
            total.alias("support"),
        )

    accuracy = F.struct(
        F.lit("accuracy").alias("class"),
        F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"),
        _share(tp + tn, total).alias("f1"),
        total.alias("support"),
    )
    rows = F.array(
        F.col("_0"), F.col("_1"), accuracy, summary("macro avg", False), summary("weighted avg", True)
    )
    return c.select(F.inline(rows))


def calibration_curve(df: DataFrame, bins: int = 10) -> DataFrame:
    """Observed rate against mean score in equal-width, right-closed bins; empty bins are absent."""
    edges = [i / bins for i in range(1, bins)]
    index = sum(((F.col(SCORE) > e).cast("int") for e in edges), F.lit(0))
    return df.groupBy(index.alias("bin")).agg(
        F.avg(label(F.col(LABEL))).alias("fraction_positive"),
        F.avg(SCORE).alias("mean_predicted"),
        F.count(F.lit(1)).alias("rows"),
    )


def score_range(df: DataFrame, column: str) -> tuple[float, float]:
    """Smallest and largest training score; kept with the model."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    return (0.0, 0.0) if low is None else (float(low), float(high))


def minmax_score(column: Column, low: float, high: float, negate: bool = False) -> Column:
    """Rescale by the training range into [0, 1]; a constant range gives 0."""
    if high == low:
        return F.lit(0.0)
    scaled = (column - low) / (high - low)
    scaled = F.greatest(F.least(scaled, F.lit(1.0)), F.lit(0.0))
    return 1 - scaled if negate else scaled


def minmax_by_subquery(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rescale by the table's own range, as one plan."""
    span = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    low, high = span.getField("lo"), span.getField("hi")
    return df.withColumn(
        name, F.coalesce((F.col(column) - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
    )


def model_comparison(long_scores: DataFrame, model: str = "model") -> DataFrame:
    """Average precision and ROC AUC per model over long-format scores, best first."""
    areas = curve_table(long_scores, [model]).groupBy(model).agg(*_areas())
    return areas.orderBy(F.col("auc_pr").desc(), F.col(model))


def cv_summary(folds: DataFrame, gap: float = 0.15) -> DataFrame:
    """Per metric: mean train and validation value, validation spread, and an overfit mark.

    ``folds`` has (metric, train_value, validation_value) per fold.
    """
    row = folds.groupBy("metric").agg(
        F.avg("train_value").alias("train_mean"),
        F.avg("validation_value").alias("validation_mean"),
        F.stddev_pop("validation_value").alias("validation_std"),
    )
    return row.withColumn("overfit", (F.col("train_mean") - F.col("validation_mean")) > gap)
