"""Queries over scored rows: metrics, curves, calibration, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import metrics as m
from ledgerlens.operators.split import time_series_folds
from ledgerlens.workload.registry import register, rounded, rounded_sql, scored

THRESHOLD = 0.82

COUNTS_SQL = """CAST(count(*) FILTER (WHERE y = 1 AND p >= 0.82) AS BIGINT) AS true_positives,
  CAST(count(*) FILTER (WHERE y = 0 AND p >= 0.82) AS BIGINT) AS false_positives,
  CAST(count(*) FILTER (WHERE y = 0 AND p < 0.82) AS BIGINT) AS true_negatives,
  CAST(count(*) FILTER (WHERE y = 1 AND p < 0.82) AS BIGINT) AS false_negatives"""
CURVE_CTE = """s AS (SELECT p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM valid GROUP BY p),
c AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp,
      (SELECT sum(pos) FROM s) AS np, (SELECT sum(neg) FROM s) AS nn FROM s)"""
AUC_SQL = rounded_sql("sum(pos * (nn - fp + neg / 2)) / (max(np) * max(nn))", 6)
AP_SQL = rounded_sql("sum(pos / np * tp / (tp + fp))", 6)


def r6(df, *names):
    return df.withColumns({n: rounded(n, 6) for n in names})


@register("confusion", f"SELECT {COUNTS_SQL} FROM valid")
def confusion(spark, sf_dir):
    return m.confusion(scored(spark, sf_dir), THRESHOLD)


@register(
    "precision_recall_f1",
    f"""WITH k AS (SELECT {COUNTS_SQL} FROM valid)
    SELECT *, {rounded_sql('coalesce(true_positives / nullif(true_positives + false_positives, 0), 0)', 6)} AS "precision",
      {rounded_sql('coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0)', 6)} AS recall,
      {rounded_sql('coalesce(2 * true_positives / nullif(2 * true_positives + false_positives + false_negatives, 0), 0)', 6)} AS f1 FROM k""",
)
def precision_recall_f1(spark, sf_dir):
    return r6(m.precision_recall_f1(scored(spark, sf_dir), THRESHOLD), "precision", "recall", "f1")


@register("roc_auc", f"WITH {CURVE_CTE} SELECT {AUC_SQL} AS auc_roc FROM c")
def roc_auc(spark, sf_dir):
    return r6(m.roc_auc(scored(spark, sf_dir)), "auc_roc")


@register("average_precision", f"WITH {CURVE_CTE} SELECT {AP_SQL} AS auc_pr FROM c")
def average_precision(spark, sf_dir):
    return r6(m.average_precision(scored(spark, sf_dir)), "auc_pr")


METRICS_SQL = f"""{CURVE_CTE}, a AS (SELECT {AUC_SQL} AS auc_roc, {AP_SQL} AS auc_pr FROM c),
k AS (SELECT {COUNTS_SQL} FROM valid),
metrics AS (SELECT auc_roc, auc_pr, true_positives, false_positives, true_negatives, false_negatives,
  {rounded_sql('coalesce(true_positives / nullif(true_positives + false_positives, 0), 0)', 6)} AS "precision",
  {rounded_sql('coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0)', 6)} AS recall,
  {rounded_sql('coalesce(2 * true_positives / nullif(2 * true_positives + false_positives + false_negatives, 0), 0)', 6)} AS f1
  FROM a, k)"""


@register("collect_metrics", f"WITH {METRICS_SQL} SELECT * FROM metrics")
def collect_metrics(spark, sf_dir):
    out = m.collect_metrics(scored(spark, sf_dir), THRESHOLD)
    return r6(out, "auc_roc", "auc_pr", "precision", "recall", "f1")


@register(
    "quality_gate",
    f"WITH {METRICS_SQL} SELECT auc_pr, recall, auc_pr >= 0.20 AND recall >= 0.65 AS passed FROM metrics",
)
def quality_gate(spark, sf_dir):
    return r6(m.quality_gate(m.collect_metrics(scored(spark, sf_dir), THRESHOLD)), "auc_pr", "recall")


@register(
    "pr_curve",
    f"""WITH {CURVE_CTE} SELECT p AS threshold, {rounded_sql('tp / (tp + fp)', 6)} AS "precision",
    {rounded_sql('tp / np', 6)} AS recall FROM c""",
)
def pr_curve(spark, sf_dir):
    return r6(m.pr_curve(scored(spark, sf_dir)), "precision", "recall")


@register(
    "roc_curve",
    f"WITH {CURVE_CTE} SELECT p AS threshold, {rounded_sql('fp / nn', 6)} AS fpr, {rounded_sql('tp / np', 6)} AS tpr FROM c",
)
def roc_curve(spark, sf_dir):
    return r6(m.roc_curve(scored(spark, sf_dir)), "fpr", "tpr")


@register(
    "f2_threshold",
    f"""WITH {CURVE_CTE}, q AS (SELECT p, tp / (tp + fp) AS pr, tp / np AS re FROM c),
    f AS (SELECT p, pr, re, 5 * pr * re / (4 * pr + re + 1e-9) AS f2 FROM q)
    SELECT p AS threshold, {rounded_sql('pr', 6)} AS "precision", {rounded_sql('re', 6)} AS recall, {rounded_sql('f2', 6)} AS f2
    FROM f ORDER BY round(f.f2, 12) DESC, p LIMIT 1""",
)
def f2_threshold(spark, sf_dir):
    return r6(m.f2_threshold(scored(spark, sf_dir)), "precision", "recall", "f2")


def _class_sql(name, hit, over, missed):
    return f"""SELECT '{name}' AS class, coalesce({hit} / nullif({hit} + {over}, 0), 0) AS pr,
      coalesce({hit} / nullif({hit} + {missed}, 0), 0) AS re,
      coalesce(2 * {hit} / nullif(2 * {hit} + {over} + {missed}, 0), 0) AS f, {hit} + {missed} AS support FROM k"""


TP, FP, TN, FN = "true_positives", "false_positives", "true_negatives", "false_negatives"


@register(
    "classification_report",
    f"""WITH k AS (SELECT {COUNTS_SQL} FROM valid),
    e AS ({_class_sql('0', TN, FN, FP)} UNION ALL {_class_sql('1', TP, FP, FN)}),
    u AS (SELECT * FROM e
      UNION ALL SELECT 'accuracy', NULL, NULL, (SELECT ({TP} + {TN}) / ({TP} + {TN} + {FP} + {FN}) FROM k), (SELECT sum(support) FROM e)
      UNION ALL SELECT 'macro avg', avg(pr), avg(re), avg(f), sum(support) FROM e
      UNION ALL SELECT 'weighted avg', sum(pr * support) / sum(support), sum(re * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM e)
    SELECT class, {rounded_sql('pr', 6)} AS "precision", {rounded_sql('re', 6)} AS recall, {rounded_sql('f', 6)} AS f1,
      CAST(support AS BIGINT) AS support FROM u""",
)
def classification_report(spark, sf_dir):
    return r6(m.classification_report(scored(spark, sf_dir), THRESHOLD), "precision", "recall", "f1")


BIN_SQL = "CAST(" + " + ".join(f"CAST(p > CAST({i} AS DOUBLE) / 10 AS INTEGER)" for i in range(1, 10)) + " AS INTEGER)"


@register(
    "calibration_curve",
    f"""SELECT {BIN_SQL} AS bin, {rounded_sql('avg(y)', 6)} AS fraction_positive, {rounded_sql('avg(p)', 6)} AS mean_predicted,
    CAST(count(*) AS BIGINT) AS rows FROM valid GROUP BY 1""",
)
def calibration_curve(spark, sf_dir):
    return r6(m.calibration_curve(scored(spark, sf_dir)), "fraction_positive", "mean_predicted")


@register(
    "minmax_score",
    f"""SELECT row_key, {rounded_sql('(transactionAmount - (SELECT min(transactionAmount) FROM valid)) / ((SELECT max(transactionAmount) FROM valid) - (SELECT min(transactionAmount) FROM valid))', 6)} AS score FROM valid""",
)
def minmax_score(spark, sf_dir):
    df = m.minmax_by_subquery(scored(spark, sf_dir), "transactionAmount", "score")
    return r6(df, "score").select("row_key", "score")


MODELS = {"m1": (7919, 1000), "m2": (104729, 997), "m3": (31, 7)}


def long_scores(spark, sf_dir):
    pairs = [
        F.struct(
            F.lit(name).alias("model"),
            (F.pmod(F.col("row_key") * a, F.lit(b)) / F.lit(float(b))).alias("fraud_probability"),
        )
        for name, (a, b) in MODELS.items()
    ]
    return scored(spark, sf_dir).select("isFraud", F.inline(F.array(*pairs)))


MODEL_CTE = " UNION ALL ".join(
    f"SELECT '{name}' AS model, y, ((row_key * {a}) % {b}) / CAST({b} AS DOUBLE) AS p FROM valid"
    for name, (a, b) in MODELS.items()
)


@register(
    "model_comparison",
    f"""WITH l AS ({MODEL_CTE}),
    s AS (SELECT model, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM l GROUP BY 1, 2),
    c AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY model ORDER BY p DESC) AS fp,
      sum(pos) OVER (PARTITION BY model) AS np, sum(neg) OVER (PARTITION BY model) AS nn FROM s)
    SELECT model, {AP_SQL} AS auc_pr, {AUC_SQL} AS auc_roc FROM c GROUP BY model""",
)
def model_comparison(spark, sf_dir):
    return r6(m.model_comparison(long_scores(spark, sf_dir)), "auc_pr", "auc_roc")


FOLD_CTE = """o AS (SELECT *, row_number() OVER (ORDER BY us, row_key) - 1 AS i, count(*) OVER () AS n FROM valid),
folds AS (SELECT *, CAST(greatest(0, CASE WHEN i < n - {k} * (n // ({k} + 1)) THEN 0
  ELSE 1 + (i - (n - {k} * (n // ({k} + 1)))) // (n // ({k} + 1)) END) AS INTEGER) AS fold FROM o)"""


@register(
    "cv_summary",
    f"""WITH {FOLD_CTE.format(k=5)}, f AS (SELECT unnest([1,2,3,4,5]) AS v),
    j AS (SELECT v, fold = v AS held, y, p FROM f JOIN folds ON fold <= v),
    k AS (SELECT v,
      coalesce(count(*) FILTER (WHERE NOT held AND y = 1 AND p >= 0.5) / nullif(count(*) FILTER (WHERE NOT held AND p >= 0.5), 0), 0) AS tp_,
      coalesce(count(*) FILTER (WHERE held AND y = 1 AND p >= 0.5) / nullif(count(*) FILTER (WHERE held AND p >= 0.5), 0), 0) AS vp_,
      coalesce(count(*) FILTER (WHERE NOT held AND y = 1 AND p >= 0.5) / nullif(count(*) FILTER (WHERE NOT held AND y = 1), 0), 0) AS tr_,
      coalesce(count(*) FILTER (WHERE held AND y = 1 AND p >= 0.5) / nullif(count(*) FILTER (WHERE held AND y = 1), 0), 0) AS vr_ FROM j GROUP BY v),
    u AS (SELECT 'precision' AS metric, tp_ AS t, vp_ AS h FROM k UNION ALL SELECT 'recall', tr_, vr_ FROM k)
    SELECT metric, {rounded_sql('avg(t)', 6)} AS train_mean, {rounded_sql('avg(h)', 6)} AS validation_mean,
      {rounded_sql('stddev_pop(h)', 6)} AS validation_std, avg(t) - avg(h) > 0.15 AS overfit FROM u GROUP BY metric""",
)
def cv_summary(spark, sf_dir):
    folded = time_series_folds(scored(spark, sf_dir), 5)
    out = r6(m.cv_summary(fold_metrics(folded, 5, 0.5)), "train_mean", "validation_mean", "validation_std")
    return out


def fold_metrics(folded, k, threshold):
    """(metric, train_value, validation_value) per fold, all folds in one aggregation."""
    fold = F.explode(F.sequence(F.greatest(F.col("fold"), F.lit(1)), F.lit(k)))
    rows = folded.select("fold", "isFraud", "fraud_probability", fold.alias("v"))
    held, hit = F.col("fold") == F.col("v"), F.col("fraud_probability") >= threshold
    fraud = F.col("isFraud") == 1

    def rate(side, base):
        whole = F.count_if(side & base)
        return F.coalesce(F.count_if(side & fraud & hit) / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))

    per_fold = rows.groupBy("v").agg(
        F.array(
            F.struct(F.lit("precision").alias("metric"), rate(~held, hit).alias("train_value"), rate(held, hit).alias("validation_value")),
            F.struct(F.lit("recall").alias("metric"), rate(~held, fraud).alias("train_value"), rate(held, fraud).alias("validation_value")),
        ).alias("x")
    )
    return per_fold.select(F.inline("x"))
