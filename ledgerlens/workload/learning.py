"""Queries over model training, scoring, resampling and explanations.

``train_gbt`` and ``stacked_model`` fit with the operators' own numbers. Tree counts and depths of the other queries are a
parameter of the workload, ``SMALL``; features, background rows and perturbations are the operators' own.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ledgerlens.models import training as t
from ledgerlens.models.isolation import fit_isolation_forest
from ledgerlens.models.preprocess import fit_preprocessor
from ledgerlens.models.reconstruction import fit_reconstruction
from ledgerlens.operators import explain as x
from ledgerlens.operators import metrics as m
from ledgerlens.operators import resample
from ledgerlens.operators.tree_explain import TreeExplainer, tree_contributions
from ledgerlens.operators.split import background_sample, calibration_split
from ledgerlens.plans.feature_pipeline import FeaturePipeline, train_test_features
from ledgerlens.plans.scoring import score_batch, score_frame
from ledgerlens.schema import CATEGORICAL_FEATURES, FEATURE_COLUMNS, NUMERIC_FEATURES
from ledgerlens.session import checkpointed, work_dir
from ledgerlens.workload.registry import coerced, raw, register, rounded, rounded_sql, scored

SMALL = {"num_trees": 5, "max_depth": 4}
SCORED = ["row_key", "isFraud", "fraud_probability", "prediction", "risk_band"]


# What the queries read of a feature row: key, time, label and model inputs.
MODEL_COLUMNS = ["row_key", "event_ts", "isFraud", *FEATURE_COLUMNS]


def prepared(spark, sf_dir):
    """(train features, test features, pipeline), computed once per query."""
    both, pipeline = train_test_features(coerced(spark, sf_dir), columns=MODEL_COLUMNS)
    both = checkpointed(both)
    return both.where("is_test = 0"), both.where("is_test = 1"), pipeline


def trained_query(name, model_name, **params):
    def run(spark, sf_dir):
        train, test, _ = prepared(spark, sf_dir)
        model = t.fit_model(train, model_name, **params)
        return score_frame(model, test, 0.5).select(*SCORED)

    register(name)(run)


trained_query("train_gbt", "xgboost")
trained_query("train_forest", "random_forest", **SMALL)
trained_query("train_logistic", "logistic_regression")


@register("preprocess")
def preprocess(spark, sf_dir):
    train, test, _ = prepared(spark, sf_dir)
    from pyspark.ml.functions import vector_to_array

    ready = fit_preprocessor(train).transform(test)
    x = vector_to_array("features")
    return ready.select("row_key", F.size(x).alias("width"), F.aggregate(x, F.lit(0.0), lambda a, b: a + b).alias("total"))


@register("score_frame")
def score(spark, sf_dir):
    train, test, _ = prepared(spark, sf_dir)
    return score_frame(t.fit_model(train, "catboost"), test).select(*SCORED)


@register("score_batch")
def batch(spark, sf_dir):
    train, _, pipeline = prepared(spark, sf_dir)
    model = t.fit_model(train, "logistic_regression")
    payloads = raw(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    scores, rejected = score_batch(payloads, model, pipeline, keep=("row_key",))
    joined = scores.select(
        "row_key", "fraud_probability", "risk_band", F.array_join("top_reasons", "; ").alias("reasons")
    )
    return joined.unionByName(
        rejected.select(
            F.get_json_object("value", "$.row_key").alias("row_key"),
            F.array_join("reject_reasons", "; ").alias("reasons"),
        ),
        allowMissingColumns=True,
    )


@register("save_load_model")
def save_load(spark, sf_dir):
    train, test, _ = prepared(spark, sf_dir)
    path = work_dir(spark, "model")
    t.save_model(t.fit_model(train, "random_forest", **SMALL), path, {"model_version": "v1"})
    model, metadata = t.load_model(spark, path)
    return score_frame(model, test).select(*SCORED, F.lit(metadata["model_version"]).alias("model_version"))


@register("isolation_forest")
def isolation_forest(spark, sf_dir):
    train, test, _ = prepared(spark, sf_dir)
    forest = fit_isolation_forest(train, NUMERIC_FEATURES, trees=50)
    return forest.transform(test).select("row_key", "isFraud", "iso_score")


@register("reconstruction_error")
def reconstruction(spark, sf_dir):
    train, test, _ = prepared(spark, sf_dir)
    return fit_reconstruction(train, NUMERIC_FEATURES).transform(test).select(
        "row_key", "isFraud", "reconstruction_error"
    )


@register("grid_search")
def grid(spark, sf_dir):
    train, _, _ = prepared(spark, sf_dir)
    found = t.grid_search(train, "random_forest", {"max_depth": [2, 4], "num_trees": [5]}, k=2)
    rows = [(str(p), i + 1, s, p == found.best) for p, scores in found.scores for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "params string, fold int, average_precision double, best boolean")


@register("stacked_model")
def stacked(spark, sf_dir):
    train, test, _ = prepared(spark, sf_dir)
    model = t.fit_stacked(train)
    return score_frame(model, test).select(
        *SCORED, *[f"{n}_score" for n in [*t.STACK_ANOMALY, *t.STACK_BOOSTERS]]
    )


@register("stacking_oof")
def stacking_oof(spark, sf_dir):
    train, test, _ = prepared(spark, sf_dir)
    model = t.fit_stacking_oof(train, k=2, num_trees=5, max_depth=4)
    return score_frame(model, test).select(*SCORED)


def calibrated(fit):
    def run(spark, sf_dir):
        train, test, _ = prepared(spark, sf_dir)
        early, late = calibration_split(train)
        model = t.fit_model(early, "random_forest", **SMALL)
        scores = model.transform(test)
        return fit(model.transform(late)).transform(scores, "calibrated").select(
            "row_key", "isFraud", "fraud_probability", "calibrated"
        )

    return run


register("calibrate_platt")(calibrated(t.calibrate_platt))
register("calibrate_isotonic")(calibrated(t.calibrate_isotonic))


@register("model_metrics")
def model_metrics(spark, sf_dir):
    """Train, score the held-out side, collect metrics and apply the promotion gate."""
    train, test, _ = prepared(spark, sf_dir)
    scored = score_frame(t.fit_model(train, "random_forest", **SMALL), test, 0.5)
    row = m.collect_metrics(scored, 0.5)
    return row.withColumn("passed", (F.col("auc_pr") >= 0.20) & (F.col("recall") >= 0.65))


NEAR_COLUMNS = ["transactionAmount", "availableMoney", "creditLimit", "currentBalance"]


@register("smote")
def smote(spark, sf_dir):
    """Fraud raised to 20 % of legitimate rows."""
    return resample.smote(scored(spark, sf_dir), NEAR_COLUMNS, ratio=0.2)


OUTSIDE = " OR ".join(f"s.{c} < low_{c} OR s.{c} > high_{c}" for c in NEAR_COLUMNS)


@register(
    "smote_balanced",
    """WITH n AS (SELECT count(*) FILTER (y = 1) AS fraud, count(*) FILTER (y = 0) AS legit FROM valid)
    SELECT 0 AS "isFraud", 0 AS synthetic, legit AS "rows", legit AS keys, 0 AS outside, 0 AS strange FROM n
    UNION ALL SELECT 1, 0, fraud, fraud, 0, 0 FROM n
    UNION ALL SELECT 1, 1, w, w, 0, 0 FROM (SELECT CAST(floor(0.2 * CAST(legit AS DOUBLE)) AS BIGINT) - fraud AS w FROM n) WHERE w > 0""",
)
def smote_balanced(spark, sf_dir):
    """The balanced table by class: rows, distinct keys, synthetic rows with a number outside the frauds' range and
    with a category that no fraud has."""
    table = checkpointed(resample.smote_table(scored(spark, sf_dir), NEAR_COLUMNS, CATEGORICAL_FEATURES, ratio=0.2))
    fraud = table.where("isFraud = 1 AND synthetic = 0")
    ranges = fraud.agg(*[f(c).alias(f"{n}_{c}") for f, n in ((F.min, "low"), (F.max, "high")) for c in NEAR_COLUMNS])
    seen = fraud.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in CATEGORICAL_FEATURES])).alias("e")).select("e.*").distinct()
    new = table.where("synthetic = 1")
    held = new.select("row_key", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in CATEGORICAL_FEATURES])).alias("e")).select("row_key", "e.*")
    strange = held.alias("h").join(
        seen.alias("s"), (F.col("h.c") == F.col("s.c")) & F.col("h.v").eqNullSafe(F.col("s.v")), "left_anti"
    ).select("row_key").distinct().withColumn("_strange", F.lit(1))
    rows = table.join(F.broadcast(ranges)).alias("s")  # one row
    return (
        rows.join(strange, "row_key", "left")
        .groupBy("isFraud", "synthetic")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct("row_key").alias("keys"),
            F.count_if((F.col("synthetic") == 1) & F.expr(OUTSIDE)).cast("int").alias("outside"),
            F.count("_strange").cast("int").alias("strange"),
        )
    )


@register("train_balanced")
def train_balanced(spark, sf_dir):
    """Held-out scores of a model fitted on all features after SMOTE to equal classes and removal of Tomek links."""
    train, test, _ = prepared(spark, sf_dir)
    table = checkpointed(resample.smote_tomek(train, NUMERIC_FEATURES, CATEGORICAL_FEATURES, ratio=1.0))
    return score_frame(t.fit_model(table, "logistic_regression"), test, 0.5).select(*SCORED)


APART = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in NEAR_COLUMNS)
NEAREST_SQL = f"min({{'d': sqrt({APART}), 'k': b.row_key}}).k"


@register(
    "tomek_links",
    f"""WITH p AS (SELECT row_key, y, {', '.join(f'coalesce({c}, 0) AS {c}' for c in NEAR_COLUMNS)} FROM valid),
    ahead AS (SELECT a.row_key AS minority, {NEAREST_SQL} AS majority FROM p a JOIN p b ON a.row_key <> b.row_key WHERE a.y = 1 GROUP BY a.row_key),
    crossing AS (SELECT minority, majority FROM ahead JOIN p ON row_key = majority WHERE y = 0),
    back AS (SELECT a.row_key AS majority, {NEAREST_SQL} AS minority FROM p a JOIN p b ON a.row_key <> b.row_key
             WHERE a.row_key IN (SELECT majority FROM crossing) GROUP BY a.row_key)
    SELECT row_key, y AS "isFraud" FROM valid WHERE row_key NOT IN (SELECT c.majority FROM crossing c JOIN back USING (minority, majority))""",
)
def tomek_links(spark, sf_dir):
    return resample.drop_tomek(scored(spark, sf_dir), NEAR_COLUMNS).select("row_key", "isFraud")


WEIGHTS = {"transactionAmount": 0.01, "availableMoney": -0.001, "creditLimit": 0.0005, "currentBalance": 0.0002}
LINEAR_SQL = " UNION ALL ".join(
    f"SELECT row_key, '{c}' AS feature, ({c} - (SELECT avg({c}) FROM valid)) * {w} AS v FROM valid"
    for c, w in WEIGHTS.items()
)


@register(
    "contributions_linear",
    f"""WITH c AS ({LINEAR_SQL})
    SELECT row_key, feature, {rounded_sql('v', 6)} AS value, CASE WHEN v > 0 THEN 'fraud' ELSE 'legit' END AS direction FROM c""",
)
def contributions_linear(spark, sf_dir):
    """Fixed weights against the table's means: every contribution of every row."""
    df = scored(spark, sf_dir)
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in WEIGHTS])).scalar()
    out = x.linear_contributions(df, WEIGHTS, {c: means.getField(c) for c in WEIGHTS})
    return out.select("row_key", "feature", rounded("value", 6).alias("value"), "direction")


EXPLAINED = FEATURE_COLUMNS


def alerts(spark, sf_dir):
    """(model, alert rows, background): the held-out rows at or above the default alert threshold."""
    train, test, _ = prepared(spark, sf_dir)
    model = t.fit_model(train, "random_forest", **SMALL)
    flagged = checkpointed(score_frame(model, test).where("risk_band = 'critical'"))
    background = checkpointed(background_sample(train, FEATURE_COLUMNS))
    return model, flagged, background


@register("contributions")
def contributions(spark, sf_dir):
    """Exact per-feature contributions of a trained linear model, all held-out rows."""
    train, test, _ = prepared(spark, sf_dir)
    model = t.fit_model(train, "logistic_regression")
    out = x.model_linear_contributions(model, test, background_sample(train, FEATURE_COLUMNS))
    return out.select("row_key", "feature", "value", "direction")


HELD_OUT_SQL = """WITH o AS (SELECT row_key, row_number() OVER (ORDER BY us, row_key) - 1 AS i, count(*) OVER () AS n FROM valid),
  held AS (SELECT row_key FROM o WHERE i >= greatest(1, least(n - 1, CAST(floor(n * 0.8) AS BIGINT))))"""


@register(
    "contributions_tree",
    f"{HELD_OUT_SQL} SELECT row_key, CAST({len(FEATURE_COLUMNS)} AS BIGINT) AS features, CAST(0 AS DOUBLE) AS gap FROM held",
)
def contributions_tree(spark, sf_dir):
    """Exact contributions of a forest for all held-out rows: they add up to the score minus the background's mean."""
    train, test, _ = prepared(spark, sf_dir)
    model = t.fit_model(train, "random_forest", **SMALL)
    explainer = TreeExplainer.of(model, background_sample(train, FEATURE_COLUMNS))
    totals = explainer.contributions(test).groupBy("row_key").agg(F.count("feature").alias("features"), F.sum("value").alias("total"))
    scores = model.transform(test).select(F.col("row_key").alias("_key"), "fraud_probability")
    gap = F.abs(F.round(F.col("total") - (F.col("fraud_probability") - explainer.base()), 9))
    return totals.join(scores, F.col("row_key") == F.col("_key")).select("row_key", "features", gap.alias("gap"))


@register("contributions_margin")
def contributions_margin(spark, sf_dir):
    """Contributions to the margin of boosted trees, all held-out rows."""
    train, test, _ = prepared(spark, sf_dir)
    model = t.fit_model(train, "xgboost", **SMALL)
    out = tree_contributions(model, test, background_sample(train, FEATURE_COLUMNS))
    return out.select("row_key", "feature", "value", "direction")


@register(
    "score_batch_explained",
    f"SELECT row_key, 'tree' AS methods, {x.TOP_FEATURES} AS contributions FROM valid",
)
def score_batch_explained(spark, sf_dir):
    """Payloads scored one by one, each with the exact contributions of its score."""
    train, _, pipeline = prepared(spark, sf_dir)
    model = t.fit_model(train, "random_forest", **SMALL)
    explainer = TreeExplainer.of(model, background_sample(train, FEATURE_COLUMNS))
    payloads = raw(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    explain = partial(explainer.contributions, top=x.TOP_FEATURES)
    scores, _ = score_batch(payloads, model, pipeline, keep=("row_key",), explain=explain)
    return scores.select(
        F.col("row_key").cast("bigint").alias("row_key"),
        F.array_join("explanation_methods", ",").alias("methods"),
        F.size("feature_contributions").alias("contributions"),
    )


@register("contributions_sampled")
def contributions_sampled(spark, sf_dir):
    model, flagged, background = alerts(spark, sf_dir)
    return x.sampled_contributions(model, flagged, background, EXPLAINED).select(
        "row_key", "feature", "value", "direction"
    )


@register("local_surrogate")
def surrogate(spark, sf_dir):
    model, flagged, background = alerts(spark, sf_dir)
    return x.local_surrogate(model, flagged, background, EXPLAINED).select(
        "row_key", "feature", "label", "value", "direction"
    )


@register("global_importance")
def importance(spark, sf_dir):
    model, flagged, background = alerts(spark, sf_dir)
    return x.global_importance(x.sampled_contributions(model, flagged, background, EXPLAINED))


@register("explain_frame")
def explain(spark, sf_dir):
    model, flagged, background = alerts(spark, sf_dir)
    parts = x.sampled_contributions(model, flagged, background, EXPLAINED).unionByName(
        x.local_surrogate(model, flagged, background, EXPLAINED)
    )
    out = x.explain_frame(flagged, parts)
    return out.select(
        "row_key",
        "risk_band",
        F.array_join("top_reasons", "; ").alias("top_reasons"),
        F.array_join("explanation_methods", ",").alias("methods"),
        F.size("feature_contributions").alias("contributions"),
    )


@register("train_job")
def train_job(spark, sf_dir):
    """Train, save, load in a new object: scores before and after, and the gate."""
    from ledgerlens.models.artifact import Artifact
    from ledgerlens.plans.training_job import train_job as job

    path = work_dir(spark, "artifact")
    fitted = job(coerced(spark, sf_dir), path, "random_forest", threshold=0.5, **SMALL)
    loaded = Artifact.load(spark, path)
    both, _ = train_test_features(coerced(spark, sf_dir))
    held = checkpointed(both.where("is_test = 1"))
    before = score_frame(fitted.model, held, 0.5).select("row_key", F.col("fraud_probability").alias("before"))
    after = score_frame(loaded.model, held, 0.5).select(F.col("row_key").alias("_key"), "fraud_probability", "risk_band")
    joined = before.join(after, F.col("row_key") == F.col("_key")).drop("_key")
    return joined.withColumn("passed", F.lit(bool(loaded.facts["passed"])))


@register(
    "score_batch_alone",
    """SELECT row_key, CAST(0 AS BIGINT) AS txn_count_30d, CAST(0 AS DOUBLE) AS txn_amount_sum_7d, 1 AS is_new_merchant,
    CAST(NULL AS STRING) AS reasons FROM valid
    UNION ALL SELECT row_key, NULL, NULL, NULL, array_to_string(list_filter([
      CASE WHEN transactionAmount IS NULL THEN 'amount missing' WHEN transactionAmount <= 0 THEN 'amount not positive' END,
      CASE WHEN accountNumber IS NULL THEN 'accountNumber missing' END,
      CASE WHEN customerId IS NULL THEN 'customerId missing' END,
      CASE WHEN merchantName IS NULL THEN 'merchantName missing' END,
      CASE WHEN TRY_CAST(transactionDateTime AS TIMESTAMP) IS NULL THEN 'transactionDateTime unreadable' END],
      lambda x: x IS NOT NULL), '; ')
    FROM txn WHERE row_key NOT IN (SELECT row_key FROM valid)""",
)
def score_batch_alone(spark, sf_dir):
    """History columns of payloads scored one by one, and the rejects, as they came."""
    train, _, pipeline = prepared(spark, sf_dir)
    payloads = raw(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    model = t.fit_model(train, "logistic_regression")
    scores, rejected = score_batch(payloads, model, pipeline, keep=("row_key",))
    key = F.get_json_object("value", "$.row_key")
    return scores.select(
        F.col("row_key").cast("bigint").alias("row_key"),
        F.col("txn_count_30d").cast("bigint").alias("txn_count_30d"),
        "txn_amount_sum_7d",
        F.col("is_new_merchant").cast("int").alias("is_new_merchant"),
    ).unionByName(
        rejected.select(key.cast("bigint").alias("row_key"), F.array_join("reject_reasons", "; ").alias("reasons")),
        allowMissingColumns=True,
    )
