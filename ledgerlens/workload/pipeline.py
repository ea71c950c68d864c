"""Queries over the composed feature pipeline and scoring rows without a trained model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import features as feat
from ledgerlens.operators import history as h
from ledgerlens.plans.feature_pipeline import FeaturePipeline, derive, train_test_features
from ledgerlens.schema import CATEGORICAL_FEATURES, ENCODED_ENTITIES, FEATURE_COLUMNS
from ledgerlens.workload.registry import coerced, register, rounded, rounded_sql, valid
from ledgerlens.workload.rows import DAYS, RISK_SQL, TIER_SQL, US
from ledgerlens.workload.windows import COUNTS_SQL, HISTORY_SQL

RATES = [f"{c}_fraud_rate" for c in ENCODED_ENTITIES]
LOCAL_SQL = f"""
  CAST(hour(ets) AS INTEGER) AS txn_hour, CAST(isodow(ets) - 1 AS INTEGER) AS txn_day_of_week, CAST(month(ets) AS INTEGER) AS txn_month,
  CAST(isodow(ets) >= 6 AS INTEGER) AS is_weekend, CAST(hour(ets) >= 22 OR hour(ets) <= 4 AS INTEGER) AS is_night_txn,
  greatest(coalesce({DAYS.format('us', US.format('accountOpenDate'))}, 0), 0) AS account_age_days,
  greatest(coalesce({DAYS.format('us', US.format('dateOfLastAddressChange'))}, 0), 0) AS days_since_address_change,
  coalesce(CAST(floor({DAYS.format(US.format('currentExpDate'), 'us')} / CAST(30 AS DOUBLE)) AS BIGINT), 0) AS months_to_expiry,
  {rounded_sql('coalesce(greatest(creditLimit - availableMoney, 0) / nullif(creditLimit, 0), 0)', 6)} AS utilization,
  {rounded_sql('coalesce(transactionAmount / nullif(creditLimit, 0), 0)', 6)} AS amount_to_limit_ratio,
  {RISK_SQL}, {TIER_SQL}"""
DIGITS = {
    "txn_amount_mean_7d": 4,
    "txn_amount_sum_24h": 2,
    "txn_amount_sum_7d": 2,
    "seconds_since_last_txn": 6,
    "utilization": 6,
    "amount_to_limit_ratio": 6,
    "transactionAmount": 2,
    **{r: 6 for r in RATES},
}
PLAIN_ROUND = {"txn_amount_sum_24h", "txn_amount_sum_7d", "seconds_since_last_txn", "transactionAmount"}
MONEY = ["transactionAmount", "creditLimit", "availableMoney", "currentBalance"]
# Model inputs are doubles in the pipeline's output; the SQL casts the whole-number ones to match.
WHOLE = [c for c in FEATURE_COLUMNS if c not in CATEGORICAL_FEATURES and c not in DIGITS and c not in MONEY]
FEATURES_CTE = f"""d AS (SELECT row_key, us, y, {', '.join(f"coalesce({c}, 'unknown') AS {c}" for c in CATEGORICAL_FEATURES)},
  round(transactionAmount, 2) AS transactionAmount, creditLimit, availableMoney, currentBalance, {LOCAL_SQL}, {HISTORY_SQL} FROM valid)"""


def select_sql(rates=True, extra=""):
    columns = [f"CAST({c} AS DOUBLE) AS {c}" if c in WHOLE else c for c in FEATURE_COLUMNS if c not in RATES]
    return f"SELECT row_key{extra}, {', '.join(columns)}" + (f", {', '.join(RATES)}" if rates else "")


def selected(df, *extra, rates=True):
    columns = []
    for c in FEATURE_COLUMNS:
        if c in RATES and not rates:
            continue
        if c in PLAIN_ROUND:
            columns.append(F.round(c, DIGITS[c]).alias(c))
        elif c in DIGITS:
            columns.append(rounded(c, DIGITS[c]).alias(c))
        else:
            columns.append(F.col(c))
    return df.select("row_key", *extra, *columns)


def encoded_cte(train="TRUE"):
    joins = " ".join(
        f"LEFT JOIN (SELECT {c} AS k, avg(y) AS r FROM d WHERE {train} GROUP BY 1) e_{c} ON e_{c}.k = d.{c}"
        for c in ENCODED_ENTITIES
    )
    rates = ", ".join(
        rounded_sql(f"coalesce(e_{c}.r, (SELECT avg(y) FROM d WHERE {train}))", 6) + f" AS {c}_fraud_rate"
        for c in ENCODED_ENTITIES
    )
    return f"{FEATURES_CTE}, f AS (SELECT d.*, {rates} FROM d {joins})"


@register("feature_pipeline", f"WITH {FEATURES_CTE} {select_sql(rates=False)} FROM d")
def feature_pipeline(spark, sf_dir):
    return selected(derive(valid(spark, sf_dir)), rates=False)


@register(
    "pipeline_fit",
    f"""WITH {encoded_cte()}, k AS (SELECT greatest(sum(y), sum(1 - y)) / sum(y) AS w FROM d)
    {select_sql(extra=", CAST(y AS INTEGER) AS isFraud, CASE WHEN y = 1 THEN " + rounded_sql("(SELECT w FROM k)", 6) + " ELSE " + rounded_sql("CAST(1 AS DOUBLE)", 6) + " END AS class_weight")} FROM f""",
)
def pipeline_fit(spark, sf_dir):
    out = FeaturePipeline().fit_transform(coerced(spark, sf_dir), with_class_weights=True)
    return selected(out, "isFraud", rounded("class_weight", 6).alias("class_weight"))


EARLY = "us < (SELECT max(us) FROM valid) - 6 * 86400000000"


@register("pipeline_transform", f"WITH {encoded_cte(EARLY)} {select_sql()} FROM f WHERE NOT ({EARLY})")
def pipeline_transform(spark, sf_dir):
    rows = valid(spark, sf_dir)
    cutoff = rows.select(F.max("event_ts")).scalar() - F.expr("INTERVAL 6 DAYS")
    past, current = rows.where(F.col("event_ts") < cutoff), rows.where(F.col("event_ts") >= cutoff)
    return selected(FeaturePipeline().fit(past).transform(current, lookback=past))


RATIO = """(SELECT us FROM o WHERE i = c), (SELECT row_key FROM o WHERE i = c)"""


@register(
    "train_test_features",
    f"WITH {encoded_cte(EARLY)} {select_sql(extra=f', CAST(NOT ({EARLY}) AS INTEGER) AS is_test')} FROM f",
)
def train_test(spark, sf_dir):
    features, _ = train_test_features(coerced(spark, sf_dir), test_days=6)
    return selected(features, "is_test")


@register(
    "flagship",
    f"""WITH w AS (SELECT merchantState, transactionAmount, {COUNTS_SQL}, {RISK_SQL} FROM valid)
    SELECT merchantState, CAST(count(*) AS BIGINT) AS txn_count, CAST(sum(txn_count_24h) AS BIGINT) AS velocity_24h,
      CAST(max(txn_count_7d) AS BIGINT) AS max_velocity_7d, CAST(sum(cvv_mismatch) AS BIGINT) AS cvv_mismatches,
      CAST(sum(cross_border) AS BIGINT) AS cross_border, {rounded_sql('avg(transactionAmount)', 4)} AS mean_amount FROM w GROUP BY 1""",
)
def flagship(spark, sf_dir):
    """Parse, filter, window, flag and aggregate: a risk summary by merchant state."""
    specs = [x for x in h.PIPELINE_SPECS if x.kind == "velocity"]
    rows = feat.risk_flags(h.history_features(valid(spark, sf_dir), "accountNumber", specs))
    return rows.groupBy("merchantState").agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.sum("txn_count_24h").alias("velocity_24h"),
        F.max("txn_count_7d").alias("max_velocity_7d"),
        F.sum("cvv_mismatch").cast("bigint").alias("cvv_mismatches"),
        F.sum("cross_border").cast("bigint").alias("cross_border"),
        rounded(F.avg("transactionAmount"), 4).alias("mean_amount"),
    )
