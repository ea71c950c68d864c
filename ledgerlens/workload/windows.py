"""Queries over the per-entity history windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import history as h
from ledgerlens.workload.registry import register, rounded, rounded_sql, valid

DAY = 86_400_000_000
HOUR = 3_600_000_000
# Forces the chunked path on most accounts, so both ways are compared with the same SQL.
FORCED_HOT_ROWS = 40


def frame(hours: int, entity: str = "accountNumber") -> str:
    return f"OVER (PARTITION BY {entity} ORDER BY us RANGE BETWEEN {hours * HOUR} PRECEDING AND 1 PRECEDING)"


COUNTS_SQL = ", ".join(
    f"CAST(count(*) {frame(hrs)} AS BIGINT) AS txn_count_{name}"
    for name, hrs in (("24h", 24), ("48h", 48), ("7d", 168), ("30d", 720))
)
SUMS_SQL = ", ".join(
    f"round(coalesce(sum(transactionAmount) {frame(hrs)}, 0), 2) AS txn_amount_sum_{name}"
    for name, hrs in (("24h", 24), ("7d", 168))
)
MEAN_SQL = rounded_sql(f"coalesce(avg(transactionAmount) {frame(168)}, 0)", 4) + " AS txn_amount_mean_7d"
GAP_SQL = "(us - lag(us) OVER (PARTITION BY accountNumber ORDER BY us, row_key))"
SECS_SQL = f"round(coalesce({GAP_SQL} / CAST(1000000 AS DOUBLE), 0), 6) AS seconds_since_last_txn"
NEW_SQL = """CAST(row_number() OVER (PARTITION BY accountNumber, merchantName ORDER BY us, row_key) = 1 AS INTEGER)
  AS is_new_merchant"""
HISTORY_SQL = ", ".join([COUNTS_SQL, SUMS_SQL, MEAN_SQL, SECS_SQL, NEW_SQL])

COUNT_COLUMNS = [f"txn_count_{w}" for w in ("24h", "48h", "7d", "30d")]
SUM_COLUMNS = ["txn_amount_sum_24h", "txn_amount_sum_7d"]


def specs(kind):
    return [s for s in h.PIPELINE_SPECS if s.kind == kind]


def pipeline_columns(df):
    """The pipeline history columns, rounded as in the SQL."""
    return df.select(
        "row_key",
        *COUNT_COLUMNS,
        *[F.round(c, 2).alias(c) for c in SUM_COLUMNS],
        rounded("txn_amount_mean_7d", 4).alias("txn_amount_mean_7d"),
        F.round("seconds_since_last_txn", 6).alias("seconds_since_last_txn"),
        "is_new_merchant",
    )


@register("hist_counts", f"SELECT row_key, {COUNTS_SQL} FROM valid")
def hist_counts(spark, sf_dir):
    df = h.history_features(valid(spark, sf_dir), "accountNumber", specs("velocity"))
    return df.select("row_key", *COUNT_COLUMNS)


@register("hist_sums", f"SELECT row_key, {SUMS_SQL} FROM valid")
def hist_sums(spark, sf_dir):
    df = h.history_features(valid(spark, sf_dir), "accountNumber", specs("amount_sum"))
    return df.select("row_key", *[F.round(c, 2).alias(c) for c in SUM_COLUMNS])


@register("hist_mean_7d", f"SELECT row_key, {MEAN_SQL} FROM valid")
def hist_mean(spark, sf_dir):
    df = h.history_features(valid(spark, sf_dir), "accountNumber", specs("amount_mean"))
    return df.select("row_key", rounded("txn_amount_mean_7d", 4).alias("txn_amount_mean_7d"))


@register("secs_since_last", f"SELECT row_key, {SECS_SQL} FROM valid")
def secs_since_last(spark, sf_dir):
    df = h.gap_features(valid(spark, sf_dir))
    return df.select(
        "row_key",
        F.round(F.coalesce(F.col("_gap_us") / 1e6, F.lit(0.0)), 6).alias("seconds_since_last_txn"),
    )


@register("is_new_merchant", f"SELECT row_key, {NEW_SQL} FROM valid")
def is_new_merchant(spark, sf_dir):
    df = h.history_features(valid(spark, sf_dir), "accountNumber", (), new_merchant=True)
    return df.select("row_key", "is_new_merchant")


@register("hist_pipeline", f"SELECT row_key, {HISTORY_SQL} FROM valid")
def hist_pipeline(spark, sf_dir):
    return pipeline_columns(h.pipeline_history(valid(spark, sf_dir)))


@register("hist_pipeline_hot_keys", f"SELECT row_key, {HISTORY_SQL} FROM valid")
def hist_pipeline_hot_keys(spark, sf_dir):
    """The same result with busy accounts split over range chunks."""
    return pipeline_columns(h.pipeline_history(valid(spark, sf_dir), hot_rows=FORCED_HOT_ROWS))


SPLIT_US = "(SELECT max(us) - 6 * 86400000000 FROM valid)"
LOOKBACK_SQL = f"SELECT * FROM (SELECT row_key, us, {HISTORY_SQL} FROM valid) WHERE us >= {SPLIT_US}"


def _parts(df):
    newest = df.select(F.max("event_ts")).scalar()
    cutoff = newest - F.expr("INTERVAL 6 DAYS")
    return df.where(F.col("event_ts") < cutoff), df.where(F.col("event_ts") >= cutoff)


@register("hist_with_lookback", LOOKBACK_SQL.replace("SELECT * FROM", "SELECT * EXCLUDE (us) FROM"))
def hist_with_lookback(spark, sf_dir):
    past, current = _parts(valid(spark, sf_dir))
    return pipeline_columns(h.pipeline_history(current, lookback=past))


@register("hist_with_lookback_hot_keys", LOOKBACK_SQL.replace("SELECT * FROM", "SELECT * EXCLUDE (us) FROM"))
def hist_with_lookback_hot_keys(spark, sf_dir):
    past, current = _parts(valid(spark, sf_dir))
    return pipeline_columns(h.pipeline_history(current, lookback=past, hot_rows=FORCED_HOT_ROWS))


AGGREGATES = {
    "velocity": "CAST(count(*) {f} AS BIGINT)",
    "amount_sum": "round(coalesce(sum(transactionAmount) {f}, 0), 2)",
    "amount_mean": rounded_sql("coalesce(avg(transactionAmount) {f}, 0)", 4),
    "amount_std": rounded_sql("coalesce(stddev_samp(transactionAmount) {f}, 0)", 4),
    "amount_max": "round(coalesce(max(transactionAmount) {f}, 0), 2)",
    "total_fraud": "CAST(coalesce(sum(y) {f}, 0) AS BIGINT)",
    "fraud_rate": rounded_sql("coalesce(avg(y) {f}, 0)", 6),
}
DIGITS = {"amount_sum": 2, "amount_mean": 4, "amount_std": 4, "amount_max": 2, "fraud_rate": 6}
HOURS = {"1h": 1, "24h": 24, "48h": 48, "72h": 72, "7D": 168, "14D": 336, "30D": 720, "90D": 2160, "180D": 4320, "365D": 8760}


def parametric_sql(entity, kinds, windows, source="valid"):
    columns = ", ".join(
        f'{AGGREGATES[k].format(f=frame(HOURS[w], entity))} AS "{k}_{entity}_{w}"'
        for k in kinds
        for w in windows
    )
    return f"SELECT row_key, {columns} FROM {source}"


def parametric_columns(df, entity, kinds, windows, *extra):
    out = ["row_key", *extra]
    for k in kinds:
        for w in windows:
            name = f"{k}_{entity}_{w}"
            out.append((F.round(name, 2) if DIGITS[k] == 2 else rounded(name, DIGITS[k])).alias(name) if k in DIGITS else F.col(name))
    return df.select(*out)


@register("hist_parametric", parametric_sql("accountNumber", h.KINDS, list(HOURS)))
def hist_parametric(spark, sf_dir):
    df = h.parametric_history(valid(spark, sf_dir), "accountNumber", h.KINDS)
    return parametric_columns(df, "accountNumber", h.KINDS, list(HOURS))


HOT_WINDOWS = ["1h", "24h", "7D", "30D"]


@register("hist_parametric_hot_keys", parametric_sql("accountNumber", h.KINDS, HOT_WINDOWS))
def hist_parametric_hot_keys(spark, sf_dir):
    df = h.parametric_history(
        valid(spark, sf_dir), "accountNumber", h.KINDS, HOT_WINDOWS, hot_rows=FORCED_HOT_ROWS
    )
    return parametric_columns(df, "accountNumber", h.KINDS, HOT_WINDOWS)


@register("hist_parametric_merchant", parametric_sql("merchantName", ["fraud_rate"], ["7D", "30D", "90D"]))
def hist_parametric_merchant(spark, sf_dir):
    df = h.parametric_history(valid(spark, sf_dir), "merchantName", "fraud_rate", ["7D", "30D", "90D"])
    return parametric_columns(df, "merchantName", ["fraud_rate"], ["7D", "30D", "90D"])


RECENCY_SQL = f"""WITH g AS (SELECT row_key, floor({GAP_SQL} / CAST(86400000000 AS DOUBLE)) AS d FROM valid)
SELECT row_key, coalesce(d, (SELECT quantile_cont(d, 0.5) FROM g)) AS days_since_last_txn FROM g"""


@register("recency_days", RECENCY_SQL)
def recency_days(spark, sf_dir):
    return h.recency_days(valid(spark, sf_dir)).select("row_key", "days_since_last_txn")


BURST_SQL = f"""WITH g AS (SELECT row_key, coalesce({GAP_SQL} / CAST(1000000 AS DOUBLE), 99999) AS s FROM valid)
SELECT row_key, round(s, 6) AS time_since_last_txn_sec, CAST(s < 300 AS INTEGER) AS is_burst FROM g"""


@register("time_since_last_burst", BURST_SQL)
def time_since_last_burst(spark, sf_dir):
    return h.burst_features(valid(spark, sf_dir)).select(
        "row_key", F.round("time_since_last_txn_sec", 6).alias("time_since_last_txn_sec"), "is_burst"
    )


RANK_SQL = """WITH r AS (SELECT row_key, row_number() OVER (PARTITION BY accountNumber, merchantName ORDER BY us, row_key) - 1 AS k FROM valid)
SELECT row_key, CAST(k AS BIGINT) AS merchant_txn_rank, CAST(k = 0 AS INTEGER) AS is_new_merchant_flag FROM r"""


@register("merchant_txn_rank", RANK_SQL)
def merchant_txn_rank(spark, sf_dir):
    return h.merchant_rank(valid(spark, sf_dir)).select(
        "row_key", "merchant_txn_rank", "is_new_merchant_flag"
    )


@register("merchant_txn_rank_hot_keys", RANK_SQL)
def merchant_txn_rank_hot_keys(spark, sf_dir):
    return h.merchant_rank(valid(spark, sf_dir), hot_rows=2).select(
        "row_key", "merchant_txn_rank", "is_new_merchant_flag"
    )


@register("is_new_merchant_nb", "WITH r AS (SELECT row_key, row_number() OVER (PARTITION BY accountNumber, merchantName ORDER BY us, row_key) AS k FROM valid) SELECT row_key, CAST(k = 1 AS INTEGER) AS is_new_merchant FROM r")
def is_new_merchant_nb(spark, sf_dir):
    df = h.merchant_rank(valid(spark, sf_dir))
    return df.select("row_key", F.col("is_new_merchant_flag").alias("is_new_merchant"))


SPLIT_KINDS, SPLIT_WINDOWS = ["total_fraud", "fraud_rate"], ["1h", "24h", "48h", "7D", "30D"]


@register(
    "history_split_aware",
    parametric_sql("accountNumber", SPLIT_KINDS, SPLIT_WINDOWS).replace(
        "SELECT row_key,", f"SELECT row_key, CAST(us >= {SPLIT_US} AS INTEGER) AS is_test,", 1
    ),
)
def history_split_aware(spark, sf_dir):
    train, test = _parts(valid(spark, sf_dir))
    df = h.split_aware_history(train, test, "accountNumber", SPLIT_KINDS, SPLIT_WINDOWS)
    return parametric_columns(df, "accountNumber", SPLIT_KINDS, SPLIT_WINDOWS, "is_test")


@register(
    "history_retention",
    """WITH c AS (SELECT * FROM valid WHERE us >= (SELECT max(us) - 2 * 86400000000 FROM valid))
    SELECT row_key FROM valid WHERE us >= (SELECT max(us) FROM c) - 10 * 86400000000""",
)
def history_retention(spark, sf_dir):
    df = valid(spark, sf_dir)
    cutoff = df.select(F.max("event_ts")).scalar() - F.expr("INTERVAL 2 DAYS")
    current, history = df.where(F.col("event_ts") >= cutoff), df.where(F.col("event_ts") < cutoff)
    return h.retain_recent(history, current, days=10).select("row_key")


ZSCORE_SQL = f"""WITH z AS (SELECT row_key, transactionAmount AS a,
    coalesce(avg(transactionAmount) {frame(720, 'merchantName')}, 0) AS m,
    stddev_samp(transactionAmount) {frame(720, 'merchantName')} AS sd FROM valid)
SELECT row_key, round(greatest(least(coalesce((a - m) / nullif(sd, 0), 0), 10), -10), 4) AS amount_zscore FROM z"""


@register("amount_zscore_entity", ZSCORE_SQL)
def amount_zscore_entity(spark, sf_dir):
    return h.amount_zscore(valid(spark, sf_dir)).select(
        "row_key", F.round("amount_zscore", 4).alias("amount_zscore")
    )
