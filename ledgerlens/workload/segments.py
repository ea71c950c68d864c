"""Queries over segment analytics, encoders and lookup joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import features as feat
from ledgerlens.functions import scalars as s
from ledgerlens.operators import encoding as enc
from ledgerlens.operators import profile
from ledgerlens.schema import ENCODED_ENTITIES
from ledgerlens.workload.registry import register, rounded, rounded_sql, scored
from ledgerlens.workload.rows import AGE_BUCKET_SQL, AGE_SQL, EXPIRY_BUCKET_SQL, MONTHS_SQL


def r(df, digits=6, *names):
    return df.withColumns({n: rounded(n, digits) for n in names})


NORMAL = "(SELECT *, " + ", ".join(f"coalesce({c}, 'unknown') AS n_{c}" for c in ENCODED_ENTITIES) + " FROM valid)"


def rates_sql(source=NORMAL):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS entity, n_{c} AS value, avg(y) AS rate, CAST(count(*) AS BIGINT) AS rows FROM {source} GROUP BY 2"
        for c in ENCODED_ENTITIES
    )


def normal(spark, sf_dir):
    """Valid rows with model-ready categories, so encoders see ``unknown`` for missing."""
    return feat.normalize_types(scored(spark, sf_dir))


FIT_SQL = f"""WITH e AS ({rates_sql()})
SELECT entity, value, {rounded_sql('rate', 6)} AS rate, rows, {rounded_sql('(SELECT avg(y) FROM valid)', 6)} AS global_rate FROM e"""


@register("encoder_fit", FIT_SQL)
def encoder_fit(spark, sf_dir):
    fitted = enc.encoder_fit(normal(spark, sf_dir))
    return fitted.rates.select(
        "entity",
        "value",
        rounded("rate", 6).alias("rate"),
        "rows",
        rounded(F.lit(fitted.global_rate), 6).alias("global_rate"),
    )


@register(
    "encoder_fit_partial",
    f"WITH e AS ({rates_sql()}) SELECT entity, value, {rounded_sql('rate', 6)} AS rate, rows FROM e",
)
def encoder_fit_partial(spark, sf_dir):
    df = normal(spark, sf_dir)
    chunks = [enc.encoder_partials(df.where(F.col("row_key") % 3 == i)) for i in range(3)]
    return enc.merge_partials(*chunks).select("entity", "value", rounded("rate", 6).alias("rate"), "rows")


EARLY = "(us < (SELECT max(us) FROM valid) - 6 * 86400000000)"


def parts(df):
    cutoff = df.select(F.max("event_ts")).scalar() - F.expr("INTERVAL 6 DAYS")
    return df.where(F.col("event_ts") < cutoff), df


@register(
    "encoder_apply",
    f"""WITH nv AS {NORMAL}, tr AS (SELECT * FROM nv WHERE {EARLY}), g AS (SELECT avg(y) AS v FROM tr)
    SELECT nv.row_key, {', '.join(rounded_sql(f'coalesce(e_{c}.rate, (SELECT v FROM g))', 6) + f' AS {c}_fraud_rate' for c in ENCODED_ENTITIES)}
    FROM nv {' '.join(f'LEFT JOIN (SELECT n_{c} AS k, avg(y) AS rate FROM tr GROUP BY 1) e_{c} ON e_{c}.k = nv.n_{c}' for c in ENCODED_ENTITIES)}""",
)
def encoder_apply(spark, sf_dir):
    train, everything = parts(normal(spark, sf_dir))
    out = enc.encoder_apply(everything, enc.encoder_fit(train))
    return out.select("row_key", *[rounded(f"{c}_fraud_rate", 6).alias(f"{c}_fraud_rate") for c in ENCODED_ENTITIES])


@register(
    "class_weights",
    f"""WITH k AS (SELECT sum(y) AS f, sum(1 - y) AS l FROM valid)
    SELECT row_key, CAST(y AS INTEGER) AS isFraud,
      CASE WHEN y = 1 THEN {rounded_sql('(SELECT greatest(f, l) / f FROM k)', 6)} ELSE CAST(1 AS DOUBLE) END AS class_weight FROM valid""",
)
def class_weights(spark, sf_dir):
    out = enc.class_weights(scored(spark, sf_dir))
    return out.select(
        "row_key",
        "isFraud",
        F.when(F.col("isFraud") == 1, rounded("class_weight", 6)).otherwise(F.col("class_weight")).alias("class_weight"),
    )


@register(
    "scale_pos_weight",
    f"SELECT CAST(sum(1 - y) AS BIGINT) AS legit, CAST(sum(y) AS BIGINT) AS fraud, {rounded_sql('sum(1 - y) / sum(y)', 6)} AS scale_pos_weight FROM valid",
)
def scale_pos_weight(spark, sf_dir):
    return r(enc.scale_pos_weight(scored(spark, sf_dir)), 6, "scale_pos_weight")


BAND_SQL = "CASE WHEN p >= 0.82 THEN 'critical' WHEN p >= 0.5 THEN 'elevated' ELSE 'normal' END"
MONITOR_SQL = f"""SELECT merchantState, {BAND_SQL} AS risk_band, CAST(count(*) AS BIGINT) AS txn_count,
  {rounded_sql('avg(p)', 6)} AS avg_fraud_probability FROM valid GROUP BY 1, 2"""


@register("monitor_summary", MONITOR_SQL)
def monitor_summary(spark, sf_dir):
    banded = scored(spark, sf_dir).withColumn("risk_band", s.risk_band(F.col("fraud_probability"), 0.82))
    return r(profile.monitor_summary(banded), 6, "avg_fraud_probability")


DISTINCT_SQL = """SELECT CAST(count(DISTINCT accountNumber) AS BIGINT) AS accounts, CAST(count(DISTINCT customerId) AS BIGINT) AS customers,
  CAST(count(*) AS BIGINT) AS rows, min(us) AS first_us, max(us) AS last_us FROM valid"""


@register("distinct_counts", DISTINCT_SQL)
def distinct_counts(spark, sf_dir):
    return profile.distinct_counts(scored(spark, sf_dir)).select(
        "accounts", "customers", "rows", s.micros(F.col("first_ts")).alias("first_us"), s.micros(F.col("last_ts")).alias("last_us")
    )


@register(
    "label_counts",
    f"SELECT CAST(y AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS rows, round(sum(transactionAmount), 2) AS amount_sum FROM valid GROUP BY 1",
)
def label_counts(spark, sf_dir):
    return profile.label_stats(scored(spark, sf_dir)).select("label", "rows", F.round("amount_sum", 2).alias("amount_sum"))


@register(
    "amount_by_label",
    f"""SELECT CAST(y AS BIGINT) AS label, round(sum(transactionAmount), 2) AS amount_sum,
    {rounded_sql('avg(transactionAmount)', 4)} AS amount_mean FROM valid GROUP BY 1""",
)
def amount_by_label(spark, sf_dir):
    return profile.label_stats(scored(spark, sf_dir)).select(
        "label", F.round("amount_sum", 2).alias("amount_sum"), rounded("amount_mean", 4).alias("amount_mean")
    )


PARTS_SQL = {"hour": "hour(ets)", "dayofweek": "isodow(ets) - 1", "month": "month(ets)", "year": "year(ets)"}


def pivot_sql(part):
    return f"""SELECT '{part}' AS part, CAST({PARTS_SQL[part]} AS INTEGER) AS time_value,
      CAST(nullif(count(*) FILTER (WHERE y = 0), 0) AS BIGINT) AS legit_count, CAST(nullif(count(*) FILTER (WHERE y = 1), 0) AS BIGINT) AS fraud_count,
      {rounded_sql('avg(transactionAmount) FILTER (WHERE y = 0)', 4)} AS legit_mean_amount,
      {rounded_sql('avg(transactionAmount) FILTER (WHERE y = 1)', 4)} AS fraud_mean_amount FROM valid GROUP BY 2"""


@register("pivot_time_label", " UNION ALL ".join(pivot_sql(p) for p in PARTS_SQL))
def pivot_time_label(spark, sf_dir):
    out = None
    for part in PARTS_SQL:
        one = profile.pivot_time_label(scored(spark, sf_dir), part).withColumn("part", F.lit(part))
        out = one if out is None else out.unionByName(one)
    return r(out, 4, "legit_mean_amount", "fraud_mean_amount")


@register(
    "pivot_card_present",
    """SELECT CAST(y AS BIGINT) AS label, CAST(nullif(count(*) FILTER (WHERE NOT cardPresent), 0) AS BIGINT) AS card_absent,
    CAST(nullif(count(*) FILTER (WHERE cardPresent), 0) AS BIGINT) AS card_present FROM valid GROUP BY 1""",
)
def pivot_card_present(spark, sf_dir):
    return profile.pivot_card_present(scored(spark, sf_dir))


@register(
    "daily_stats",
    f"""SELECT strftime(ets, '%Y-%m-%d') AS transactionDate, CAST(sum(y) AS BIGINT) AS fraud_count, round(sum(transactionAmount), 2) AS total_amount,
    {rounded_sql('avg(transactionAmount)', 4)} AS mean_amount FROM valid GROUP BY 1""",
)
def daily_stats(spark, sf_dir):
    out = profile.daily_stats(scored(spark, sf_dir))
    return out.select(
        F.date_format("transactionDate", "yyyy-MM-dd").alias("transactionDate"),
        "fraud_count",
        F.round("total_amount", 2).alias("total_amount"),
        rounded("mean_amount", 4).alias("mean_amount"),
    )


def risk_sql(key):
    fa = "coalesce(sum(CASE WHEN y = 1 THEN transactionAmount END), 0)"
    return f"""WITH t AS (SELECT sum(y) AS f, {fa} AS a FROM valid), k AS (SELECT *, {key} AS segment FROM valid)
    SELECT segment, CAST(count(accountNumber) AS BIGINT) AS total_transactions, CAST(sum(y) AS BIGINT) AS fraud_transactions,
      {rounded_sql('avg(y)', 6)} AS fraud_prob, {rounded_sql('coalesce(sum(y) / nullif((SELECT f FROM t), 0), 0)', 6)} AS fraud_prob_cond,
      {rounded_sql(f'coalesce({fa} / nullif((SELECT a FROM t), 0), 0)', 6)} AS fraud_amount_prop_cond,
      {rounded_sql(f'coalesce({fa} / nullif(sum(transactionAmount), 0), 0)', 6)} AS fraud_amount_prop
    FROM k WHERE segment IS NOT NULL GROUP BY segment"""


def risk_query(name, sql_key, key, **prepared):
    """``prepared`` columns are computed once, below the bucket expression that reads them."""

    def run(spark, sf_dir):
        rows = scored(spark, sf_dir)
        if prepared:
            rows = rows.withColumns({n: make() for n, make in prepared.items()})
        return r(
            profile.entity_risk(rows, key()),
            6,
            "fraud_prob",
            "fraud_prob_cond",
            "fraud_amount_prop_cond",
            "fraud_amount_prop",
        )

    register(name, risk_sql(sql_key))(run)


risk_query("entity_risk_category", "merchantCategoryCode", lambda: F.col("merchantCategoryCode"))
risk_query(
    "entity_risk_cvv",
    "CASE WHEN cardCVV IS NULL OR enteredCVV IS NULL THEN 'Missing' WHEN cardCVV <> enteredCVV THEN 'Mismatch' ELSE 'Match' END",
    lambda: s.cvv_status(F.col("cardCVV"), F.col("enteredCVV")),
)
risk_query(
    "entity_risk_account_age",
    AGE_BUCKET_SQL.format(AGE_SQL),
    lambda: s.account_age_bucket(F.col("age_days")),
    age_days=lambda: s.whole_days(F.col("event_ts"), s.to_time(F.col("accountOpenDate"))),
)
risk_query(
    "entity_risk_cross_border",
    "CASE WHEN acqCountry IS NULL OR merchantCountryCode IS NULL THEN 'Unknown' WHEN acqCountry <> merchantCountryCode THEN 'Cross-Border' ELSE 'Domestic' END",
    lambda: s.cross_border_status(F.col("acqCountry"), F.col("merchantCountryCode")),
)
risk_query("entity_risk_type", "transactionType", lambda: F.col("transactionType"))
risk_query(
    "entity_risk_expiry",
    EXPIRY_BUCKET_SQL.format(MONTHS_SQL),
    lambda: s.expiry_bucket(F.col("months")),
    months=lambda: s.months_left(s.to_time(F.col("currentExpDate")), F.col("event_ts")),
)
risk_query(
    "entity_risk_expiry_match",
    "CASE WHEN expirationDateKeyInMatch THEN 'Match' WHEN NOT expirationDateKeyInMatch THEN 'Mismatch' ELSE 'Unknown' END",
    lambda: s.expiry_key_status(F.col("expirationDateKeyInMatch")),
)


@register(
    "utilization_by_label",
    f"""WITH u AS (SELECT *, availableMoney / nullif(creditLimit, 0) AS u FROM valid)
    SELECT CAST(y AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS total_transactions, CAST(sum(y) AS BIGINT) AS fraud_transactions,
      {rounded_sql('avg(y)', 6)} AS fraud_prob, {rounded_sql('avg(u)', 6)} AS avg_utilization,
      {rounded_sql('coalesce(avg(u) FILTER (WHERE y = 1), 0)', 6)} AS avg_utilization_fraud_only FROM u GROUP BY 1""",
)
def utilization_by_label(spark, sf_dir):
    return r(
        profile.utilization_by_label(scored(spark, sf_dir)),
        6,
        "fraud_prob",
        "avg_utilization",
        "avg_utilization_fraud_only",
    )


LOCATION = "coalesce(acqCountry, 'Unknown') || '_' || coalesce(merchantCity, 'Unknown')"


@register(
    "location_stats",
    f"""SELECT {LOCATION} AS location, CAST(count(*) AS BIGINT) AS location_txn_count, {rounded_sql('avg(y)', 6)} AS location_fraud_rate
    FROM valid GROUP BY 1""",
)
def location_stats(spark, sf_dir):
    return r(profile.location_stats(scored(spark, sf_dir)), 6, "location_fraud_rate")


@register(
    "location_join",
    f"""WITH l AS (SELECT row_key, y, {LOCATION} AS location FROM valid)
    SELECT row_key, location, CAST(count(*) OVER (PARTITION BY location) AS BIGINT) AS location_txn_count,
    {rounded_sql('avg(y) OVER (PARTITION BY location)', 6)} AS location_fraud_rate FROM l""",
)
def location_join(spark, sf_dir):
    out = profile.location_features(scored(spark, sf_dir))
    return r(out.select("row_key", "location", "location_txn_count", "location_fraud_rate"), 6, "location_fraud_rate")


@register(
    "target_encode",
    f"SELECT row_key, {rounded_sql('avg(y) OVER (PARTITION BY merchantName)', 6)} AS merchantName_target_enc FROM valid",
)
def target_encode(spark, sf_dir):
    out = profile.target_encode(scored(spark, sf_dir), "merchantName")
    return r(out.select("row_key", "merchantName_target_enc"), 6, "merchantName_target_enc")


@register(
    "target_encode_join",
    f"""WITH t AS (SELECT accountNumber, avg(y) AS v FROM valid WHERE row_key % 4 = 0 GROUP BY 1)
    SELECT row_key, {rounded_sql('v', 6)} AS accountNumber_target_enc FROM valid LEFT JOIN t USING (accountNumber)""",
)
def target_encode_join(spark, sf_dir):
    df = scored(spark, sf_dir)
    out = profile.target_encode_join(df, df.where(F.col("row_key") % 4 == 0), "accountNumber")
    return r(out.select("row_key", "accountNumber_target_enc"), 6, "accountNumber_target_enc")


@register(
    "label_encode",
    """WITH d AS (SELECT customerId, dense_rank() OVER (ORDER BY customerId) - 1 AS c FROM
      (SELECT DISTINCT customerId FROM valid WHERE us < (SELECT min(us) FROM valid) + 12 * 3600000000))
    SELECT row_key, customerId, CAST(coalesce(c, -1) AS BIGINT) AS customerId_code FROM valid LEFT JOIN d USING (customerId)""",
)
def label_encode(spark, sf_dir):
    df = scored(spark, sf_dir)
    start = df.select(F.min("event_ts")).scalar()
    fitted = df.where(F.col("event_ts") < start + F.expr("INTERVAL 12 HOURS"))
    return profile.label_encode(df, fitted, "customerId").select("row_key", "customerId", "customerId_code")


QUANTILES = ", ".join(
    rounded_sql(f"quantile_cont(transactionAmount, {p})", 4) + f" AS p{round(p * 100):02d}" for p in profile.PERCENTILES
)


@register(
    "describe_percentiles",
    f"""SELECT CAST(y AS BIGINT) AS label, CAST(count(transactionAmount) AS BIGINT) AS "count", {rounded_sql('avg(transactionAmount)', 4)} AS mean,
    {rounded_sql('stddev_samp(transactionAmount)', 4)} AS std, min(transactionAmount) AS "min", max(transactionAmount) AS "max", {QUANTILES}
    FROM valid GROUP BY 1""",
)
def describe_percentiles(spark, sf_dir):
    names = ["mean", "std", *[f"p{round(p * 100):02d}" for p in profile.PERCENTILES]]
    return r(profile.describe(scored(spark, sf_dir), "transactionAmount"), 4, *names)


@register(
    "histogram",
    f"""WITH v AS (SELECT y, ln(transactionAmount) AS x FROM valid),
    b AS (SELECT y, min(x) AS lo, (max(x) - min(x)) / 10 AS w, count(*) AS n FROM v GROUP BY y),
    k AS (SELECT v.y, CAST(least(floor((x - lo) / w), 9) AS INTEGER) AS bin, lo, w, n FROM v JOIN b ON v.y = b.y)
    SELECT CAST(y AS BIGINT) AS label, bin, {rounded_sql('any_value(lo) + bin * any_value(w)', 6)} AS bin_start, CAST(count(*) AS BIGINT) AS "count",
      {rounded_sql('count(*) / (any_value(n) * any_value(w))', 6)} AS density FROM k GROUP BY y, bin""",
)
def histogram(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("log_amount", F.log("transactionAmount"))
    return r(profile.histogram(df, "log_amount"), 6, "bin_start", "density")


@register("distinct_values", "SELECT DISTINCT expirationDateKeyInMatch FROM txn WHERE row_key IN (SELECT row_key FROM valid)")
def distinct_values(spark, sf_dir):
    return profile.distinct_values(scored(spark, sf_dir), "expirationDateKeyInMatch")


MI_FEATURES = ["merchantName", "merchantCategoryCode", "transactionType", "posEntryMode", "acqCountry", "cardPresent"]


def mi_sql(feature):
    cell = f"coalesce(CAST({feature} AS VARCHAR), 'missing')"
    return f"""SELECT '{feature}' AS feature, {rounded_sql('greatest(sum(t), 0)', 6)} AS mutual_info FROM (
      SELECT c * ln(c * n / (fx * fy)) / n AS t FROM (
        SELECT DISTINCT {cell} AS x, y, CAST(count(*) OVER (PARTITION BY {cell}, y) AS DOUBLE) AS c, CAST(count(*) OVER (PARTITION BY {cell}) AS DOUBLE) AS fx,
          CAST(count(*) OVER (PARTITION BY y) AS DOUBLE) AS fy, CAST(count(*) OVER () AS DOUBLE) AS n FROM valid))"""


@register("mutual_info", " UNION ALL ".join(mi_sql(f) for f in MI_FEATURES))
def mutual_info(spark, sf_dir):
    return r(profile.mutual_information(scored(spark, sf_dir), MI_FEATURES), 6, "mutual_info")


@register("mutual_info_binned")
def mutual_info_binned(spark, sf_dir):
    df = scored(spark, sf_dir)
    return r(profile.mutual_information(df, ["transactionType"], ["transactionAmount", "availableMoney"]), 6, "mutual_info")
