"""Queries over row-local operators: coercion, validation, scalar projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import features as feat
from ledgerlens.functions import quality as q
from ledgerlens.functions import scalars as s
from ledgerlens.operators import profile
from ledgerlens.schema import TRANSACTION_FIELDS, coerce, sanitize_columns
from ledgerlens.workload.registry import coerced, raw, register, scored, valid

BOOL_SQL = """CASE WHEN lower(trim({0})) IN ('true','1','yes','y') THEN TRUE
  WHEN lower(trim({0})) IN ('false','0','no','n') THEN FALSE END"""
DAYS = "CAST(floor(({0} - {1}) / CAST(86400000000 AS DOUBLE)) AS BIGINT)"
TS = "TRY_CAST({0} AS TIMESTAMP)"
US = "epoch_us(TRY_CAST({0} AS TIMESTAMP))"
AGE_SQL = DAYS.format("us", US.format("accountOpenDate"))
MONTHS_SQL = f"CAST(floor({DAYS.format(US.format('currentExpDate'), 'us')} / CAST(30 AS DOUBLE)) AS BIGINT)"


@register(
    "coerce_schema",
    f"""SELECT row_key, {', '.join(f'CAST({c} AS {"VARCHAR" if t == "string" else t}) AS {c}'
        for c, t in TRANSACTION_FIELDS.items() if c not in ("echoBuffer", "customerId"))},
      CAST(NULL AS VARCHAR) AS customerId, CAST(NULL AS VARCHAR) AS echoBuffer FROM txn""",
)
def coerce_schema(spark, sf_dir):
    mixed = raw(spark, sf_dir).drop("customerId", "echoBuffer").withColumns(
        {
            "creditLimit": F.col("creditLimit").cast("string"),
            "isFraud": F.when(F.col("isFraud"), " Yes ").when(~F.col("isFraud"), "0"),
            "cardPresent": F.when(F.col("cardPresent"), "TRUE").otherwise("n"),
            "unknownColumn": F.lit("dropped"),
        }
    )
    return coerce(mixed, keep=("row_key",))


TOKENS = "array('true',' Yes','Y','1','FALSE','no','n ','0','1.0','maybe')"


@register(
    "parse_bool",
    f"""WITH t AS (SELECT row_key, list_extract(['true',' Yes','Y','1','FALSE','no','n ','0','1.0','maybe'],
      CAST(1 + row_key % 10 AS INTEGER)) AS token FROM txn)
    SELECT row_key, token, {BOOL_SQL.format('token')} AS parsed FROM t""",
)
def parse_bool(spark, sf_dir):
    token = F.expr(f"element_at({TOKENS}, cast(1 + row_key % 10 as int))")
    return raw(spark, sf_dir).select(
        "row_key", token.alias("token"), s.parse_bool(token).alias("parsed")
    )


@register(
    "sanitize_columns",
    "SELECT row_key AS row_id, merchantName, event AS row_id_2 FROM (SELECT *, accountNumber AS event FROM txn)",
)
def sanitize(spark, sf_dir):
    df = raw(spark, sf_dir).select("row_key", "merchantName", "accountNumber")
    return sanitize_columns(df.toDF("Unnamed: 0", "merchantName", ""))


@register(
    "validate",
    "SELECT row_key, accountNumber, customerId, merchantName, round(transactionAmount, 2) AS transactionAmount, us AS event_us FROM valid",
)
def validate(spark, sf_dir):
    return valid(spark, sf_dir).select(
        "row_key",
        "accountNumber",
        "customerId",
        "merchantName",
        F.round("transactionAmount", 2).alias("transactionAmount"),
        s.micros(F.col("event_ts")).alias("event_us"),
    )


@register(
    "validate_rejects",
    f"""SELECT row_key, concat_ws('; ',
        CASE WHEN transactionAmount IS NULL THEN 'amount missing'
             WHEN transactionAmount <= 0 THEN 'amount not positive' END,
        CASE WHEN accountNumber IS NULL THEN 'accountNumber missing' END,
        CASE WHEN customerId IS NULL THEN 'customerId missing' END,
        CASE WHEN merchantName IS NULL THEN 'merchantName missing' END,
        CASE WHEN {TS.format('transactionDateTime')} IS NULL THEN 'transactionDateTime unreadable' END) AS reasons
    FROM txn WHERE row_key NOT IN (SELECT row_key FROM valid)""",
)
def validate_rejects(spark, sf_dir):
    return q.rejects(coerced(spark, sf_dir)).select(
        "row_key", F.array_join("reject_reasons", "; ").alias("reasons")
    )


@register(
    "normalize_label",
    "SELECT row_key, CAST(CASE WHEN isFraud THEN 1 ELSE 0 END AS INTEGER) AS isFraud FROM txn",
)
def normalize_label(spark, sf_dir):
    return q.normalize_label(coerced(spark, sf_dir)).select("row_key", "isFraud")


_NULL_COLUMNS = list(TRANSACTION_FIELDS)


@register(
    "null_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS null_count FROM txn"
        for c in _NULL_COLUMNS
    ),
)
def null_counts(spark, sf_dir):
    return q.null_counts(coerced(spark, sf_dir).select(*_NULL_COLUMNS))


@register(
    "risk_filter",
    "SELECT row_key, p AS fraud_probability FROM valid WHERE p >= 0.82",
)
def risk_filter(spark, sf_dir):
    return profile.at_or_above(scored(spark, sf_dir), 0.82).select("row_key", "fraud_probability")


@register(
    "safe_casts",
    f"""SELECT row_key, epoch_us({TS.format('transactionDateTime')}) AS event_us,
      TRY_CAST(posEntryMode AS DOUBLE) AS entry_number,
      CAST(CASE WHEN expirationDateKeyInMatch THEN 1 ELSE 0 END AS INTEGER) AS key_match FROM txn""",
)
def safe_casts(spark, sf_dir):
    return coerced(spark, sf_dir).select(
        "row_key",
        s.micros(s.to_time(F.col("transactionDateTime"))).alias("event_us"),
        s.to_number(F.col("posEntryMode")).alias("entry_number"),
        s.flag(F.col("expirationDateKeyInMatch")).alias("key_match"),
    )


@register(
    "feat_temporal",
    f"""WITH e AS (SELECT row_key, {TS.format('transactionDateTime')} AS t FROM txn)
    SELECT row_key, epoch_us(t) AS event_us,
      CAST(coalesce(hour(t), -1) AS INTEGER) AS txn_hour,
      CAST(coalesce(isodow(t) - 1, -1) AS INTEGER) AS txn_day_of_week,
      CAST(coalesce(month(t), 0) AS INTEGER) AS txn_month,
      CAST(CASE WHEN isodow(t) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
      CAST(CASE WHEN hour(t) >= 22 OR hour(t) <= 4 THEN 1 ELSE 0 END AS INTEGER) AS is_night_txn
    FROM e""",
)
def feat_temporal(spark, sf_dir):
    return feat.temporal(coerced(spark, sf_dir)).select(
        "row_key",
        s.micros(F.col("event_ts")).alias("event_us"),
        "txn_hour",
        "txn_day_of_week",
        "txn_month",
        "is_weekend",
        "is_night_txn",
    )


@register(
    "feat_account_age",
    f"""WITH e AS (SELECT *, {US.format('transactionDateTime')} AS at_us FROM txn)
    SELECT row_key,
      greatest(coalesce({DAYS.format('at_us', US.format('accountOpenDate'))}, 0), 0) AS account_age_days,
      greatest(coalesce({DAYS.format('at_us', US.format('dateOfLastAddressChange'))}, 0), 0) AS days_since_address_change,
      coalesce(CAST(floor({DAYS.format(US.format('currentExpDate'), 'at_us')} / CAST(30 AS DOUBLE)) AS BIGINT), 0) AS months_to_expiry
    FROM e""",
)
def feat_account_age(spark, sf_dir):
    return feat.account_age(coerced(spark, sf_dir)).select(
        "row_key", "account_age_days", "days_since_address_change", "months_to_expiry"
    )


@register(
    "feat_amount_ratio",
    """SELECT row_key,
      round(coalesce(greatest(creditLimit - availableMoney, 0) / nullif(creditLimit, 0), 0), 6) AS utilization,
      round(coalesce(transactionAmount / nullif(creditLimit, 0), 0), 6) AS amount_to_limit_ratio FROM txn""",
)
def feat_amount_ratio(spark, sf_dir):
    return feat.amount_ratio(coerced(spark, sf_dir)).select(
        "row_key",
        F.round("utilization", 6).alias("utilization"),
        F.round("amount_to_limit_ratio", 6).alias("amount_to_limit_ratio"),
    )


RISK_SQL = """
  CAST(CASE WHEN cardCVV <> enteredCVV THEN 1 ELSE 0 END AS INTEGER) AS cvv_mismatch,
  CAST(CASE WHEN expirationDateKeyInMatch THEN 0 ELSE 1 END AS INTEGER) AS expiry_key_mismatch,
  CAST(CASE WHEN cardPresent THEN 1 ELSE 0 END AS INTEGER) AS card_present_flag,
  CAST(CASE WHEN coalesce(upper(acqCountry), 'UNKNOWN') <> coalesce(upper(merchantCountryCode), 'UNKNOWN')
       THEN 1 ELSE 0 END AS INTEGER) AS cross_border"""
TIER_SQL = """CAST(CASE WHEN cardPresent IS NULL OR NOT cardPresent THEN 2
  WHEN TRY_CAST(posEntryMode AS DOUBLE) IN (81, 90) OR TRY_CAST(posConditionCode AS DOUBLE) IN (8, 59, 99) THEN 3
  ELSE 1 END AS INTEGER) AS pos_risk_tier"""


@register("feat_risk_flags", f"SELECT row_key, {RISK_SQL} FROM txn")
def feat_risk_flags(spark, sf_dir):
    return feat.risk_flags(coerced(spark, sf_dir)).select(
        "row_key", "cvv_mismatch", "expiry_key_mismatch", "card_present_flag", "cross_border"
    )


@register("feat_pos_tier", f"SELECT row_key, {TIER_SQL} FROM txn")
def feat_pos_tier(spark, sf_dir):
    return feat.risk_flags(coerced(spark, sf_dir)).select("row_key", "pos_risk_tier")


@register(
    "feat_normalize_types",
    """SELECT row_key, coalesce(merchantName,'unknown') AS merchantName,
      coalesce(merchantCategoryCode,'unknown') AS merchantCategoryCode, coalesce(acqCountry,'unknown') AS acqCountry,
      coalesce(merchantCountryCode,'unknown') AS merchantCountryCode, coalesce(posEntryMode,'unknown') AS posEntryMode,
      coalesce(posConditionCode,'unknown') AS posConditionCode, coalesce(transactionType,'unknown') AS transactionType,
      coalesce(merchantState,'unknown') AS merchantState, coalesce(creditLimit, 0) AS creditLimit,
      CAST(0 AS DOUBLE) AS txn_count_24h FROM txn""",
)
def feat_normalize_types(spark, sf_dir):
    from ledgerlens.schema import CATEGORICAL_FEATURES

    return feat.normalize_types(coerced(spark, sf_dir)).select(
        "row_key", *CATEGORICAL_FEATURES, "creditLimit", "txn_count_24h"
    )


@register(
    "risk_band",
    """SELECT row_key, CAST(CASE WHEN p >= 0.82 THEN 1 ELSE 0 END AS INTEGER) AS prediction,
      CASE WHEN p >= 0.82 THEN 'critical' WHEN p >= 0.5 THEN 'elevated' ELSE 'normal' END AS risk_band,
      CASE WHEN p >= 0.3 THEN 'critical' ELSE 'normal' END AS low_threshold_band FROM valid""",
)
def risk_band(spark, sf_dir):
    p = F.col("fraud_probability")
    return scored(spark, sf_dir).select(
        "row_key",
        (p >= 0.82).cast("int").alias("prediction"),
        s.risk_band(p, 0.82).alias("risk_band"),
        s.risk_band(p, 0.3).alias("low_threshold_band"),
    )


@register(
    "heuristic_reasons",
    """WITH f AS (SELECT row_key, p, cardCVV <> enteredCVV AS c1,
        coalesce(upper(acqCountry), 'UNKNOWN') <> coalesce(upper(merchantCountryCode), 'UNKNOWN') AS c2,
        row_key % 3 = 0 AS c3, row_key % 5 >= 3 AS c4,
        coalesce(transactionAmount / nullif(creditLimit, 0), 0) >= 0.25 AS c5 FROM valid),
      r AS (SELECT row_key, p, list_filter([CASE WHEN c1 THEN 'CVV mismatch' END, CASE WHEN c2 THEN 'Cross-border transaction' END,
        CASE WHEN c3 THEN 'New merchant for account' END, CASE WHEN c4 THEN 'High 24h transaction velocity' END,
        CASE WHEN c5 THEN 'Large transaction relative to credit limit' END], lambda x: x IS NOT NULL) AS l FROM f)
    SELECT row_key, CASE WHEN len(l) > 0 THEN array_to_string(l[1:3], '; ')
      WHEN p >= 0.5 THEN 'Model score above elevated-risk threshold' ELSE '' END AS reasons FROM r""",
)
def heuristic_reasons(spark, sf_dir):
    rows = feat.amount_ratio(feat.risk_flags(scored(spark, sf_dir))).withColumns(
        {
            "is_new_merchant": (F.col("row_key") % 3 == 0).cast("int"),
            "txn_count_24h": F.col("row_key") % 5,
        }
    )
    return rows.select(
        "row_key", F.array_join(s.heuristic_reasons(F.col("fraud_probability")), "; ").alias("reasons")
    )


@register(
    "tag_version",
    "SELECT row_key, 'v1' AS model_version, CAST(0 AS INTEGER) AS isFraud FROM valid",
)
def tag_version(spark, sf_dir):
    df = valid(spark, sf_dir).drop("isFraud")
    return profile.tag_version(df, "v1").select("row_key", "model_version", "isFraud")


@register(
    "status_labels",
    """SELECT row_key,
      CASE WHEN cardCVV IS NULL OR enteredCVV IS NULL THEN 'Missing' WHEN cardCVV <> enteredCVV THEN 'Mismatch' ELSE 'Match' END AS cvv_status,
      CASE WHEN expirationDateKeyInMatch THEN 'Match' WHEN NOT expirationDateKeyInMatch THEN 'Mismatch' ELSE 'Unknown' END AS expiry_key_status,
      CASE WHEN acqCountry IS NULL OR merchantCountryCode IS NULL THEN 'Unknown' WHEN acqCountry <> merchantCountryCode THEN 'Cross-Border' ELSE 'Domestic' END AS cross_border_status
    FROM txn""",
)
def status_labels(spark, sf_dir):
    c = F.col
    return coerced(spark, sf_dir).select(
        "row_key",
        s.cvv_status(c("cardCVV"), c("enteredCVV")).alias("cvv_status"),
        s.expiry_key_status(c("expirationDateKeyInMatch")).alias("expiry_key_status"),
        s.cross_border_status(c("acqCountry"), c("merchantCountryCode")).alias("cross_border_status"),
    )


AGE_BUCKET_SQL = """CASE WHEN {0} <= -1 THEN NULL WHEN {0} <= 30 THEN '0-30 days' WHEN {0} <= 90 THEN '31-90 days'
  WHEN {0} <= 180 THEN '91-180 days' WHEN {0} <= 365 THEN '181-365 days' WHEN {0} <= 730 THEN '1-2 years'
  WHEN {0} <= 1095 THEN '2-3 years' WHEN {0} IS NOT NULL THEN '3+ years' END"""
EXPIRY_BUCKET_SQL = """CASE WHEN {0} <= -1 THEN NULL WHEN {0} <= 0 THEN 'Expired' WHEN {0} <= 3 THEN '0-3 months'
  WHEN {0} <= 6 THEN '3-6 months' WHEN {0} <= 12 THEN '6-12 months' WHEN {0} IS NOT NULL THEN '12+ months' END"""


@register(
    "account_age_bucket",
    f"""WITH a AS (SELECT row_key, {AGE_SQL} AS age_days FROM valid)
    SELECT row_key, age_days, {AGE_BUCKET_SQL.format('age_days')} AS bucket FROM a""",
)
def account_age_bucket(spark, sf_dir):
    age = s.whole_days(F.col("event_ts"), s.to_time(F.col("accountOpenDate")))
    return valid(spark, sf_dir).select("row_key", age.alias("age_days")).withColumn(
        "bucket", s.account_age_bucket(F.col("age_days"))
    )


@register(
    "expiry_bucket",
    f"""WITH a AS (SELECT row_key, {MONTHS_SQL} AS months FROM valid)
    SELECT row_key, months, {EXPIRY_BUCKET_SQL.format('months')} AS bucket FROM a""",
)
def expiry_bucket(spark, sf_dir):
    months = s.months_left(s.to_time(F.col("currentExpDate")), F.col("event_ts"))
    return valid(spark, sf_dir).select("row_key", months.alias("months")).withColumn(
        "bucket", s.expiry_bucket(F.col("months"))
    )


@register(
    "seasonality",
    """SELECT row_key, CAST(hour(ets) AS INTEGER) AS "hour", CAST(isodow(ets) - 1 AS INTEGER) AS day_of_week,
      CAST(day(ets) AS INTEGER) AS day_of_month, CAST(month(ets) AS INTEGER) AS "month",
      CAST(isodow(ets) >= 6 AS INTEGER) AS is_weekend, CAST(day(ets) >= 25 AS INTEGER) AS is_end_of_month,
      CAST(hour(ets) <= 6 AS INTEGER) AS is_late_night FROM valid""",
)
def seasonality(spark, sf_dir):
    return feat.seasonality(valid(spark, sf_dir)).select(
        "row_key", "hour", "day_of_week", "day_of_month", "month", "is_weekend", "is_end_of_month", "is_late_night"
    )


@register(
    "location_key",
    "SELECT row_key, coalesce(acqCountry, 'Unknown') || '_' || coalesce(merchantCity, 'Unknown') AS location FROM txn",
)
def location_key(spark, sf_dir):
    return coerced(spark, sf_dir).select(
        "row_key", s.location_key(F.col("acqCountry"), F.col("merchantCity")).alias("location")
    )


@register(
    "utilization_nb",
    "SELECT row_key, round(coalesce(availableMoney / nullif(creditLimit, 0), 0), 6) AS utilization FROM txn",
)
def utilization_nb(spark, sf_dir):
    return coerced(spark, sf_dir).select(
        "row_key", F.round(s.ratio(F.col("availableMoney"), F.col("creditLimit")), 6).alias("utilization")
    )


@register(
    "pos_tier_nb",
    """SELECT row_key, CASE WHEN posEntryMode IN ('01','02') AND posConditionCode IN ('00','01') THEN 'Low Risk'
      WHEN posEntryMode IN ('05','06') AND posConditionCode IN ('02','03') THEN 'Medium Risk' ELSE 'High Risk' END AS tier FROM txn""",
)
def pos_tier_nb(spark, sf_dir):
    return coerced(spark, sf_dir).select(
        "row_key", s.pos_tier_label(F.col("posEntryMode"), F.col("posConditionCode")).alias("tier")
    )


@register(
    "address_change_days",
    f"""WITH a AS (SELECT row_key, {DAYS.format('us', US.format('dateOfLastAddressChange'))} AS d FROM valid)
    SELECT row_key, CAST(coalesce(d, (SELECT quantile_cont(d, 0.5) FROM a)) AS DOUBLE) AS days_since_address_change FROM a""",
)
def address_change_days(spark, sf_dir):
    return profile.address_change_days(valid(spark, sf_dir)).select("row_key", "days_since_address_change")


@register(
    "expiry_flags",
    f"""WITH a AS (SELECT row_key, {MONTHS_SQL} AS months FROM valid)
    SELECT row_key, CAST(months < 0 AS INTEGER) AS is_expired, CAST(months BETWEEN 0 AND 3 AS INTEGER) AS expiring_soon FROM a""",
)
def expiry_flags(spark, sf_dir):
    return feat.expiry_flags(feat.account_age(valid(spark, sf_dir))).select(
        "row_key", "is_expired", "expiring_soon"
    )


@register(
    "log_amount",
    "SELECT row_key, round(ln(transactionAmount), 6) AS log_amount FROM txn WHERE transactionAmount > 0",
)
def log_amount(spark, sf_dir):
    return coerced(spark, sf_dir).where("transactionAmount > 0").select(
        "row_key", F.round(F.log("transactionAmount"), 6).alias("log_amount")
    )


@register(
    "fill_nulls",
    """SELECT row_key, coalesce(accountNumber,'missing') AS accountNumber, coalesce(merchantState,'missing') AS merchantState,
      coalesce(cardCVV,'missing') AS cardCVV, coalesce(TRY_CAST(posEntryMode AS DOUBLE), 0) AS entry FROM txn""",
)
def fill_nulls(spark, sf_dir):
    df = coerced(spark, sf_dir).select(
        "row_key", "accountNumber", "merchantState", "cardCVV", s.to_number(F.col("posEntryMode")).alias("entry")
    )
    return feat.fill_nulls(df)
