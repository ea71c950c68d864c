"""Feature steps that need only their own row: each is ``DataFrame -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import (
    flag,
    months_left,
    ratio,
    to_number,
    to_time,
    whole_days,
)
from ledgerlens.schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES

# Fixed values.
NIGHT_HOURS = [22, 23, 0, 1, 2, 3, 4]
HIGH_RISK_ENTRY = [81, 90]
HIGH_RISK_CONDITION = [8, 59, 99]


def with_event_time(df: DataFrame) -> DataFrame:
    """Parse the transaction time once; later steps read ``event_ts``."""
    if "event_ts" in df.columns:
        return df
    return df.withColumn("event_ts", to_time(F.col("transactionDateTime")))


def temporal(df: DataFrame) -> DataFrame:
    df = with_event_time(df)
    ts = F.col("event_ts")
    return df.withColumns(
        {
            "txn_hour": F.coalesce(F.hour(ts), F.lit(-1)),
            "txn_day_of_week": F.coalesce(F.weekday(ts), F.lit(-1)),
            "txn_month": F.coalesce(F.month(ts), F.lit(0)),
            "is_weekend": flag(F.weekday(ts).isin(5, 6)),
            "is_night_txn": flag(F.hour(ts).isin(NIGHT_HOURS)),
        }
    )


def account_age(df: DataFrame) -> DataFrame:
    df = with_event_time(df)
    ts = F.col("event_ts")

    def days_since(name: str):
        return F.greatest(
            F.coalesce(whole_days(ts, to_time(F.col(name))), F.lit(0)), F.lit(0)
        ).cast("bigint")

    return df.withColumns(
        {
            "account_age_days": days_since("accountOpenDate"),
            "days_since_address_change": days_since("dateOfLastAddressChange"),
            "months_to_expiry": F.coalesce(
                months_left(to_time(F.col("currentExpDate")), ts), F.lit(0).cast("bigint")
            ),
        }
    )


def amount_ratio(df: DataFrame) -> DataFrame:
    money = ["creditLimit", "availableMoney", "transactionAmount", "currentBalance"]
    df = df.withColumns(
        {name: F.coalesce(to_number(F.col(name)), F.lit(0.0)) for name in money}
    )
    limit = F.col("creditLimit")
    return df.withColumns(
        {
            "utilization": ratio(F.greatest(limit - F.col("availableMoney"), F.lit(0.0)), limit),
            "amount_to_limit_ratio": ratio(F.col("transactionAmount"), limit),
        }
    )


def risk_flags(df: DataFrame) -> DataFrame:
    """Verification flags; a missing CVV on either side is not a mismatch."""

    def country(name: str):
        return F.coalesce(F.upper(F.col(name)), F.lit("UNKNOWN"))

    entry, condition = (F.col(c).try_cast("double") for c in ("posEntryMode", "posConditionCode"))
    present = flag(F.col("cardPresent"))
    return df.withColumns(
        {
            "cvv_mismatch": flag(F.col("cardCVV") != F.col("enteredCVV")),
            "expiry_key_mismatch": F.lit(1) - flag(F.col("expirationDateKeyInMatch")),
            "card_present_flag": present,
            "cross_border": flag(country("acqCountry") != country("merchantCountryCode")),
            "pos_risk_tier": F.when(present == 0, 2)
            .when(entry.isin(HIGH_RISK_ENTRY) | condition.isin(HIGH_RISK_CONDITION), 3)
            .otherwise(1),
        }
    )


def normalize_types(df: DataFrame) -> DataFrame:
    """Model inputs without nulls: text to ``unknown``, numbers to 0.0, absent numbers added."""
    present = set(df.columns)
    cast = {
        name: F.coalesce(F.col(name).cast("string"), F.lit("unknown")) for name in CATEGORICAL_FEATURES
    }
    for name in NUMERIC_FEATURES:
        cast[name] = (
            F.coalesce(to_number(F.col(name)), F.lit(0.0)) if name in present else F.lit(0.0)
        )
    return df.withColumns(cast)


def seasonality(df: DataFrame) -> DataFrame:
    df = with_event_time(df)
    ts = F.col("event_ts")
    return df.withColumns(
        {
            "hour": F.hour(ts),
            "day_of_week": F.weekday(ts),
            "day_of_month": F.dayofmonth(ts),
            "month": F.month(ts),
            "is_weekend": flag(F.weekday(ts) >= 5),
            "is_end_of_month": flag(F.dayofmonth(ts) >= 25),
            "is_late_night": flag(F.hour(ts).between(0, 6)),
        }
    )


def expiry_flags(df: DataFrame, months: str = "months_to_expiry") -> DataFrame:
    return df.withColumns(
        {"is_expired": flag(F.col(months) < 0), "expiring_soon": flag(F.col(months).between(0, 3))}
    )


def fill_nulls(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """By type: text to ``missing``, numbers to 0 (schema-driven, one projection)."""
    text = [n for n, t in df.dtypes if t == "string" and n not in skip]
    numeric = [
        n
        for n, t in df.dtypes
        if t.startswith(("int", "bigint", "double", "float", "smallint", "tinyint", "decimal"))
        and n not in skip
    ]
    return df.fillna("missing", subset=text).fillna(0, subset=numeric)
