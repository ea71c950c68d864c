"""Row-local expressions. Everything here is a native Column and stays in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000

# Accepted boolean spellings.
TRUE_TOKENS = ["true", "1", "yes", "y"]
FALSE_TOKENS = ["false", "0", "no", "n"]


def to_time(column: Column) -> Column:
    """Text to timestamp, null when no form fits: ISO forms, then ``M/d/yyyy``, then ``MM/yyyy``."""
    text = F.trim(column.cast("string"))
    return F.coalesce(
        F.try_to_timestamp(text),
        F.try_to_timestamp(text, F.lit("M/d/yyyy")),
        F.try_to_timestamp(text, F.lit("MM/yyyy")),
    )


def to_number(column: Column) -> Column:
    """Text or number to double, null when it does not parse (NaN counts as missing)."""
    value = column.try_cast("double")
    return F.when(~F.isnan(value), value)


def parse_bool(column: Column) -> Column:
    token = F.lower(F.trim(column.cast("string")))
    return F.when(token.isin(TRUE_TOKENS), True).when(token.isin(FALSE_TOKENS), False)


def flag(column: Column) -> Column:
    """Boolean to 0/1, null to 0."""
    return F.coalesce(column.cast("int"), F.lit(0))


def label(column: Column) -> Column:
    """Training label: null is legitimate."""
    return flag(column.cast("boolean"))


def micros(column: Column) -> Column:
    return F.unix_micros(column)


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed 24-hour days, floored (no calendar rule: 23:59 to 00:01 is 0 days)."""
    return floor_div(micros(later) - micros(earlier), DAY_MICROS)


def floor_div(value: Column, unit: int) -> Column:
    unit_col = F.lit(unit).cast("bigint")
    return ((value - F.pmod(value, unit_col)) / unit_col).cast("bigint")


def months_left(expiry: Column, at: Column) -> Column:
    return floor_div(whole_days(expiry, at), 30)


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` with a zero or missing operand giving 0."""
    return F.coalesce(top / F.nullif(bottom, F.lit(0.0)), F.lit(0.0))


# -- status labels -----------------------------------------------------------


def cvv_status(card: Column, entered: Column) -> Column:
    return (
        F.when(card.isNull() | entered.isNull(), "Missing").when(card != entered, "Mismatch").otherwise("Match")
    )


def expiry_key_status(matched: Column) -> Column:
    return F.when(matched, "Match").when(~matched, "Mismatch").otherwise("Unknown")


def cross_border_status(acquirer: Column, merchant: Column) -> Column:
    """Case-sensitive comparison; either side missing is ``Unknown``."""
    return (
        F.when(acquirer.isNull() | merchant.isNull(), "Unknown")
        .when(acquirer != merchant, "Cross-Border")
        .otherwise("Domestic")
    )


# Right-closed bin edges and their labels. The first edge is exclusive.
ACCOUNT_AGE_BINS = [
    (30, "0-30 days"),
    (90, "31-90 days"),
    (180, "91-180 days"),
    (365, "181-365 days"),
    (730, "1-2 years"),
    (1095, "2-3 years"),
    (None, "3+ years"),
]
EXPIRY_BINS = [
    (0, "Expired"),
    (3, "0-3 months"),
    (6, "3-6 months"),
    (12, "6-12 months"),
    (None, "12+ months"),
]


def right_closed_bins(value: Column, bins: list[tuple[int | None, str]], above: int = -1) -> Column:
    """First bin whose upper edge is not below the value; at or below ``above`` gives null."""
    chain = F.when(value <= above, F.lit(None).cast("string"))
    for edge, name in bins:
        chain = chain.when(value.isNotNull() if edge is None else value <= edge, name)
    return chain


def account_age_bucket(age_days: Column) -> Column:
    return right_closed_bins(age_days, ACCOUNT_AGE_BINS)


def expiry_bucket(months: Column) -> Column:
    return right_closed_bins(months, EXPIRY_BINS)


def location_key(country: Column, city: Column) -> Column:
    return F.concat(
        F.coalesce(country, F.lit("Unknown")), F.lit("_"), F.coalesce(city, F.lit("Unknown"))
    )


def pos_tier_label(entry: Column, condition: Column) -> Column:
    """Text codes: chip with attended terminal is low, contact with remote is medium, else high."""
    return (
        F.when(entry.isin("01", "02") & condition.isin("00", "01"), "Low Risk")
        .when(entry.isin("05", "06") & condition.isin("02", "03"), "Medium Risk")
        .otherwise("High Risk")
    )


# -- scores ------------------------------------------------------------------


def risk_band(probability: Column, threshold: float) -> Column:
    """The alert threshold wins over the elevated limit, even when it is the lower one."""
    return (
        F.when(probability >= threshold, "critical").when(probability >= 0.5, "elevated").otherwise("normal")
    )


def heuristic_reasons(probability: Column, limit: int = 3) -> Column:
    """Ordered rule reasons of a feature row; a generic one when none fires on a high score."""
    # Rule texts and limits.
    rules = F.array_compact(
        F.array(
            F.when(F.col("cvv_mismatch") >= 1, "CVV mismatch"),
            F.when(F.col("cross_border") >= 1, "Cross-border transaction"),
            F.when(F.col("is_new_merchant") >= 1, "New merchant for account"),
            F.when(F.col("txn_count_24h") >= 3, "High 24h transaction velocity"),
            F.when(
                F.col("amount_to_limit_ratio") >= 0.25, "Large transaction relative to credit limit"
            ),
        )
    )
    generic = F.array_compact(
        F.array(F.when(probability >= 0.5, "Model score above elevated-risk threshold"))
    )
    return F.slice(F.when(F.size(rules) > 0, rules).otherwise(generic), 1, limit)
