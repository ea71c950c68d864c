"""The fixed transaction schema and the coercion that every input goes through."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.scalars import parse_bool, to_number

# Schema tag and the 29 input columns, in their fixed order.
SCHEMA_VERSION = "capital-one-transactions-v1"
TRANSACTION_FIELDS: dict[str, str] = {
    "accountNumber": "string",
    "customerId": "string",
    "creditLimit": "double",
    "availableMoney": "double",
    "transactionDateTime": "string",
    "transactionAmount": "double",
    "merchantName": "string",
    "acqCountry": "string",
    "merchantCountryCode": "string",
    "posEntryMode": "string",
    "posConditionCode": "string",
    "merchantCategoryCode": "string",
    "currentExpDate": "string",
    "accountOpenDate": "string",
    "dateOfLastAddressChange": "string",
    "cardCVV": "string",
    "enteredCVV": "string",
    "cardLast4Digits": "string",
    "transactionType": "string",
    "echoBuffer": "string",
    "currentBalance": "double",
    "merchantCity": "string",
    "merchantState": "string",
    "merchantZip": "string",
    "cardPresent": "boolean",
    "posOnPremises": "string",
    "recurringAuthInd": "string",
    "expirationDateKeyInMatch": "boolean",
    "isFraud": "boolean",
}

# The 40 model inputs.
CATEGORICAL_FEATURES = [
    "merchantName",
    "merchantCategoryCode",
    "acqCountry",
    "merchantCountryCode",
    "posEntryMode",
    "posConditionCode",
    "transactionType",
    "merchantState",
]
ENCODED_ENTITIES = ["merchantName", "merchantCategoryCode", "transactionType", "posEntryMode"]
NUMERIC_FEATURES = [
    "transactionAmount",
    "creditLimit",
    "availableMoney",
    "currentBalance",
    "txn_hour",
    "txn_day_of_week",
    "txn_month",
    "is_weekend",
    "is_night_txn",
    "account_age_days",
    "days_since_address_change",
    "months_to_expiry",
    "utilization",
    "amount_to_limit_ratio",
    "cvv_mismatch",
    "expiry_key_mismatch",
    "card_present_flag",
    "cross_border",
    "pos_risk_tier",
    "txn_count_24h",
    "txn_count_48h",
    "txn_count_7d",
    "txn_count_30d",
    "txn_amount_sum_24h",
    "txn_amount_sum_7d",
    "txn_amount_mean_7d",
    "seconds_since_last_txn",
    "is_new_merchant",
] + [f"{entity}_fraud_rate" for entity in ENCODED_ENTITIES]
FEATURE_COLUMNS = CATEGORICAL_FEATURES + NUMERIC_FEATURES


def transaction_schema() -> T.StructType:
    """The typed schema after coercion."""
    return T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in TRANSACTION_FIELDS.items()))


def raw_schema(extra: Iterable[str] = ()) -> T.StructType:
    """Every field as text: what file and topic readers parse before coercion."""
    names = [*TRANSACTION_FIELDS, *extra]
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def coerce(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Cast to the fixed schema: absent columns become null, unknown ones go, order is fixed.

    ``keep`` names extra columns (such as a row key) to carry along unchanged.
    """
    present = dict(df.dtypes)
    out = [F.col(name) for name in keep]
    for name, kind in TRANSACTION_FIELDS.items():
        if name not in present:
            column = F.lit(None).cast(kind)
        elif kind == "double":
            column = to_number(F.col(name))
        elif kind == "boolean" and present[name] != "boolean":
            column = parse_bool(F.col(name))
        else:
            column = F.col(name).cast(kind)
        out.append(column.alias(name))
    return df.select(*out)


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Index-like columns (blank name or ``Unnamed…``) become ``row_id``, ``row_id_2``, …"""
    names, seen = [], sum(name == "row_id" for name in df.columns)
    for name in df.columns:
        if name == "" or name.startswith("Unnamed"):
            seen += 1
            name = "row_id" if seen == 1 else f"row_id_{seen}"
        names.append(name)
    return df.toDF(*names)
