"""Segment analytics: grouped fraud statistics, pivots, histograms, mutual information."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.features import with_event_time
from ledgerlens.functions.scalars import label, location_key, to_time, whole_days
from ledgerlens.operators.scan import (
    TooManyGroups,
    chunk_count,
    order_statistics,
    quantile_edges,
    sampled_edges,
    segmented_scan,
    with_chunk,
)


def at_or_above(df: DataFrame, threshold: float, column: str = "fraud_probability") -> DataFrame:
    return df.where(F.col(column) >= threshold)


def tag_version(df: DataFrame, version: str, label_column: str = "isFraud") -> DataFrame:
    if label_column not in df.columns:
        df = df.withColumn(label_column, F.lit(0))
    return df.withColumn("model_version", F.lit(version))


def address_change_days(df: DataFrame) -> DataFrame:
    """Whole days since the address change; missing takes the exact median of the column."""
    df = with_event_time(df)
    days = df.withColumn(
        "_days", whole_days(F.col("event_ts"), to_time(F.col("dateOfLastAddressChange")))
    )
    median = days.select(F.percentile("_days", F.lit(0.5))).scalar()
    return days.withColumn(
        "days_since_address_change", F.coalesce(F.col("_days").cast("double"), median)
    ).drop("_days")


def _fraud(column: str = "isFraud") -> Column:
    return label(F.col(column)).cast("bigint")


def _fraud_amount() -> Column:
    return F.coalesce(F.sum(F.when(_fraud() == 1, F.col("transactionAmount"))), F.lit(0.0))


def entity_risk(df: DataFrame, key: Column | str, name: str = "segment") -> DataFrame:
    """Fraud profile per segment: counts, rate, and shares of all fraud and of the segment's amount.

    Null segments are left out of the groups but count in the totals.
    """
    key = F.col(key) if isinstance(key, str) else key
    totals = df.agg(
        F.struct(F.sum(_fraud()).alias("frauds"), _fraud_amount().alias("amount"))
    ).scalar()
    all_frauds, all_amount = totals.getField("frauds"), totals.getField("amount")
    grouped = (
        df.withColumn("_segment", key)
        .groupBy(F.col("_segment").alias(name))
        .agg(
            F.count("accountNumber").alias("total_transactions"),
            F.sum(_fraud()).alias("fraud_transactions"),
            F.avg(_fraud()).alias("fraud_prob"),
            _fraud_amount().alias("_fraud_amount"),
            F.sum("transactionAmount").alias("_amount"),
            F.count("_segment").alias("_present"),
        )
        # A count cannot be pushed below the grouping, where it would repeat the key expression.
        .where("_present > 0")
    )

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    return grouped.select(
        name,
        "total_transactions",
        "fraud_transactions",
        "fraud_prob",
        share(F.col("fraud_transactions"), all_frauds).alias("fraud_prob_cond"),
        share(F.col("_fraud_amount"), all_amount).alias("fraud_amount_prop_cond"),
        share(F.col("_fraud_amount"), F.col("_amount")).alias("fraud_amount_prop"),
    )


def top_entities(profile: DataFrame, by: str, n: int = 20, name: str = "segment") -> DataFrame:
    """The ``n`` largest segments by one measure; ties by name."""
    return profile.orderBy(F.col(by).desc(), F.col(name)).limit(n)


TIME_PARTS = {"hour": F.hour, "dayofweek": F.weekday, "month": F.month, "year": F.year}


def pivot_time_label(df: DataFrame, part: str) -> DataFrame:
    """Count and mean amount per time part, one column pair per label."""
    df = with_event_time(df).withColumns(
        {"time_value": TIME_PARTS[part](F.col("event_ts")), "_y": _fraud()}
    )
    return (
        df.groupBy("time_value")
        .pivot("_y", [0, 1])
        .agg(F.count("accountNumber").alias("count"), F.avg("transactionAmount").alias("mean_amount"))
        .withColumnsRenamed(
            {
                "0_count": "legit_count",
                "1_count": "fraud_count",
                "0_mean_amount": "legit_mean_amount",
                "1_mean_amount": "fraud_mean_amount",
            }
        )
    )


def pivot_card_present(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("label", _fraud())
        .groupBy("label")
        .pivot("cardPresent", [False, True])
        .agg(F.count("accountNumber"))
        .withColumnsRenamed({"false": "card_absent", "true": "card_present"})
    )


def daily_stats(df: DataFrame) -> DataFrame:
    df = with_event_time(df)
    return df.groupBy(F.to_date("event_ts").alias("transactionDate")).agg(
        F.sum(_fraud()).alias("fraud_count"),
        F.sum("transactionAmount").alias("total_amount"),
        F.avg("transactionAmount").alias("mean_amount"),
    )


def label_stats(df: DataFrame) -> DataFrame:
    return df.groupBy(_fraud().alias("label")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("transactionAmount").alias("amount_sum"),
        F.avg("transactionAmount").alias("amount_mean"),
    )


def utilization_by_label(df: DataFrame) -> DataFrame:
    """Per label: counts, mean available/limit, and that mean over fraud rows only."""
    used = F.col("availableMoney") / F.nullif(F.col("creditLimit"), F.lit(0.0))
    return df.withColumn("_u", used).groupBy(_fraud().alias("label")).agg(
        F.count("accountNumber").alias("total_transactions"),
        F.sum(_fraud()).alias("fraud_transactions"),
        F.avg(_fraud()).alias("fraud_prob"),
        F.avg("_u").alias("avg_utilization"),
        F.coalesce(F.avg(F.when(_fraud() == 1, F.col("_u"))), F.lit(0.0)).alias(
            "avg_utilization_fraud_only"
        ),
    )


def distinct_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct accounts and customers, rows, and the time range.

    The exact form first reduces to distinct values, so no single task holds all of them.
    """
    df = with_event_time(df)
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(
        count("accountNumber").alias("accounts"),
        count("customerId").alias("customers"),
        F.count(F.lit(1)).alias("rows"),
        F.min("event_ts").alias("first_ts"),
        F.max("event_ts").alias("last_ts"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def mapped_back(df: DataFrame, key: str, stats: DataFrame) -> DataFrame:
    """Left join of per-key statistics; a null key takes nothing.

    No hint: the statistics side is small when keys are few, and AQE broadcasts or splits by size.
    """
    return df.join(stats, key, "left")


def location_stats(df: DataFrame) -> DataFrame:
    """Row count and fraud rate per (country, city)."""
    key = location_key(F.col("acqCountry"), F.col("merchantCity"))
    return df.groupBy(key.alias("location")).agg(
        F.count(F.lit(1)).alias("location_txn_count"), F.avg(_fraud()).alias("location_fraud_rate")
    )


def location_features(df: DataFrame) -> DataFrame:
    """Row count and fraud rate of the (country, city) of each row."""
    keyed = df.withColumn("location", location_key(F.col("acqCountry"), F.col("merchantCity")))
    return mapped_back(keyed, "location", location_stats(df))


def target_encode(df: DataFrame, entity: str, target: str = "isFraud") -> DataFrame:
    """Whole-table mean label per entity (an analysis column: it sees every label)."""
    stats = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(
        F.avg(_fraud(target)).alias(f"{entity}_target_enc")
    )
    return mapped_back(df, entity, stats)


def target_encode_join(df: DataFrame, fitted_on: DataFrame, entity: str, target: str = "isFraud") -> DataFrame:
    """Mean label per entity learned on ``fitted_on``; values unseen there stay null."""
    stats = fitted_on.where(F.col(entity).isNotNull()).groupBy(entity).agg(
        F.avg(_fraud(target)).alias(f"{entity}_target_enc")
    )
    return mapped_back(df, entity, stats)


def label_encode(df: DataFrame, fitted_on: DataFrame, column: str) -> DataFrame:
    """Codes 0…k−1 in sorted order of the fitted values; unseen values get −1."""
    return df.join(label_codes(fitted_on, column), column, "left").withColumn(
        f"{column}_code", F.coalesce(F.col(f"{column}_code"), F.lit(-1).cast("bigint"))
    )


def label_codes(fitted_on: DataFrame, column: str) -> DataFrame:
    """``(column, column_code)``: each distinct value's 0-based position in sorted order.

    Counted per range chunk of the distinct values, so many values are not ranked in one task.
    """
    values = fitted_on.where(F.col(column).isNotNull()).select(column).distinct()
    ranked = segmented_scan(
        values.withColumn("_one", F.lit(1).cast("bigint")),
        [],
        column,
        {"_rank": "_one"},
        edges=sampled_edges(values, column, chunk_count(values)),
    )
    return ranked.select(column, (F.col("_rank") - 1).alias(f"{column}_code"))


# Reported percentiles.
PERCENTILES = [0.01, 0.05, 0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.75, 0.9, 0.95, 0.99]


# Groups up to this number are described from selected ranks.
MAX_REPORT_GROUPS = 20


def describe(df: DataFrame, value: str, by: Column | None = None, approximate: bool = False) -> DataFrame:
    """Count, mean, deviation, range and 12 percentiles per group.

    Percentiles are exact, between the two rows next to each place. For up to ``MAX_REPORT_GROUPS`` groups these rows
    are selected, all at once, and no task holds a group's values. Beyond, percentiles keep a value→count map per
    group, each a small share of the table; ``approximate`` bounds that memory.
    """
    by = by if by is not None else _fraud()
    if not approximate:
        try:
            return _described(df, value, by)
        except TooManyGroups:
            pass
    wanted = F.array(*[F.lit(p) for p in PERCENTILES])
    quantiles = (
        F.percentile_approx(value, wanted, F.lit(10_000))
        if approximate
        else F.percentile(value, wanted)
    )
    grouped = df.groupBy(by.alias("label")).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        quantiles.alias("_q"),
        F.max(value).alias("max"),
    )
    named = {_percent(p): F.col("_q")[i] for i, p in enumerate(PERCENTILES)}
    return grouped.withColumns(named).drop("_q")


def _percent(p: float) -> str:
    return f"p{round(p * 100):02d}"


def _described(df: DataFrame, value: str, by: Column) -> DataFrame:
    def places(_, n: int) -> list[int]:
        return [r for p in PERCENTILES for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))]

    stats = [F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std")]
    groups, at = order_statistics(df, value, places, by=by, stats=stats, max_groups=MAX_REPORT_GROUPS)
    rows = []
    for g, row in groups.items():
        n, quantiles = row["n"], []
        for p in PERCENTILES if n else ():
            place = (n - 1) * p
            low, high = (float(at[g, r].value) for r in (math.floor(place), math.ceil(place)))
            quantiles.append(low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high)
        rows.append((g, n, row["mean"], row["std"], row["_low"], row["_high"], *(quantiles or [None] * len(PERCENTILES))))
    kinds = df.select(by.alias("label"), F.col(value).alias("v")).schema
    numbers = ["mean", "std", *map(_percent, PERCENTILES)]
    schema = T.StructType(
        [
            T.StructField("label", kinds["label"].dataType),
            T.StructField("count", T.LongType()),
            *[T.StructField(c, T.DoubleType()) for c in numbers[:2]],
            *[T.StructField(c, kinds["v"].dataType) for c in ("min", "max")],
            *[T.StructField(c, T.DoubleType()) for c in numbers[2:]],
        ]
    )
    return df.sparkSession.createDataFrame(rows, schema)


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal-width density histogram per label, over that label's own range (last bin closed)."""
    df = df.withColumns({"label": _fraud(), "_v": F.col(value)}).where(F.col("_v").isNotNull())
    ranges = df.groupBy("label").agg(
        F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("_v").alias("_total")
    )
    # Two labels: the range table has at most two rows.
    placed = df.join(F.broadcast(ranges), "label").withColumns(
        {
            "_width": (F.col("_high") - F.col("_low")) / F.lit(bins),
        }
    )
    index = F.when(F.col("_width") == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_v") - F.col("_low")) / F.nullif(F.col("_width"), F.lit(0.0))), F.lit(bins - 1))
    )
    counted = placed.groupBy("label", index.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count"),
        F.first("_low").alias("_low"),
        F.first("_width").alias("_width"),
        F.first("_total").alias("_total"),
    )
    return counted.select(
        "label",
        "bin",
        (F.col("_low") + F.col("bin") * F.col("_width")).alias("bin_start"),
        "count",
        (F.col("count") / (F.col("_total") * F.nullif(F.col("_width"), F.lit(0.0)))).alias("density"),
    )


def mutual_information(
    df: DataFrame, discrete: Sequence[str], continuous: Sequence[str] = (), bins: int = 10
) -> DataFrame:
    """Plug-in mutual information (nats) of each feature with the label.

    Continuous features are cut at their deciles first. One unpivot and one contingency count serve
    all features; a feature's cells are combined with sums only, so no task holds a whole feature.
    """
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias(c) for c in discrete]
    binned = df
    for c in continuous:
        binned = with_chunk(binned, c, quantile_edges(df, c, bins), f"_bin_{c}")
    columns += [F.col(f"_bin_{c}").cast("string").alias(c) for c in continuous]
    names = [*discrete, *continuous]
    long = binned.select(_fraud().alias("_y"), *columns).unpivot(["_y"], names, "feature", "value")
    cells = long.groupBy("feature", "value").agg(
        F.sum("_y").alias("_pos"), F.count(F.lit(1)).alias("_all")
    )
    base = df.agg(
        F.struct(F.sum(_fraud()).alias("pos"), F.count(F.lit(1)).alias("all"))
    ).scalar()
    total = base.getField("all").cast("double")
    positive = base.getField("pos").cast("double")

    def term(joint: Column, side: Column) -> Column:
        joint, value = joint.cast("double"), F.col("_all").cast("double")
        return F.when(joint > 0, joint / total * F.log(joint * total / (value * side))).otherwise(F.lit(0.0))

    return (
        cells.groupBy("feature")
        .agg(
            F.sum(
                term(F.col("_pos"), positive) + term(F.col("_all") - F.col("_pos"), total - positive)
            ).alias("mutual_info")
        )
        .withColumn("mutual_info", F.greatest(F.col("mutual_info"), F.lit(0.0)))
    )


def monitor_summary(df: DataFrame) -> DataFrame:
    """Rows and mean probability per (state, band), null states kept."""
    return df.groupBy("merchantState", "risk_band").agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.avg("fraud_probability").alias("avg_fraud_probability"),
    )
