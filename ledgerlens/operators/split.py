"""Time-ordered splits and deterministic samples.

A split is a comparison with a cut key found by :func:`ledgerlens.operators.scan.nth_keys`; no row
is numbered and nothing is shuffled to split a table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.features import with_event_time
from ledgerlens.functions.scalars import micros
from ledgerlens.operators.history import row_order
from ledgerlens.operators.scan import nth_keys

LAST = 2**63 - 1


def _keyed(df: DataFrame, order_col: str | None) -> DataFrame:
    """Sort key: time (unreadable last), then row order."""
    df = with_event_time(df)
    return df.withColumns(
        {"_us": F.coalesce(micros(F.col("event_ts")), F.lit(LAST)), "_ord": row_order(df, order_col)}
    )


def _from(cut: tuple[int, int]) -> Column:
    """Rows at or after a cut key."""
    us, order = cut
    return (F.col("_us") > us) | ((F.col("_us") == us) & (F.col("_ord") >= order))


def ratio_cut(rows: DataFrame, total: int, ratio: float) -> tuple[int, int] | None:
    """Key of the first row after the leading ``ratio``; both sides keep a row when there are two."""
    position = max(1, min(total - 1, int(total * ratio)))
    if position >= total:
        return None
    return nth_keys(rows, "_us", "_ord", [position])[0]


def chrono_flag(
    df: DataFrame,
    test_days: int = 60,
    train_ratio: float = 0.8,
    order_col: str | None = "row_key",
) -> DataFrame:
    """Add ``is_test``: 1 in the last ``test_days``; by ratio when that would leave a side empty.

    A plain filter and projection over the input. Rows with an unreadable time belong to neither
    side of a dated split and come last in a split by ratio.
    """
    rows = _keyed(df, order_col)
    known = F.col("_us") < LAST
    low, high, total = rows.agg(
        F.min(F.when(known, F.col("_us"))), F.max(F.when(known, F.col("_us"))), F.count(F.lit(1))
    ).first()
    cutoff = None if high is None else high - test_days * 86_400_000_000
    if cutoff is not None and low < cutoff:
        rows, late = rows.where(known), F.col("_us") >= cutoff
    else:
        cut = ratio_cut(rows, total, train_ratio) if total else None
        late = F.lit(False) if cut is None else _from(cut)
    return rows.withColumn("is_test", late.cast("int")).drop("_us", "_ord")


def chrono_split(df: DataFrame, *args, **options) -> tuple[DataFrame, DataFrame]:
    """(train, test) by :func:`chrono_flag`."""
    flagged = chrono_flag(df, *args, **options)
    train, test = (flagged.where(F.col("is_test") == side).drop("is_test") for side in (0, 1))
    return train, test


def time_series_folds(df: DataFrame, k: int, order_col: str | None = "row_key") -> DataFrame:
    """Add ``fold``: 0 for rows that only train, i for validation fold i of k expanding folds.

    Fold i trains on ``fold < i`` and validates on ``fold = i``.
    """
    rows = _keyed(df, order_col)
    total = rows.count()
    size = total // (k + 1)
    if size == 0:
        raise ValueError(f"cannot cut {total} rows into {k} expanding folds")
    starts = [total - size * (k - i) for i in range(k)]
    cuts = nth_keys(rows, "_us", "_ord", starts)
    fold = sum((_from(cut).cast("int") for cut in cuts), F.lit(0))
    return rows.withColumn("fold", fold).drop("_us", "_ord")


def fold_parts(folded: DataFrame, i: int) -> tuple[DataFrame, DataFrame]:
    return folded.where(F.col("fold") < i), folded.where(F.col("fold") == i)


def calibration_split(
    train: DataFrame, share: float = 0.2, order_col: str | None = "row_key"
) -> tuple[DataFrame, DataFrame]:
    """(fit part, calibration part): the last ``share`` of the training rows by time."""
    rows = _keyed(train, order_col)
    total = rows.count()
    cut = nth_keys(rows, "_us", "_ord", [min(total - 1, int(total * (1 - share)))])[0]
    return rows.where(~_from(cut)).drop("_us", "_ord"), rows.where(_from(cut)).drop("_us", "_ord")


def head_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement: those with the smallest seeded hash of a unique key.

    Rows far above the expected hash limit are dropped first, so the final top-n sees little more
    than ``n`` rows however large the table is.
    """
    total = df.count()
    if total <= n:
        return df
    hashed = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    share = (n + 6 * math.sqrt(n) + 10) / total
    while share < 1:
        near = hashed.where(F.col("_h") < F.lit(int(-(2**63) + share * 2**64)))
        if near.limit(n).count() == n:
            hashed = near
            break
        share *= 2
    return hashed.orderBy("_h", key).limit(n).drop("_h")


def background_sample(
    train: DataFrame,
    features: list[str],
    n: int = 200,
    seed: int = 42,
    key: str = "row_key",
) -> DataFrame:
    """At most ``n`` seeded training rows with the feature columns, for explanations."""
    available = [c for c in features if c in train.columns]
    return hash_sample(train, n, key, seed).select(key, *available)


def legit_subsample(df: DataFrame, n: int = 30_000, seed: int = 42, key: str = "row_key") -> DataFrame:
    """At most ``n`` legitimate rows without replacement."""
    return hash_sample(df.where(F.coalesce(F.col("isFraud").cast("int"), F.lit(0)) == 0), n, key, seed)
