"""Stored rows that only feed windows bring the columns the windows read."""

from pyspark.sql import functions as F

from ledgerlens.operators.history import PIPELINE_SPECS, pipeline_history
from ledgerlens.plans.feature_pipeline import LOOKBACK_COLUMNS, FeaturePipeline
from ledgerlens.sources.store import FeatureStore


def made(txns):
    return txns(
        *[
            {"accountNumber": str(i % 3), "merchantName": f"m{i % 4}", "transactionAmount": 2.0 + i, "transactionDateTime": f"2021-0{1 + i // 10}-{10 + i % 10}T00:00:0{i % 2}"}
            for i in range(40)
        ]
    )


def test_lookback_rows_are_narrow_in_the_windows(spark, txns):
    rows = FeaturePipeline().clean(made(txns))
    past, current = rows.where("row_key < 30"), rows.where("row_key >= 30")
    out = pipeline_history(current, lookback=past)
    whole = pipeline_history(rows).where("row_key >= 30")
    columns = ["row_key", "cardCVV", *[s.name for s in PIPELINE_SPECS], "is_new_merchant", "seconds_since_last_txn"]
    assert sorted(map(str, out.select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))
    # Only the current side brings the text that no window reads.
    plan = out.select(columns)._jdf.queryExecution().optimizedPlan().toString()
    assert "null AS cardCVV" in plan


def test_store_reads_wanted_columns_only(spark, txns, tmp_path):
    rows = FeaturePipeline().clean(made(txns))
    store = FeatureStore(spark, str(tmp_path / "store"))
    store.write(rows.where("row_key < 30"))
    current = rows.where("row_key >= 30")
    some, whole = store.history_for(current, 12, wanted=LOOKBACK_COLUMNS), store.history_for(current, 12)
    assert set(some.columns) == set(LOOKBACK_COLUMNS) and "cardCVV" in whole.columns
    told = lambda df: sorted(map(str, df.select(*LOOKBACK_COLUMNS).collect()))
    assert told(some) == told(whole)
    assert some.where(F.col("row_key") < 20).count() > 0  # rows from the side tables too
