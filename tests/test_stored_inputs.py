"""Inputs that are read several times are stored first."""

from ledgerlens.models import training
from ledgerlens.plans import feature_pipeline


def test_clean_rows_are_stored_before_they_are_split(spark, txns, monkeypatch):
    rows = txns(*[{"transactionDateTime": f"2021-{1 + i % 12:02d}-03T05:00:00"} for i in range(24)])
    seen = []
    flag = feature_pipeline.chrono_flag
    monkeypatch.setattr(feature_pipeline, "chrono_flag", lambda df, *a: seen.append(df) or flag(df, *a))
    both, _ = feature_pipeline.train_test_features(rows)
    assert both.count() == 24
    assert seen[0].inputFiles() and all(f.endswith(".parquet") for f in seen[0].inputFiles())


def test_vectors_are_stored_before_they_are_fitted(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "a", float(i), i % 2) for i in range(30)], "row_key long, c string, n double, isFraud int")
    prepare = training.fit_preprocessor
    monkeypatch.setattr(training, "fit_preprocessor", lambda df, numeric: prepare(df, ["c"], ["n"]))
    fitted = []
    build = training._estimator
    monkeypatch.setattr(training, "_estimator", lambda n, p, s, ready: fitted.append(ready) or build(n, p, s, ready))
    training.fit_model(rows, "logistic_regression")
    assert fitted[0].inputFiles()
