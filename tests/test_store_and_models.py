import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.models import training as t
from ledgerlens.models.registry import COMPONENTS, component
from ledgerlens.operators import explain, resample
from ledgerlens.operators.encoding import encoder_apply, encoder_fit
from ledgerlens.operators.neighbors import nearest
from ledgerlens.operators.split import background_sample
from ledgerlens.plans.feature_pipeline import FeaturePipeline
from ledgerlens.plans.scoring import score_batch, score_frame
from ledgerlens.sources import sinks
from ledgerlens.sources.store import FeatureStore


def test_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("1", "2016-01-01T00:00:00", 0, 0.1, 2.0)],
        "accountNumber string, transactionDateTime string, isFraud int, amount_to_limit_ratio double, class_weight double",
    )
    store = FeatureStore(spark, str(tmp_path))
    assert store.recent_history("1").count() == 0
    assert store.write(df.limit(0)) == 0 and store.columns() is None
    assert store.write(df) == 1 and store.append(df.withColumn("more", F.lit(1))) == 1
    assert store.read().count() == 2 and "class_weight" not in store.columns()
    assert store.append(df, batch="b") == 1 and store.append(df, batch="b") == 1
    assert store.read().count() == 3 and store.recent_history("1", 2).count() == 2
    with pytest.raises(ValueError, match="isFraud"):
        store.append(df.drop("isFraud"))
    with pytest.raises(ValueError):
        FeatureStore(spark, str(tmp_path), "no; drop")


def test_alerts_leave_no_folder_without_rows(spark, tmp_path):
    df = spark.createDataFrame([(0.1,)], "fraud_probability double")
    assert sinks.write_alerts(df, str(tmp_path / "a"), 0.8) is None and not (tmp_path / "a").exists()


def test_encoders(txns):
    train = txns({"merchantName": "risky", "isFraud": True}, {"merchantName": "normal"})
    pipeline = FeaturePipeline().fit(train)
    assert pipeline.encoders.global_rate == 0.5
    row = pipeline.transform(txns({"merchantName": "risky"}, {"merchantName": "new"})).orderBy("row_key").collect()
    assert [r.merchantName_fraud_rate for r in row] == [1.0, 0.5]


def test_pipeline_save_and_load(spark, txns, tmp_path):
    pipeline = FeaturePipeline().fit(txns({"isFraud": True}, {"merchantName": "b"}))
    pipeline.save(str(tmp_path / "p"))
    again = FeaturePipeline.load(spark, str(tmp_path / "p"))
    assert again.transform(txns({})).first().merchantName_fraud_rate == 1.0


def test_registry():
    assert {"xgboost", "random_forest", "logistic_regression", "isolation_forest", "stacking_ensemble"} <= set(COMPONENTS)
    assert component("random_forest").build(max_depth=3).getMaxDepth() == 3
    with pytest.raises(ValueError, match="available"):
        component("unknown")


@pytest.fixture(scope="module")
def trained(spark):
    return {}


def twelve(txns):
    return txns(
        *[
            {
                "accountNumber": str(i % 3),
                "transactionDateTime": f"2016-08-{i + 1:02d}T10:00:00",
                "transactionAmount": 10.0 + i * 20 * (i % 3 == 0),
                "isFraud": i % 3 == 0,
            }
            for i in range(12)
        ]
    )


def test_train_score_explain_and_reload(spark, txns, tmp_path):
    rows = twelve(txns)
    pipeline = FeaturePipeline()
    features = pipeline.fit_transform(rows, with_class_weights=True)
    assert {r.class_weight for r in features.where("isFraud = 1").collect()} == {2.0}
    model = t.fit_model(features, "logistic_regression", max_iter=10)
    t.save_model(model, str(tmp_path / "m"), {"model_version": "v1"})
    loaded, metadata = t.load_model(spark, str(tmp_path / "m"))
    assert metadata == {"model_version": "v1"}
    first = {r.row_key: r.fraud_probability for r in score_frame(model, features, 0.5).collect()}
    second = {r.row_key: r.fraud_probability for r in score_frame(loaded, features, 0.5).collect()}
    assert len(first) == 12 and first == pytest.approx(second)

    background = background_sample(features, ["transactionAmount"], 2)
    assert background.count() == 2
    scored = score_frame(model, features, 0.5)
    parts = explain.sampled_contributions(model, scored, features.limit(3), ["transactionAmount", "cvv_mismatch"])
    out = explain.explain_frame(scored, parts).collect()
    assert len(out) == 12 and all(len(r.feature_contributions) <= 5 for r in out)

    payloads = rows.limit(1).select(F.to_json(F.struct("*")).alias("value")).unionByName(
        spark.createDataFrame([('{"merchantName": "only"}',), ("oops",)], "value string")
    )
    scores, rejected = score_batch(payloads, model, pipeline, threshold=0.0)
    assert [r.risk_band for r in scores.collect()] == ["critical"] and rejected.count() == 2


def test_heuristics_without_contributions(spark):
    df = spark.createDataFrame(
        [(1, 0.8, 1, 0, 0, 0, 0.0), (2, 0.8, 0, 0, 0, 0, 0.0), (3, 0.1, 0, 0, 0, 0, 0.0)],
        "row_key bigint, fraud_probability double, cvv_mismatch int, cross_border int, is_new_merchant int, txn_count_24h int, amount_to_limit_ratio double",
    )
    got = {r.row_key: list(r.top_reasons) for r in explain.explain_frame(df).collect()}
    assert got == {1: ["CVV mismatch"], 2: ["Model score above elevated-risk threshold"], 3: []}


def points(spark, n=120, copies=40):
    x = np.round(np.random.default_rng(3).normal(size=(n, 3)), 1)
    x[:copies] = x[0]
    rows = [(i, *map(float, v), bool(i % 4 == 0)) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "row_key bigint, a double, b double, c double, isFraud boolean")


@pytest.mark.parametrize("block_rows", [12, 4000])
def test_nearest_matches_brute_force(spark, block_rows):
    x, df = points(spark)
    from ledgerlens.operators.neighbors import vectors

    v = vectors(df, ["a", "b", "c"])
    got = {(r.id, r["rank"]): r.distance for r in nearest(v, v, 2, block_rows).collect()}
    distance = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    np.fill_diagonal(distance, np.inf)
    best = np.sort(distance, axis=1)
    assert got == pytest.approx({(i, k + 1): best[i, k] for i in range(len(x)) for k in range(2)})


def test_smote_counts_and_stays_inside(spark):
    _, df = points(spark)
    new = resample.smote(df, ["a", "b", "c"], ratio=1.0).collect()
    assert len(new) == 60
    fraud = [r.a for r in df.where("isFraud").collect()]
    assert all(min(fraud) <= r.a <= max(fraud) for r in new)


def test_tomek_links_are_mutual_and_mixed(spark):
    df = spark.createDataFrame(
        [(0, 0.0, True), (1, 0.1, False), (2, 5.0, False), (3, 5.1, False), (4, 9.0, True)], "row_key bigint, a double, isFraud boolean"
    )
    assert [(r.minority, r.majority) for r in resample.tomek_links(df, ["a"]).collect()] == [(0, 1)]
    assert sorted(r.row_key for r in resample.drop_tomek(df, ["a"]).collect()) == [0, 2, 3, 4]
