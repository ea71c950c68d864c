"""Fresh-session scans, payload items, store lookback, late rows, linear penalty, artifacts."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerlens.models import training as t
from ledgerlens.models.artifact import Artifact, load_any, save_any
from ledgerlens.plans.feature_pipeline import FeaturePipeline
from ledgerlens.plans.scoring import score_batch
from ledgerlens.sources.readers import RAW, from_records, payload_rejects
from ledgerlens.sources.store import FeatureStore

ROOT = Path(__file__).resolve().parents[1]
FIRST = {
    "metrics": """
from ledgerlens.operators.metrics import collect_metrics
df = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.4)], "isFraud int, fraud_probability double")
out = collect_metrics(df, 0.5).first()
""",
    "codes": """
from ledgerlens.operators.profile import label_codes
df = spark.createDataFrame([("b",), ("a",), (None,)], "merchantName string")
out = label_codes(df, "merchantName").collect()
""",
}


@pytest.mark.parametrize("name", ["metrics", "codes"])
def test_first_query_of_a_session(name, tmp_path):
    """A scan over in-memory rows as the first query: the chunk key must not be seen through."""
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from ledgerlens.session import build_session
spark = build_session("t", "local[2]", **{{"spark.ui.enabled": "false", "spark.checkpoint.dir": {str(tmp_path)!r}}})
{FIRST[name]}
print("DONE", out)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "DONE" in done.stdout, done.stderr[-1500:]


def test_mixed_list_keeps_its_good_items(spark):
    texts = ['[{"accountNumber": "1"}, 5, null, {"accountNumber": "2"}]', '{"accountNumber": "3"}', "7", None, "[]"]
    payloads = spark.createDataFrame([(x,) for x in texts], "value string")
    rows = from_records(payloads, keep=(RAW,))
    assert sorted(r.accountNumber for r in rows.collect()) == ["1", "2", "3"]
    assert '{"accountNumber":"1"}' in {r[RAW].replace(" ", "") for r in rows.collect()}
    left = [r.value for r in payload_rejects(payloads).collect()]
    assert sorted(map(str, left)) == sorted(["5", "null", "7", "None", "[]"])


def test_payloads_do_not_see_each_other(spark, txns):
    rows = txns(*[{"transactionAmount": 10.0 + i, "isFraud": i % 2 == 0} for i in range(6)])
    pipeline = FeaturePipeline().fit(rows)
    model = t.fit_model(pipeline.transform(rows), "logistic_regression")
    bad = '{"accountNumber": "1", "odd": "kept as it came"}'
    payloads = rows.select(F.to_json(F.struct("*")).alias("value")).union(spark.createDataFrame([(bad,)], "value string"))
    scores, rejected = score_batch(payloads, model, pipeline, keep=("row_key",))
    got = scores.collect()
    assert len(got) == 6 and all(r.txn_count_30d == 0 and r.is_new_merchant == 1 for r in got)
    assert all(r.feature_contributions == [] for r in got)
    assert [r.value for r in rejected.collect()] == [bad]


def test_store_lookback_has_every_row_of_the_window(spark, txns, tmp_path):
    base = {"accountNumber": "5", "merchantName": "often"}
    times = [f"2020-03-{1 + i // 60:02d}T{i % 24:02d}:{i % 60:02d}:00" for i in range(600)]
    old = [{**base, "merchantName": "old", "transactionDateTime": "2019-01-01T00:00:00"}] * 2
    other = [{"accountNumber": "6", "transactionDateTime": "2020-03-02T00:00:00"}]
    rows = txns(*[{**base, "transactionDateTime": x} for x in times], *old, *other)
    pipeline = FeaturePipeline().fit(rows)
    store = FeatureStore(spark, str(tmp_path))
    store.append(pipeline.transform(rows), batch="stream-0")
    new = txns(*[{**base, "merchantName": m, "transactionDateTime": "2020-03-20T00:00:00"} for m in ("old", "fresh")])
    past = store.history_for(new)
    # 600 recent rows, the first of the older merchant and the last older row.
    assert past.count() == 602 and past.where("accountNumber = '6'").count() == 0
    out = {r.merchantName: r for r in pipeline.transform(new, past).collect()}
    assert out["old"].txn_count_30d == out["fresh"].txn_count_30d == 600
    assert (out["old"].is_new_merchant, out["fresh"].is_new_merchant) == (0, 1)
    plan = past._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "LeftSemi" in plan


def test_state_keeps_lateness_and_window():
    from ledgerlens.streaming import velocity

    assert velocity.RETAIN == 2 * max(velocity.COUNT_WINDOWS.values())


def test_doubling_rows_is_doubling_c(txns):
    rows = txns(*[{"transactionAmount": float(5 + (i * 37) % 90), "isFraud": (i * 37) % 90 > 50} for i in range(60)])
    features = FeaturePipeline().fit(rows).transform(rows).withColumn("class_weight", F.lit(1.0))
    twice = features.unionByName(features.withColumn("row_key", F.col("row_key") + 1000))
    one = t.fit_model(features, "logistic_regression", C=2.0).classifier.coefficients.toArray()
    two = t.fit_model(twice, "logistic_regression", C=1.0).classifier.coefficients.toArray()
    assert two == pytest.approx(one, rel=0.02, abs=1e-3)


def test_artifact_of_a_stack(spark, txns, tmp_path):
    rows = txns(
        *[
            {
                "transactionAmount": float(5 + (i * 37) % 90),
                "isFraud": (i * 37) % 90 > 60,
                "transactionDateTime": f"2020-01-{1 + i % 28:02d}T00:00:00",
            }
            for i in range(80)
        ]
    )
    pipeline = FeaturePipeline().fit(rows)
    features = pipeline.transform(rows)
    model = t.fit_stacked(features, k=2, num_trees=2, max_depth=2)
    artifact = Artifact(model, pipeline, features.limit(5), {"threshold": 0.5, "passed": False})
    artifact.save(str(tmp_path / "a"))
    again = Artifact.load(spark, str(tmp_path / "a"))
    score = lambda m: {r.row_key: r.fraud_probability for r in m.transform(features).collect()}
    assert score(again.model) == pytest.approx(score(model)) and again.facts["passed"] is False
    assert again.pipeline.transform(rows).count() == 80 and again.background.count() == 5
    calibrated = t.calibrate_isotonic(model.transform(features))
    save_any(spark, calibrated, str(tmp_path / "iso"))
    assert load_any(spark, str(tmp_path / "iso")).score == calibrated.score
    with pytest.raises(TypeError):
        save_any(spark, object(), str(tmp_path / "x"))
