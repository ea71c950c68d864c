"""Only model columns go through the windows where only they are wanted; explanations are attached in place."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.models.training import fit_model
from ledgerlens.operators import explain as x
from ledgerlens.operators.split import background_sample
from ledgerlens.operators.tree_explain import TreeExplainer
from ledgerlens.plans import feature_pipeline as fp
from ledgerlens.plans.scoring import score_frame
from ledgerlens.schema import FEATURE_COLUMNS
from ledgerlens.session import METHOD_LIMIT, checkpointed, small_methods
from ledgerlens.sources.sinks import write_scored
from ledgerlens.workload.learning import MODEL_COLUMNS


def rows(txns):
    return txns(
        *[
            {
                "accountNumber": str(i % 7),
                "merchantName": f"m{i % 3}",
                "transactionAmount": None if i % 31 == 30 else 3.0 + i * 7 % 50,
                "transactionDateTime": f"2021-{1 + i % 9:02d}-0{1 + i % 5}T0{i % 4}:00:00",
                "dateOfLastAddressChange": None if i % 4 else "2019-02-01",
                "posEntryMode": None if i % 6 == 0 else "05",
                "isFraud": i % 4 == 0,
            }
            for i in range(120)
        ]
    )


def test_wanted_columns_are_those_of_the_whole_table(spark, txns, monkeypatch):
    raw = rows(txns)
    whole, _ = fp.train_test_features(raw)
    stored = []
    keep = fp.checkpointed
    monkeypatch.setattr(fp, "checkpointed", lambda df: stored.append(df.columns) or keep(df))
    some, _ = fp.train_test_features(raw, columns=MODEL_COLUMNS)
    assert some.columns == [*MODEL_COLUMNS, "is_test"]
    assert not {"cardCVV", "accountOpenDate", "transactionDateTime"} & set(stored[0])
    assert sorted(map(str, some.collect())) == sorted(map(str, whole.select(some.columns).collect()))
    with pytest.raises(ValueError):
        fp.train_test_features(raw.drop("row_key"), columns=MODEL_COLUMNS)


def test_attached_contributions_are_those_of_the_join(spark, txns):
    both, _ = fp.train_test_features(rows(txns), columns=MODEL_COLUMNS)
    both = checkpointed(both)
    model = fit_model(both, "random_forest", num_trees=3, max_depth=3)
    explainer = TreeExplainer.of(model, background_sample(both, FEATURE_COLUMNS, n=40))
    scored = score_frame(model, both, 0.6)
    joined = x.explain_frame(scored, explainer.contributions(scored, top=x.TOP_FEATURES))
    whole = x.explain_frame(scored, explainer.contributions(scored))
    attached = x.explain_attached(explainer.attached(scored))
    assert attached.columns == [*scored.columns, "top_reasons", "explanation_methods", "feature_contributions"]
    told = lambda df: sorted(map(str, df.select(*attached.columns).collect()))
    assert told(attached) == told(joined) == told(whole)
    plan = attached._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Aggregate" not in plan


def test_scored_lines_are_compressed(spark, tmp_path):
    df = spark.range(50).select("id", F.lit("a name that repeats").alias("text"))
    target = write_scored(df, str(tmp_path / "scored"), 3)
    assert list((tmp_path / "scored" / "batch=3").glob("*.json.gz"))
    assert spark.read.schema(df.schema).json(target).count() == 50


def test_method_limit_is_put_back(spark):
    before = spark.conf.get(METHOD_LIMIT)
    with pytest.raises(RuntimeError), small_methods(spark):
        assert spark.conf.get(METHOD_LIMIT) == "8000"
        raise RuntimeError
    assert spark.conf.get(METHOD_LIMIT) == before
