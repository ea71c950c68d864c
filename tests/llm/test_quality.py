"""The additive model: held-out accuracy, tables, odd rows."""

import numpy as np

from ledgerlens.llm.quality_gam import FEATURES, AdditiveModel, fit_quality, score_quality, text_features


def test_held_out_accuracy(spark):
    from ledgerlens.llm.q_quality import op3_quality

    path = "/root/testdata/sf0.1"
    labels = dict(spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "quality").collect())
    got = op3_quality(spark, path).collect()
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 500 and np.mean([p == y for p, y in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_pairs_learn_what_single_tables_cannot():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    alone = AdditiveModel.fit(x[:3000], y[:3000], pairs=0)
    both = AdditiveModel.fit(x[:3000], y[:3000], pairs=1)
    right = lambda m: ((m.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean()
    assert right(alone) < 0.6 and right(both) > 0.95 and both.pairs[0][:2] == (0, 1)


def test_features_do_not_depend_on_the_batch():
    texts = ["A bb | bb bb!\nCC", "", None, "x" * 3_000_000, "é " * 10, "\n\n"]
    whole = text_features(texts)
    assert np.allclose(whole, np.vstack([text_features([t]) for t in texts]))
    row = dict(zip(FEATURES, whole[0]))
    assert row["bars"] == 1 / 16 and row["line_ends"] == 1 / 16 and row["capitals"] == 3 / 9
    assert row["repeats"] == 0 and abs(row["variety"] - 5 / 6) < 1e-9 and not whole[1].any() and not whole[2].any()


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, None, "x"), (2, "c", "y"), (None, "", "z")], "doc_id long, text string, score string")
    for rows in ([], [(1, 1)], [(1, 0), (2, 1), (2, None), (None, 1)]):
        model = fit_quality(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
        got = score_quality(docs, model)
        assert got.columns == docs.columns and all(0 <= r["score"] <= 1 for r in got.collect())
        assert score_quality(docs.limit(0), model).collect() == []
