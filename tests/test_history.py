"""History windows against a per-row loop, on the direct and on the chunked path."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.operators import history as h

START = datetime(2024, 1, 1)
HOUR = 3600


def rows_of(spark, points):
    rows = [
        (i, f"a{account}", (START + timedelta(seconds=second)).isoformat(), amount / 100, f"m{merchant}", bool(fraud))
        for i, (account, second, amount, merchant, fraud) in enumerate(points)
    ]
    return spark.createDataFrame(
        rows,
        "row_key bigint, accountNumber string, transactionDateTime string, transactionAmount double, merchantName string, isFraud boolean",
    )


def expected(points):
    out = {}
    order = sorted(range(len(points)), key=lambda i: (points[i][0], points[i][1], i))
    last, seen = {}, set()
    for i in order:
        account, second, amount, merchant, fraud = points[i]

        def past(hours):
            return [p for p in points if p[0] == account and second - hours * HOUR <= p[1] < second]

        week = [p[2] / 100 for p in past(168)]
        out[i] = {
            "txn_count_24h": len(past(24)),
            "txn_count_30d": len(past(720)),
            "txn_amount_sum_7d": sum(week),
            "txn_amount_mean_7d": sum(week) / len(week) if week else 0.0,
            "seconds_since_last_txn": float(second - last[account]) if account in last else 0.0,
            "is_new_merchant": int((account, merchant) not in seen),
            "max": max((p[2] / 100 for p in past(24)), default=0.0),
        }
        last[account] = second
        seen.add((account, merchant))
    return out


POINT = st.tuples(
    st.integers(0, 2),
    st.integers(0, 90).map(lambda n: n * 6 * HOUR),
    st.integers(1, 5000),
    st.integers(0, 2),
    st.integers(0, 1),
)


@pytest.mark.parametrize("hot_rows", [None, 4])
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(points=st.lists(POINT, min_size=1, max_size=40))
def test_pipeline_history_matches_a_loop(spark, hot_rows, points):
    got = h.pipeline_history(rows_of(spark, points), hot_rows=hot_rows).collect()
    want = expected(points)
    assert len(got) == len(points)
    for row in got:
        for name, value in want[row.row_key].items():
            if name != "max":
                assert row[name] == pytest.approx(value, abs=1e-6), (row.row_key, name)


@pytest.mark.parametrize("max_rows", [None, 3])
def test_sliding_maximum_matches_a_loop(spark, max_rows):
    points = [(i % 3, (i * i * 7 % 60) * 3 * HOUR, (i * 37) % 5000 + 1, 0, 0) for i in range(60)]
    spec = [h.Spec("m", "amount_max", "24h")]
    got = h.history_features(rows_of(spark, points), "accountNumber", spec, max_rows=max_rows).collect()
    want = expected(points)
    assert {r.row_key: r.m for r in got} == pytest.approx({i: w["max"] for i, w in want.items()})


AMOUNT = st.tuples(st.integers(0, 1), st.integers(0, 400), st.integers(-300, 300))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(points=st.lists(AMOUNT, min_size=1, max_size=60))
def test_maxima_of_several_windows_match_a_loop(spark, points):
    """Ties, gaps longer than a window, negative amounts, windows that share block edges, on both paths."""
    hours = (1, 24, 48, 168)
    df = rows_of(spark, [(a, h_ * HOUR, amount, 0, 0) for a, h_, amount in points])
    specs = [h.Spec(f"m{w}", "amount_max", f"{w}h") for w in hours] + [h.Spec("n", "velocity", "48h")]
    for hot_rows in (None, 6):
        got = h.history_features(df, "accountNumber", specs, hot_rows=hot_rows).collect()
        assert len(got) == len(points)
        for row in got:
            account, at, _ = points[row.row_key]
            for w in hours:
                inside = [p[2] / 100 for p in points if p[0] == account and at - w <= p[1] < at]
                assert row[f"m{w}"] == pytest.approx(max(inside, default=0.0)), (row.row_key, w, hot_rows)


def test_maxima_need_no_more_exchanges(spark):
    specs = h.parametric_specs("amount_max", "accountNumber")
    df = h.history_features(rows_of(spark, [(0, 0, 1, 0, 0)]), "accountNumber", specs)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 2  # backwards for the tails, then forwards for all the rest


def test_rows_do_not_count_themselves(spark):
    got = h.pipeline_history(rows_of(spark, [(0, 0, 1000, 0, 0), (0, HOUR, 2000, 0, 0)])).orderBy("row_key").collect()
    assert [r.txn_count_24h for r in got] == [0, 1] and got[1].txn_amount_sum_24h == 10.0


def test_merchant_known_only_from_lookback(spark):
    df = rows_of(spark, [(0, 0, 100, 1, 0), (0, 40 * 24 * HOUR, 100, 1, 0)])
    got = h.pipeline_history(df.where("row_key = 1"), lookback=df.where("row_key = 0")).collect()
    assert len(got) == 1 and got[0].is_new_merchant == 0 and got[0].txn_count_30d == 0


def test_unknown_kind_is_an_error():
    with pytest.raises(ValueError, match="unknown history kind"):
        h.parametric_specs("nope", "accountNumber")


def test_account_windows_share_one_exchange(spark):
    plan = h.pipeline_history(rows_of(spark, [(0, 0, 1, 0, 0)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Window [") == 2


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_merchant_rank_with_ties(spark, hot_rows):
    points = [(0, (i // 4) * HOUR, 100, 0, 0) for i in range(20)]
    got = h.merchant_rank(rows_of(spark, points), hot_rows=hot_rows).collect()
    assert {r.row_key: r.merchant_txn_rank for r in got} == {i: i for i in range(20)}
