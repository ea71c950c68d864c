"""Snapshots, compaction, replays and lookups of the feature store."""

import random
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans.feature_pipeline import FeaturePipeline
from ledgerlens.sources.store import FeatureStore, date_ranges


def rows_of(txns, rng, n, day_from, day_to, account=None):
    out = []
    for _ in range(n):
        day = rng.randint(day_from, day_to)
        out.append({
            "accountNumber": account or str(rng.randint(1, 9)),
            "merchantName": f"m{rng.randint(0, 6)}",
            "transactionDateTime": f"20{18 + day // 336:02d}-{1 + day % 336 // 28:02d}-{1 + day % 28:02d}T{rng.randint(0, 23):02d}:00:00",
            "transactionAmount": float(rng.randint(1, 90)),
        })
    return txns(*out)


def keyed(df, start):
    return df.withColumn("row_key", F.col("row_key") + start)


def files(store):
    _, content = store._snapshot()
    return store._data(content, content["segments"]).select("event_date", F.input_file_name().alias("f")).distinct()


def content_of(store):
    return Counter(tuple(r) for r in store.read().select("row_key", "accountNumber", "transactionAmount").collect())


@pytest.fixture
def filled(spark, txns, tmp_path):
    rng = random.Random(1)
    store = FeatureStore(spark, str(tmp_path), buckets=2, compact_at=3)
    want = Counter()
    for k in range(8):
        part = keyed(rows_of(txns, rng, 15, 0, 3), 100 * k)
        store.append(part, batch=f"b{k}")
        want += Counter(tuple(r) for r in part.select("row_key", "accountNumber", "transactionAmount").collect())
    return store, want


def test_compaction_bounds_files_and_keeps_rows(filled):
    store, want = filled
    assert content_of(store) == want
    _, content = store._snapshot()
    assert len(content["segments"]) <= 2 * store.compact_at and max(s["level"] for s in content["segments"]) >= 1
    store.compact(force=True)
    assert content_of(store) == want and len(store._snapshot()[1]["segments"]) == 2
    per_day = Counter(r["event_date"] for r in files(store).collect())
    assert max(per_day.values()) <= 2 * store.buckets


def test_reader_keeps_its_snapshot(filled):
    store, want = filled
    before = store.read()
    store.compact(force=True)
    store.write(store.read().where("row_key < 5"))
    assert before.count() == sum(want.values()) and store.read().count() == 5


def test_replay_of_a_merged_batch(filled, txns):
    store, want = filled
    store.compact(force=True)
    again = keyed(rows_of(txns, random.Random(9), 4, 0, 3), 200)
    assert store.append(again, batch="b2") == 4
    kept = Counter({k: v for k, v in want.items() if not 200 <= k[0] < 300})
    assert content_of(store) == kept + Counter(tuple(r) for r in again.select("row_key", "accountNumber", "transactionAmount").collect())
    assert store.append(again, batch="b2") == 4 and sum(content_of(store).values()) == sum(kept.values()) + 4


def test_append_while_compacting(filled, txns, monkeypatch):
    """A writer that publishes first makes the other publish on top of it."""
    store, want = filled
    more = keyed(rows_of(txns, random.Random(3), 5, 0, 3), 900)
    other, inner, done = FeatureStore(store.spark, store.path.rsplit("/", 1)[0], compact_at=99), store._commit, []

    def late(change, schema=None):
        if not done:
            done.append(other.append(more, batch="late"))
        inner(change, schema)

    monkeypatch.setattr(store, "_commit", late)
    store.compact(force=True)
    assert done == [5] and sum(content_of(store).values()) == sum(want.values()) + 5


def test_empty_and_unreadable_times(spark, txns, tmp_path):
    store = FeatureStore(spark, str(tmp_path))
    odd = txns({"transactionDateTime": "never"}, {"accountNumber": None}, {})
    assert store.write(odd.limit(0)) == 0 and store.columns() is None
    assert store.write(odd) == 3 and store.append(odd.limit(0)) == 0 and store.read().count() == 3
    assert store.history_for(odd.where("transactionDateTime = 'never'")) is None


@pytest.mark.parametrize("merged", [False, True])
def test_history_equals_all_rows(spark, txns, tmp_path, merged):
    """Windows, gap and new merchants with the looked-up rows equal those with the whole store; dates are pruned."""
    rng = random.Random(5)
    store = FeatureStore(spark, str(tmp_path), compact_at=99)
    parts = [keyed(rows_of(txns, rng, 60, 100 * k, 100 * k + 90), 1000 * k) for k in range(4)]
    pipeline = FeaturePipeline().fit(parts[0])
    for k, part in enumerate(parts):
        store.append(pipeline.transform(part), batch=f"stream-{k}")
    if merged:
        store.compact(force=True)
    new = keyed(rows_of(txns, rng, 25, 380, 420).unionByName(keyed(rows_of(txns, rng, 10, 150, 300), 500)), 9000)
    ancient = txns({"transactionDateTime": "1970-01-01T05:00:00", "accountNumber": "3", "merchantName": "m1"}, {"transactionDateTime": "1960-bad"})
    new = new.unionByName(keyed(ancient, 9900))
    past = store.history_for(new)
    names = ["row_key", "txn_count_24h", "txn_count_30d", "txn_amount_sum_7d", "seconds_since_last_txn", "is_new_merchant"]
    whole = pipeline.transform(new, store.read())
    got, want = ({r[0]: tuple(r) for r in df.select(*[c for c in names if c in df.columns]).collect()} for df in (pipeline.transform(new, past), whole))
    assert got == want and len(got) == 36
    # Without the batch that a replay would write again.
    without = {r["row_key"] for r in store.history_for(new, exclude="stream-3").collect()}
    assert without and all(k < 3000 for k in without)


def test_one_old_row_does_not_widen_the_scan(spark, txns, tmp_path):
    store = FeatureStore(spark, str(tmp_path))
    rng = random.Random(2)
    store.append(FeaturePipeline().fit(rows_of(txns, rng, 30, 0, 300)).transform(rows_of(txns, rng, 80, 0, 300)), batch="x")
    new = txns(*[{"transactionDateTime": f"{d}T05:00:00", "accountNumber": "3"} for d in ("1970-01-01", "2018-11-20")])
    past = store.history_for(new)
    plan = past._sc._jvm.PythonSQLUtils.explainString(past._jdf.queryExecution(), "formatted")
    scans = [part for part in plan.split("Scan parquet")[1:] if "Location" in part]
    data = [part for part in scans if "/data" in part.split("Location")[1][:600]]
    assert data and all("event_date" in part.split("PartitionFilters: ")[1].split("\n")[0] for part in data)
    near = F.to_date("event_ts").between(F.lit(date(2018, 10, 20)), F.lit(date(2018, 11, 20)))
    # All rows of the dates asked for, and of older ones the first per merchant and the last.
    assert past.where(near).count() == store.read().where(near & (F.col("accountNumber") == "3")).count() > 0
    assert 0 < past.where(~near).count() <= 8


def test_date_ranges():
    d = date(2020, 3, 1)
    assert date_ranges([d, date(2020, 3, 3), date(1970, 1, 1)], 30) == [(date(1969, 12, 1), date(1970, 1, 1)), (date(2020, 1, 30), date(2020, 3, 3))]
