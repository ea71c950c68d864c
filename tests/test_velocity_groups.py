"""Accounts of a group share one call of the state processor and cost two state calls each."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.session import work_dir
from ledgerlens.streaming import jobs
from ledgerlens.streaming.velocity import COUNT_WINDOWS, HOUR, RETAIN, SUM_WINDOWS, VELOCITY_COLUMNS, Velocity, ends


class State:
    """Value and map states of one group, and timers, in memory."""

    def __init__(self, calls):
        self.calls, self.held, self.timers = calls, {}, []

    def getMapState(self, *_):
        return State(self.calls)

    getValueState = getMapState

    def registerTimer(self, due):
        self.timers.append(due)

    def exists(self):
        return () in self.held

    def update(self, value):
        self.held[()] = value

    def getValue(self, key):
        self.calls.append(key)
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls.append(key)
        self.held[key] = value

    def removeKey(self, key):
        self.held.pop(key, None)

    def iterator(self):
        return iter(list(self.held.items()))

    def clear(self):
        self.held.clear()


class Expiry:
    def __init__(self, ms):
        self.getExpiryTimeInMs = lambda: ms


def batches(days=(0, 12, 24, 100)):
    rng, key, out = random.Random(3), 0, []
    for day in days:
        rows = []
        for _ in range(150):
            second = int((day + rng.uniform(0, 12) - (rng.uniform(0, 25) if rng.random() < 0.2 else 0)) * 86_400) + 1_700_000_000
            second -= second % 3600 if rng.random() < 0.3 else 0
            rows.append((f"a{rng.randint(0, 5)}", key, second * 1_000_000, rng.randint(1, 9) * 10_000))
            key += 1
        out.append(rows)
    return out


def expected(seen, rows):
    out = {}
    for account, key, us, _ in rows:
        near = {w: [r[3] for r in seen if r[0] == account and us - h * HOUR <= r[2] < us] for w, h in COUNT_WINDOWS.items()}
        out[key] = [len(near[w]) for w in COUNT_WINDOWS] + [sum(near[w]) / 10_000 for w in SUM_WINDOWS]
    return out


NAMES = [*(f"txn_count_{w}" for w in COUNT_WINDOWS), *(f"txn_amount_sum_{w}" for w in SUM_WINDOWS)]


@pytest.mark.parametrize("packed", [4096, 7, 0])
def test_group_of_accounts(packed):
    calls, seen = [], []
    handle, processor = State(calls), Velocity(packed)
    processor.init(handle)
    for rows in batches():
        seen += rows
        del calls[:]
        table = pd.DataFrame(rows, columns=["account", "row_key", "us", "units"])
        out = pd.concat(processor.handleInputRows((1,), iter([table[:100], table[100:]]), None))
        assert {int(r["row_key"]): [r[n] for n in NAMES] for _, r in out.iterrows()} == expected(seen, rows)
        assert dict(zip(out["row_key"], out["account"])) == dict(zip(table["row_key"], table["account"]))
        if packed == 4096:
            assert len(calls) == 2 * table["account"].nunique()
    assert len(handle.timers) == 1


@pytest.mark.parametrize("packed", [4096, 0])
def test_ended_accounts_go(packed):
    handle, processor = State([]), Velocity(packed)
    processor.init(handle)
    rows = pd.DataFrame([("old", 1, 5 * HOUR, 1), ("new", 2, 900 * HOUR, 1)], columns=["account", "row_key", "us", "units"])
    list(processor.handleInputRows((1,), iter([rows]), None))
    assert handle.timers == [ends(5)] and ends(5) == (5 + 1 + RETAIN) * 3_600_000
    list(processor.handleExpiredTimer((1,), None, Expiry(handle.timers[-1])))
    assert list(processor.accounts.held) == [("new",)] and len(processor.points.held) == (packed == 0)
    assert handle.timers[1:] == [ends(900)] and processor.due.exists()
    list(processor.handleExpiredTimer((1,), None, Expiry(handle.timers[-1])))
    assert not processor.accounts.held and not processor.points.held and not processor.due.exists()


def test_stream_with_accounts_kept_by_hour(spark, txns):
    landing, path, state = (work_dir(spark, n) for n in ("events", "out", "state"))
    sample, seen, want = txns({}), [], {}
    for number, rows in enumerate(batches((0, 12))):
        part = spark.createDataFrame(rows, "account string, key long, us long, units long")
        fixed = [F.lit(v).cast(sample.schema[c].dataType).alias(c) for c, v in sample.first().asDict().items()
                 if c not in ("row_key", "accountNumber", "transactionDateTime", "transactionAmount")]
        time = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss").alias("transactionDateTime")
        table = part.select(F.col("key").alias("row_key"), F.col("account").alias("accountNumber"), time, (F.col("units") / 10_000).alias("transactionAmount"), *fixed)
        table.write.parquet(f"{landing}/part={number}")
        stream = spark.readStream.schema(table.schema).parquet(f"{landing}/part=*")
        jobs.parquet_sink(jobs.velocity_stream(stream, packed_points=7), path, state).awaitTermination()
        seen += rows
        want |= expected(seen, rows)
    got = spark.read.schema(VELOCITY_COLUMNS).parquet(path).collect()
    assert {r["row_key"]: [r[n] for n in NAMES] for r in got} == want
