"""Streaming history with one hot account, late rows and ties equals windows over all rows that have arrived."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.session import work_dir
from ledgerlens.streaming import jobs
from ledgerlens.streaming.velocity import COUNT_WINDOWS, HOUR, RETAIN, SUM_WINDOWS, VELOCITY_COLUMNS


def test_retention():
    assert RETAIN == 2 * max(COUNT_WINDOWS.values()) and HOUR == 3_600_000_000


@pytest.fixture(scope="module")
def batches():
    rng = random.Random(12)
    start = 1_700_000_000
    out, key = [], 0
    for number in range(4):
        rows = []
        for _ in range(400):
            account = "hot" if rng.random() < 0.5 else f"a{rng.randint(0, 8)}"
            day = number * 12 + rng.uniform(0, 12) - (rng.uniform(0, 28) if rng.random() < 0.2 else 0)
            second = int(start + day * 86_400)
            second -= second % 3600 if rng.random() < 0.3 else 0  # ties, on the hour
            rows.append((key, account, second, round(rng.uniform(1, 500), 2)))
            key += 1
        out.append(rows)
    return out


def test_matches_all_rows_so_far(spark, txns, batches):
    landing, path, state = (work_dir(spark, n) for n in ("events", "out", "state"))
    sample = txns({})
    for number, rows in enumerate(batches):
        part = spark.createDataFrame(rows, "key long, account string, second long, amount double")
        fixed = [F.lit(v).cast(sample.schema[c].dataType).alias(c) for c, v in sample.first().asDict().items()
                 if c not in ("row_key", "accountNumber", "transactionDateTime", "transactionAmount")]
        time = F.date_format(F.timestamp_seconds("second"), "yyyy-MM-dd'T'HH:mm:ss")
        table = part.select(F.col("key").alias("row_key"), F.col("account").alias("accountNumber"), time.alias("transactionDateTime"), F.col("amount").alias("transactionAmount"), *fixed)
        table.write.parquet(f"{landing}/part={number}")
        stream = spark.readStream.schema(table.schema).parquet(f"{landing}/part=*")
        jobs.parquet_sink(jobs.velocity_stream(stream), path, state).awaitTermination()
    got = {r["row_key"]: r for r in spark.read.schema(VELOCITY_COLUMNS).parquet(path).collect()}
    seen = []
    assert len(got) == sum(map(len, batches))
    for rows in batches:
        seen += rows
        for key, account, second, _ in rows:
            for name, hours in COUNT_WINDOWS.items():
                near = [r for r in seen if r[1] == account and second - hours * 3600 <= r[2] < second]
                assert got[key][f"txn_count_{name}"] == len(near)
                if name in SUM_WINDOWS:
                    assert abs(got[key][f"txn_amount_sum_{name}"] - sum(r[3] for r in near)) < 1e-6
