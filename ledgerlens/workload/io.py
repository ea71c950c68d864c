"""Queries over sources and sinks: each writes derived data below the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import scalars as s
from ledgerlens.operators import metrics as m
from ledgerlens.schema import TRANSACTION_FIELDS
from ledgerlens.session import work_dir
from ledgerlens.sources import kafka, readers, sinks
from ledgerlens.sources.store import FeatureStore
from ledgerlens.workload.evaluation import METRICS_SQL, r6
from ledgerlens.workload.registry import coerced, raw, register, scored, valid

COLUMNS = ["row_key", *TRANSACTION_FIELDS]
ALL_SQL = f"SELECT {', '.join(f'CAST(row_key AS VARCHAR) AS row_key' if c == 'row_key' else c for c in COLUMNS)} FROM txn"
# Blank text is null once it has been through CSV.
CSV_SQL = f"""SELECT {', '.join('CAST(row_key AS VARCHAR) AS row_key' if c == 'row_key' else
    f"nullif({c}, '') AS {c}" if c != 'row_key' and TRANSACTION_FIELDS[c] == 'string' else c for c in COLUMNS)} FROM txn"""


@register("read_jsonl", ALL_SQL)
def read_jsonl(spark, sf_dir):
    path = work_dir(spark, "jsonl")
    raw(spark, sf_dir).write.json(path)
    return readers.read_jsonl(spark, path, keep=("row_key",))


@register("read_csv", CSV_SQL)
def read_csv(spark, sf_dir):
    path = work_dir(spark, "csv")
    raw(spark, sf_dir).write.option("header", True).csv(path)
    return readers.read_csv(spark, path, keep=("row_key",))


@register("read_transactions", f"{ALL_SQL} UNION ALL {CSV_SQL.replace('FROM txn', 'FROM txn')}")
def read_transactions(spark, sf_dir):
    lines, table = work_dir(spark, "lines") + ".ndjson", work_dir(spark, "table") + ".csv"
    raw(spark, sf_dir).write.json(lines)
    raw(spark, sf_dir).write.option("header", True).csv(table)
    keep = ("row_key",)
    return readers.read_transactions(spark, lines, keep).unionByName(readers.read_transactions(spark, table, keep))


@register("records_to_frame", ALL_SQL)
def records_to_frame(spark, sf_dir):
    payloads = raw(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    return readers.from_records(payloads, keep=("row_key",))


STORED = ["row_key", "accountNumber", "transactionDateTime", "transactionAmount", "event_ts"]
STORE_SQL = "SELECT row_key, accountNumber, transactionAmount, us AS event_us FROM valid"


def stored(df):
    return df.select("row_key", "accountNumber", "transactionAmount", s.micros(F.col("event_ts")).alias("event_us"))


@register("store_write", STORE_SQL)
def store_write(spark, sf_dir):
    store = FeatureStore(spark, work_dir(spark, "store"))
    store.write(valid(spark, sf_dir).select(*STORED).withColumn("class_weight", F.lit(1.0)))
    return stored(store.read())


@register("store_append", STORE_SQL)
def store_append(spark, sf_dir):
    store = FeatureStore(spark, work_dir(spark, "store"))
    rows = valid(spark, sf_dir).select(*STORED)
    store.append(rows.where("row_key % 2 = 0"))
    odd = rows.where("row_key % 2 = 1").withColumn("extra", F.lit(1))
    store.append(odd, batch="odd")
    store.append(odd, batch="odd")  # a replay replaces its own batch
    return stored(store.read())


@register(
    "store_recent_history",
    """SELECT row_key, accountNumber, transactionAmount, event_us FROM (SELECT row_key, accountNumber, transactionAmount, us AS event_us,
    row_number() OVER (PARTITION BY accountNumber ORDER BY us DESC, row_key DESC) AS n FROM valid) WHERE n <= 5""",
)
def store_recent_history(spark, sf_dir):
    store = FeatureStore(spark, work_dir(spark, "store"))
    store.write(valid(spark, sf_dir).select(*STORED))
    return stored(store.recent_history_all(5))


@register(
    "store_recent_history_account",
    """SELECT row_key, accountNumber, transactionAmount, us AS event_us FROM valid
    WHERE accountNumber = (SELECT min(accountNumber) FROM valid) ORDER BY us DESC, row_key DESC LIMIT 20""",
)
def store_recent_history_account(spark, sf_dir):
    store = FeatureStore(spark, work_dir(spark, "store"))
    rows = valid(spark, sf_dir).select(*STORED)
    store.write(rows)
    return stored(store.recent_history(rows.agg(F.min("accountNumber")).first()[0], 20))


@register("sink_scored_jsonl", "SELECT row_key, merchantState, p AS fraud_probability FROM valid")
def sink_scored_jsonl(spark, sf_dir):
    target = sinks.write_scored(scored(spark, sf_dir), work_dir(spark, "scored"), batch_id=0)
    return spark.read.schema("row_key bigint, merchantState string, fraud_probability double").json(target)


@register("sink_alerts", "SELECT row_key, p AS fraud_probability FROM valid WHERE p >= 0.82")
def sink_alerts(spark, sf_dir):
    target = sinks.write_alerts(scored(spark, sf_dir), work_dir(spark, "alerts"), 0.82, batch_id=0)
    return spark.read.schema("row_key bigint, fraud_probability double").json(target)


@register("sink_kafka_publish", "SELECT accountNumber AS key, row_key, merchantName FROM txn")
def sink_kafka_publish(spark, sf_dir):
    """The message shape: key and JSON value, decoded again."""
    messages = kafka.encode(coerced(spark, sf_dir))
    value = F.from_json("value", "row_key bigint, merchantName string")
    return messages.select("key", value.alias("v")).select("key", "v.row_key", "v.merchantName")


@register("kafka_decode", ALL_SQL)
def kafka_decode(spark, sf_dir):
    """Topic-shaped bytes back to transactions."""
    messages = kafka.encode(raw(spark, sf_dir)).select(F.col("value").cast("binary").alias("value"))
    return kafka.decode(messages, keep=("row_key",))


@register("sink_metrics", f"WITH {METRICS_SQL} SELECT * FROM metrics")
def sink_metrics(spark, sf_dir):
    path = work_dir(spark, "metrics")
    sinks.write_metrics(m.collect_metrics(scored(spark, sf_dir), 0.82), path)
    kinds = {c: "double" for c in ("auc_roc", "auc_pr", "precision", "recall", "f1")}
    kinds |= {f"{a}_{b}": "bigint" for a in ("true", "false") for b in ("positives", "negatives")}
    row = spark.read.schema(", ".join(f"{c} {t}" for c, t in kinds.items())).json(path)
    return r6(row, "auc_roc", "auc_pr", "precision", "recall", "f1")
