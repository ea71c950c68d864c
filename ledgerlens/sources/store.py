"""Feature store: one table per name, made of segments that a snapshot lists.

Every write is a segment: Parquet files by account bucket and event date, written first and then published by a
snapshot, a one-row file that appears in one rename. Readers resolve the newest snapshot once and read its segments
only, so they never see half a write or half a compaction. Writing a batch again replaces exactly that batch.

Compaction merges the segments of a level once there are ``compact_at`` of them, so the number of segments, and with it
the files of a date, stays bounded. Beside each segment a side table keeps the first row per account and merchant
and the last row per account and date; history lookups take older rows from these and read the dates they need.

Files that no snapshot lists any more stay in place; expire them by age. The column list is fixed by the first write.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ledgerlens.functions.features import with_event_time
from ledgerlens.functions.quality import validate
from ledgerlens.schema import transaction_schema

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
NEVER_STORED = ["class_weight"]
SEGMENT, BUCKET, DAY, BATCH, KIND = "store_segment", "store_bucket", "event_date", "ingest_batch", "store_kind"
LAYOUT = [SEGMENT, BUCKET, DAY, BATCH]
ENTITY = ["accountNumber", "merchantName"]
Segments = list[dict]


class FeatureStore:
    def __init__(
        self, spark: SparkSession, root: str, table: str = "transaction_features", buckets: int = 8, compact_at: int = 16
    ) -> None:
        if not NAME.fullmatch(table):
            raise ValueError(f"invalid table name: {table!r}")
        self.spark, self.path = spark, f"{root.rstrip('/')}/{table}"
        self.buckets, self.compact_at = buckets, compact_at

    # -- snapshots ---------------------------------------------------------------

    def _snapshot(self) -> tuple[int, dict]:
        """(version, content) of the newest snapshot; version 0 is before the first write."""
        try:
            files = self.spark.read.text(f"{self.path}/snapshots").inputFiles()
        except AnalysisException:
            files = []
        versions = [int(v) for v in (re.search(r"/v=(\d+)/", f)[1] for f in files)]
        if not versions:
            return 0, {"schema": None, "buckets": self.buckets, "segments": []}
        newest = max(versions)
        return newest, json.loads(self.spark.read.text(f"{self.path}/snapshots/v={newest}").first()[0])

    def _commit(self, change: Callable[[Segments], Segments], schema: T.StructType | None = None) -> None:
        """Publish the segments that ``change`` makes of the newest ones; again if another writer was faster."""
        for _ in range(10):
            version, content = self._snapshot()
            content["segments"] = change(content["segments"])
            content["buckets"] = self.buckets if version == 0 else content["buckets"]
            if schema is not None:
                content["schema"] = schema.jsonValue()
            row = self.spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1)
            try:
                row.write.text(f"{self.path}/snapshots/v={version + 1}")
                return
            except AnalysisException as error:
                if error.getCondition() != "PATH_ALREADY_EXISTS":
                    raise
        raise RuntimeError("other writers kept publishing; try again")

    # -- segments ----------------------------------------------------------------

    def _schema(self, content: dict) -> T.StructType:
        return T.StructType.fromJson(content["schema"])

    def _open(self, folder: str, names: Sequence[str], fields: T.StructType, by_day: bool) -> DataFrame:
        """The files of some segments, with their partition columns."""
        parts = [T.StructField(SEGMENT, T.StringType()), T.StructField(BUCKET, T.IntegerType())]
        parts += [T.StructField(DAY, T.DateType())] if by_day else []
        schema = T.StructType([*fields.fields, *parts])
        if not names:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/{folder}")
        return reader.parquet(*[f"{self.path}/{folder}/{SEGMENT}={n}" for n in names])

    def _data(self, content: dict, segments: Segments) -> DataFrame:
        fields = T.StructType([*self._schema(content).fields, T.StructField(BATCH, T.StringType())])
        return self._open("data", [s["name"] for s in segments], fields, True)

    def _has_sides(self, columns: Sequence[str]) -> bool:
        return {*ENTITY, "transactionDateTime"} <= set(columns)

    def _side(self, content: dict, segments: Segments) -> DataFrame:
        fields = [*self._schema(content).fields, T.StructField(DAY, T.DateType()), T.StructField(KIND, T.StringType())]
        return self._open("side", [s["name"] for s in segments], T.StructType(fields), False)

    def _sides_of(self, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        """First row per account and merchant and last per account and date, of data or of such rows."""
        timed = with_event_time(rows) if "event_ts" not in rows.columns else rows
        timed = timed.where(F.col("accountNumber").isNotNull() & F.col("event_ts").isNotNull())
        whole = F.struct(*columns, DAY, BUCKET)
        order = F.struct("event_ts", *(["row_key"] if "row_key" in columns else []))
        firsts = timed.groupBy(*ENTITY).agg(F.min_by(whole, order).alias("_r"))
        lasts = timed.groupBy("accountNumber", DAY).agg(F.max_by(whole, order).alias("_r"))
        kinds = ((firsts, "first"), (lasts, "last"))
        first, last = (df.select("_r.*").withColumn(KIND, F.lit(kind)) for df, kind in kinds)
        return first.unionByName(last)

    def _write(self, rows: DataFrame, columns: Sequence[str], sides: DataFrame | None = None) -> tuple[str, int]:
        """Write one segment and its side table; (name, rows)."""
        name = uuid.uuid4().hex
        target = f"{self.path}/data/{SEGMENT}={name}"
        near = [c for c in ("accountNumber",) if c in columns]
        # Rows of a bucket and date meet in one task; AQE splits those that are too large and joins small ones.
        laid = rows.hint("rebalance", BUCKET, DAY).sortWithinPartitions(BUCKET, DAY, *near)
        laid.select(*columns, BATCH, BUCKET, DAY).write.partitionBy(BUCKET, DAY).parquet(target)
        fields = T.StructType([*rows.select(*columns).schema.fields, T.StructField(BATCH, T.StringType())])
        written = self._open("data", [name], fields, True)
        count = written.count()  # from the footers
        if count and self._has_sides(columns):
            found = self._sides_of(written if sides is None else sides, columns)
            found.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/side/{SEGMENT}={name}")
        return name, count

    # -- writing -----------------------------------------------------------------

    def columns(self) -> list[str] | None:
        """Stored columns in order, or None before the first write."""
        version, content = self._snapshot()
        return self._schema(content).names if version else None

    def read(self) -> DataFrame:
        _, content = self._snapshot()
        if content["schema"] is None:
            raise ValueError("the store has not been written yet")
        return self._data(content, content["segments"]).drop(*LAYOUT)

    def write(self, features: DataFrame) -> int:
        """Create or replace the table; an empty frame changes nothing. Returns the row count."""
        return self._save(features.drop(*NEVER_STORED), "initial", replace=True)

    def append(self, features: DataFrame, batch: str | None = None) -> int:
        """Add rows by column name. Extra columns go; missing ones are an error naming them."""
        version, content = self._snapshot()
        if not version:
            return self._save(features.drop(*NEVER_STORED), batch or "initial", replace=False)
        stored = self._schema(content)
        missing = [c for c in stored.names if c not in features.columns]
        if missing:
            raise ValueError(f"features lack stored columns: {', '.join(missing)}")
        rows = features.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in stored.fields])
        return self._save(rows, batch or f"append-{uuid.uuid4().hex}", replace=False)

    def _save(self, features: DataFrame, batch: str, replace: bool) -> int:
        version, content = self._snapshot()
        buckets = self.buckets if replace or not version else content["buckets"]
        day = (
            F.to_date(with_event_time(features)["event_ts"])
            if "event_ts" in features.columns
            else F.to_date(F.try_to_timestamp("transactionDateTime"))
        )
        spread = bucket_of(F.col("accountNumber"), buckets) if "accountNumber" in features.columns else F.lit(0)
        rows = features.withColumns({DAY: day, BATCH: F.lit(batch), BUCKET: spread})
        name, count = self._write(rows, features.columns)
        if not count:
            return 0
        made = {"name": name, "batches": [batch], "level": 0}
        if replace:
            self._commit(lambda live: [made], _nullable(features.schema))
            return count
        # A batch that has been merged with others is taken out of its segment first; a lone one just goes.
        for segment in content["segments"]:
            if batch in segment["batches"] and len(segment["batches"]) > 1:
                rest = self._data(content, [segment]).where(F.col(BATCH) != batch)
                left, _ = self._write(rest, self._schema(content).names)
                kept = {**segment, "name": left, "batches": [b for b in segment["batches"] if b != batch]}
                self._commit(lambda live, gone=segment["name"], kept=kept: [kept if s["name"] == gone else s for s in live])
        self._commit(
            lambda live: [*(s for s in live if s["batches"] != [batch]), made],
            None if version else _nullable(features.schema),
        )
        self.compact()
        return count

    def compact(self, force: bool = False) -> int:
        """Merge the segments of every level that has ``compact_at`` of them (with ``force``, all but the newest
        segment). The newest stays alone, as its batch is the one that may come again. Returns the segments merged."""
        merged = level = 0
        while True:
            _, content = self._snapshot()
            older = content["segments"][:-1]
            due = older if force else [s for s in older if s["level"] == level]
            if len(due) < (2 if force else self.compact_at):
                if force or level >= max((s["level"] for s in older), default=0):
                    return merged
                level += 1
                continue
            columns = self._schema(content).names
            sides = self._side(content, due) if self._has_sides(columns) else None
            name, _ = self._write(self._data(content, due), columns, sides)
            gone = {s["name"] for s in due}
            batches = [b for s in due for b in s["batches"]]
            made = {"name": name, "batches": batches, "level": max(s["level"] for s in due) + 1}

            def swap(live: Segments, gone: set = gone, made: dict = made) -> Segments:
                if not gone <= {s["name"] for s in live}:
                    raise RuntimeError("a merged segment was replaced meanwhile; compact again")
                return [made, *(s for s in live if s["name"] not in gone)]

            self._commit(swap)
            merged += len(due)
            if force:
                return merged

    # -- lookups -----------------------------------------------------------------

    def _live(self, exclude: str | None) -> tuple[dict, Segments, Segments] | None:
        """(snapshot, segments without the batch ``exclude``, segments that hold it with others)."""
        version, content = self._snapshot()
        if not version:
            return None
        mixed = [s for s in content["segments"] if exclude in s["batches"] and len(s["batches"]) > 1]
        return content, [s for s in content["segments"] if exclude not in s["batches"]], mixed

    def recent_history(self, account: str, limit: int = 500) -> DataFrame:
        """The newest rows of one account, read from its bucket alone; an absent table is empty."""
        found = self._live(None)
        if found is None:
            return self.spark.createDataFrame([], transaction_schema())
        content, segments, _ = found
        mine = self._data(content, segments).where(F.col(BUCKET) == bucket_of(F.lit(account), content["buckets"]))
        newest = with_event_time(mine.where(F.col("accountNumber") == account).drop(*LAYOUT))
        return newest.orderBy(F.col("event_ts").desc(), *_tie(newest)).limit(limit)

    def history_for(
        self, rows: DataFrame, days: int = 30, exclude: str | None = None, wanted: Sequence[str] | None = None
    ) -> DataFrame | None:
        """Stored rows that decide the history of ``rows``: for their accounts, all rows of the ``days`` before each
        date that valid rows have, and of rows outside those dates the first per merchant and the last before them.

        The dates come first, so only their partitions are read, however old a single row is; all else comes from the
        side tables. Accounts are joined before anything is grouped. ``exclude`` leaves out one ingest batch;
        ``wanted`` names the stored columns to read, all of them by default. None
        before the first write, or without a valid row.
        """
        found = self._live(exclude)
        if found is None:
            return None
        dates = [r[0] for r in validate(rows).select(F.to_date("event_ts")).distinct().collect()]
        if not dates:
            return None
        content, segments, mixed = found
        columns = self._schema(content).names
        read = columns if wanted is None else [c for c in columns if c in {*wanted, *ENTITY, "event_ts", "transactionDateTime"}]
        accounts = rows.select(F.col("accountNumber").alias("_account")).distinct()
        mine = lambda df: df.join(accounts, F.col("accountNumber") == F.col("_account"), "left_semi")
        ranges = date_ranges(dates, days)
        day = F.col(DAY)
        near = [day.between(F.lit(low), F.lit(high)) for low, high in ranges]
        inside = near[0]
        for more in near[1:]:
            inside = inside | more
        stored = self._data(content, [*segments, *mixed])
        stored = stored.where(F.col(BATCH) != exclude) if mixed else stored
        recent = mine(stored.where(inside)).select(*read)
        if not self._has_sides(columns):
            return with_event_time(recent)
        sides = self._side(content, segments)
        if mixed:
            rest = self._data(content, mixed).where(F.col(BATCH) != exclude)
            sides = sides.unionByName(self._sides_of(rest, columns), allowMissingColumns=True)
        older = mine(sides.where(~inside & (day < F.lit(ranges[-1][1]))))
        older = older if "event_ts" in columns else with_event_time(older)
        whole = F.struct(*read)
        order = F.struct("event_ts", *(["row_key"] if "row_key" in columns else []))
        gap = sum((day > F.lit(high)).cast("int") for _, high in ranges)  # the range that comes next
        firsts = older.where(F.col(KIND) == "first").groupBy(*ENTITY).agg(F.min_by(whole, order).alias("_r"))
        lasts = older.where(F.col(KIND) == "last").groupBy("accountNumber", gap.alias("_gap"))
        lasts = lasts.agg(F.max_by(whole, order).alias("_r"))
        bounds = firsts.select("_r.*").unionByName(lasts.select("_r.*")).distinct()
        return with_event_time(recent.unionByName(bounds))

    def recent_history_all(self, limit: int = 500, exclude: str | None = None) -> DataFrame:
        """The newest rows of every account. Tasks keep only their top rows before the shuffle.

        ``exclude`` leaves out one ingest batch (its segment is not read).
        """
        found = self._live(exclude)
        if found is None:
            return self.spark.createDataFrame([], transaction_schema())
        content, segments, mixed = found
        stored = self._data(content, [*segments, *mixed])
        stored = stored.where(F.col(BATCH) != exclude) if mixed else stored
        rows = with_event_time(stored.drop(*LAYOUT))
        newest = Window.partitionBy("accountNumber").orderBy(F.col("event_ts").desc(), *_tie(rows))
        return rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limit).drop("_n")


def bucket_of(account: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(account.cast("string")), F.lit(buckets).cast("bigint")).cast("int")


def date_ranges(dates: Sequence[date], days: int) -> list[tuple[date, date]]:
    """The dates from ``days`` and a day before each of ``dates`` up to it, as ranges in order."""
    out: list[tuple[date, date]] = []
    for d in sorted(set(dates)):
        low = max(d - timedelta(days=days + 1), date.min) if d.toordinal() > days + 1 else date.min
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], d)
        else:
            out.append((low, d))
    return out


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def _tie(df: DataFrame) -> list:
    return [F.col("row_key").desc()] if "row_key" in df.columns else []
