"""Per-account velocity state for the streaming history job.

Accounts are dealt out to ``BUCKETS`` groups, so that what a group costs by itself is shared by its accounts. State per
account: as long as it holds at most ``PACKED_POINTS`` points (distinct times), all of them in one value, which a
micro-batch reads and writes with one call each. Beyond that, the totals of its hours (60 days of them at most) are in
this value, and the points of each hour in one of their own. A micro-batch then writes the totals and the hours that its
rows fall in, and reads the hours in which a window of a new row begins or ends. What it reads and writes does
not grow with the points that an account has had, so a hot account costs as much per new row as any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000_000
COUNT_WINDOWS = {"24h": 24, "48h": 48, "7d": 168, "30d": 720}
SUM_WINDOWS = {"24h": 24, "7d": 168}
#: Hours kept: the longest window and the lateness that the stream allows.
RETAIN = 2 * 720
#: Groups of accounts; as many tasks can share a micro-batch.
BUCKETS = 1024
#: Points of an account kept in one value, of 24 bytes each.
PACKED_POINTS = 4096
#: Milliseconds between two looks for accounts of a group that have ended.
LOOK_AGAIN = 86_400_000
VELOCITY_COLUMNS = ", ".join(
    ["row_key bigint", "account string"]
    + [f"txn_count_{w} bigint" for w in COUNT_WINDOWS]
    + [f"txn_amount_sum_{w} double" for w in SUM_WINDOWS]
)


def merged(*tables: np.ndarray) -> np.ndarray:
    """(key, rows, units) of all tables, one line per key, in order of keys: times, or hours."""
    lines = np.concatenate(tables)
    lines = lines[np.argsort(lines[:, 0], kind="stable")]
    first = np.flatnonzero(np.diff(lines[:, 0], prepend=lines[:1, 0] - 1))
    return np.column_stack([lines[first, 0], np.add.reduceat(lines[:, 1:], first)]) if len(first) else lines


def unpacked(held: bytes) -> np.ndarray:
    return np.frombuffer(held, np.int64).reshape(-1, 3)


def by_hour(points: np.ndarray) -> dict[int, np.ndarray]:
    """The points of each hour, of points in order of time."""
    hours, first = np.unique(points[:, 0] // HOUR, return_index=True)
    return dict(zip(hours.tolist(), np.split(points, first[1:])))


def hour_totals(points: dict[int, np.ndarray]) -> np.ndarray:
    """(hour, rows, units) of the points of hours."""
    return np.array([[hour, *part[:, 1:].sum(axis=0)] for hour, part in points.items()], np.int64)


def running(lines: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2, … lines."""
    return np.concatenate([np.zeros((1, 2), np.int64), lines[:, 1:].cumsum(axis=0)])


class Before:
    """Running totals of everything strictly before a time, from hour totals and the points of some hours."""

    def __init__(self, totals: np.ndarray, points: list[np.ndarray]):
        table = merged(*points)
        self.hours, self.whole = totals[:, 0], running(totals)
        self.us, self.part = table[:, 0], running(table)

    def __call__(self, at: np.ndarray) -> np.ndarray:
        """(rows, units) before each time; the points of its hour must be known."""
        hour = at // HOUR
        inside = self.part[np.searchsorted(self.us, at)] - self.part[np.searchsorted(self.us, hour * HOUR)]
        return self.whole[np.searchsorted(self.hours, hour)] + inside


class BeforePoints:
    """The same from all points of an account."""

    def __init__(self, points: np.ndarray):
        self.us, self.part = points[:, 0], running(points)

    def __call__(self, at: np.ndarray) -> np.ndarray:
        return self.part[np.searchsorted(self.us, at)]


def windows(us: np.ndarray, before: Before | BeforePoints) -> dict[str, np.ndarray]:
    """The window columns of rows at ``us``."""
    now, out = before(us), {}
    for name, hours in COUNT_WINDOWS.items():
        out[f"txn_count_{name}"] = (now - before(us - hours * HOUR))[:, 0]
    for name, hours in SUM_WINDOWS.items():
        out[f"txn_amount_sum_{name}"] = (now - before(us - hours * HOUR))[:, 1] / 10_000
    return out


def ends(hour: int) -> int:
    """When the watermark (ms) has passed the last window that the hour can be in."""
    return (hour + 1 + RETAIN) * HOUR // 1000


class Velocity(StatefulProcessor):
    """Input: event_ts, bucket, account, row_key, us, units. Output: ``VELOCITY_COLUMNS``, one row per input row."""

    def __init__(self, packed_points: int = PACKED_POINTS):
        self.packed_points = packed_points

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # All points of an account, or the totals of its hours (``hourly``).
        self.accounts = handle.getMapState("accounts", "account string", "hourly boolean, held binary")
        self.points = handle.getMapState("points", "account string, hour bigint", "held binary")
        self.due = handle.getValueState("due", "ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat([b[["account", "row_key", "us", "units"]] for b in rows], ignore_index=True)
        values = batch[["us", "units"]].to_numpy()
        codes, names = pd.factorize(batch["account"], use_na_sentinel=False)
        order = np.argsort(codes, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(codes[order])) + 1)
        done = [self._account(n if isinstance(n, str) else None, *values[at].T) for n, at in zip(names, parts)]
        if not self.due.exists():
            self._look_at(ends(min(latest for _, latest in done)))
        columns = {c: np.concatenate([out[c] for out, _ in done]) for c in done[0][0]}
        yield pd.DataFrame({c: batch[c].to_numpy()[order] for c in ("row_key", "account")} | columns)

    def _account(self, name: str | None, us: np.ndarray, units: np.ndarray) -> tuple[dict[str, np.ndarray], int]:
        """The window columns of an account's new rows, and its latest hour."""
        new = merged(np.column_stack([us, np.ones(len(us), np.int64), units]))
        hourly, held = self.accounts.getValue((name,)) or (False, b"")
        if hourly:
            return self._of_hours(name, us, new, unpacked(held))
        points = merged(unpacked(held), new)
        out, latest = windows(us, BeforePoints(points)), int(points[-1, 0]) // HOUR
        points = points[np.searchsorted(points[:, 0], (latest - RETAIN) * HOUR) :]
        if len(points) <= self.packed_points:
            self.accounts.updateValue((name,), (False, points.tobytes()))
        else:
            parts = by_hour(points)
            for hour, part in parts.items():
                self.points.updateValue((name, hour), (part.tobytes(),))
            self.accounts.updateValue((name,), (True, hour_totals(parts).tobytes()))
        return out, latest

    def _of_hours(self, name: str | None, us: np.ndarray, new: np.ndarray, totals: np.ndarray) -> tuple[dict[str, np.ndarray], int]:
        """The same of an account that is kept by hour."""
        parts, known = by_hour(new), set(totals[:, 0].tolist())
        totals = merged(totals, hour_totals(parts))
        points = {h: merged(self._read(name, h), part) if h in known else part for h, part in parts.items()}
        for hour, part in points.items():
            self.points.updateValue((name, hour), (part.tobytes(),))
        edges = {h - w for h in points for w in COUNT_WINDOWS.values()} & known - set(points)
        out = windows(us, Before(totals, [*points.values(), *(self._read(name, h) for h in sorted(edges))]))
        latest = int(totals[-1, 0])
        kept = np.searchsorted(totals[:, 0], latest - RETAIN)
        for hour in totals[:kept, 0].tolist():
            self.points.removeKey((name, hour))
        self.accounts.updateValue((name,), (True, totals[kept:].tobytes()))
        return out, latest

    def _read(self, name: str | None, hour: int) -> np.ndarray:
        return unpacked(self.points.getValue((name, hour))[0])

    def _look_at(self, due: int) -> None:
        self.handle.registerTimer(due)
        self.due.update((due,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Accounts whose last window the watermark has passed go."""
        now, ended, later = expiredTimerInfo.getExpiryTimeInMs(), [], []
        for (name,), (hourly, held) in self.accounts.iterator():
            hours = unpacked(held)[:, 0] // (1 if hourly else HOUR)
            due = ends(int(hours[-1]))
            if due > now:
                later.append(due)
            else:
                ended.append((name, hours.tolist() if hourly else []))
        for name, hours in ended:
            self.accounts.removeKey((name,))
            for hour in hours:
                self.points.removeKey((name, hour))
        if later:
            self._look_at(max(min(later), now + LOOK_AGAIN))
        else:
            self.due.clear()
        return iter([])

    def close(self) -> None:
        pass
