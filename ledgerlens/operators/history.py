"""Leakage-safe per-entity history features over ``[t - W, t)``.

Rows of one entity with the same timestamp never see each other. Counts and sums over a window are
the difference of two growing frames, so a long window on a busy entity stays linear; money is summed
in whole 1/10000 units, which makes the difference exact. A maximum is that of two blocks of time
(:func:`_sliding_max`), which growing frames give as well.

An entity that holds more than ``spark.ledgerlens.hotKeyRows`` rows is not windowed in one task.
Its rows are reduced to one point per timestamp and scanned in range chunks (``operators.scan``).
Both ways give the same values; the result is their union.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.features import with_event_time
from ledgerlens.functions.scalars import floor_div, label, micros, to_number
from ledgerlens.operators.scan import MAX_CHUNKS, fixed_edges, segmented_scan, with_chunk
from ledgerlens.session import checkpointed, hot_key_rows

UNITS = {"h": 3_600_000_000, "d": 86_400_000_000}
MONEY_SCALE = 10_000
DEFAULT_WINDOWS = ["1h", "24h", "48h", "72h", "7D", "14D", "30D", "90D", "180D", "365D"]
KINDS = [
    "velocity",
    "amount_sum",
    "amount_mean",
    "amount_std",
    "amount_max",
    "total_fraud",
    "fraud_rate",
]
# Order of an entity's rows: time, history before current, then row order.
POSITION = "struct(_us, _current, _ord)"
# Hot-key lists up to this length are collected and broadcast.
LISTED_HOT_KEYS = 100_000


def window_micros(text: str) -> int:
    return int(text[:-1]) * UNITS[text[-1].lower()]


@dataclass(frozen=True)
class Spec:
    """One output column: what to measure, over which window."""

    name: str
    kind: str
    window: str

    @property
    def micros(self) -> int:
        return window_micros(self.window)


PIPELINE_SPECS = [Spec(f"txn_count_{w}", "velocity", w) for w in ("24h", "48h", "7d", "30d")] + [
    Spec("txn_amount_sum_24h", "amount_sum", "24h"),
    Spec("txn_amount_sum_7d", "amount_sum", "7d"),
    Spec("txn_amount_mean_7d", "amount_mean", "7d"),
]

# Which prefix measures each kind needs.
NEEDS = {
    "velocity": {"n"},
    "amount_sum": {"amt"},
    "amount_mean": {"n", "amt"},
    "amount_std": {"n", "amt", "sq"},
    "amount_max": set(),
    "total_fraud": {"lab"},
    "fraud_rate": {"n", "lab"},
}


def row_order(df: DataFrame, order_col: str | None) -> Column:
    """Integral tie-breaker: the given row key, else a hash of the row (stable under recomputation)."""
    if order_col and order_col in df.columns:
        return F.col(order_col).cast("bigint")
    return F.xxhash64(*[F.col(c) for c in df.columns])


def money_units(column: Column) -> Column:
    """Money in whole 1/10000 units; missing or unreadable is 0."""
    return F.coalesce(F.round(to_number(column) * MONEY_SCALE).try_cast("bigint"), F.lit(0).cast("bigint"))


@dataclass(frozen=True)
class HotKeys:
    """Key values with too many rows for one task, and how many chunks to cut them into."""

    table: DataFrame
    listed: bool
    chunks: int


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int) -> HotKeys | None:
    """Key values with more than ``limit`` rows, or None when there are none.

    One map-side-combined count. A list of up to ``LISTED_HOT_KEYS`` values comes back as a literal
    table that may be broadcast; a longer one stays a distributed table.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
    found = counts.limit(LISTED_HOT_KEYS + 1).collect()
    if not found:
        return None
    if len(found) > LISTED_HOT_KEYS:
        return HotKeys(counts, False, MAX_CHUNKS)
    table = df.sparkSession.createDataFrame(found, counts.schema)
    total = sum(row["_rows"] for row in found)
    return HotKeys(table, True, max(2, min(MAX_CHUNKS, -(-total // max(1, limit)))))


def split_hot(df: DataFrame, keys: Sequence[str], hot: HotKeys) -> tuple[DataFrame, DataFrame]:
    """(cold rows, hot rows)."""
    named = hot.table.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    if hot.listed:
        named = F.broadcast(named)
    match = _same([(k, f"_hot_{k}") for k in keys])
    return df.join(named, match, "left_anti"), df.join(named, match, "left_semi")


def _same(pairs: Sequence[tuple[str, str]]) -> Column:
    """Null-safe equality over column pairs."""
    match = F.lit(True)
    for left, right in pairs:
        match = match & F.col(left).eqNullSafe(F.col(right))
    return match


def _measures(specs: Sequence[Spec]) -> list[str]:
    needed = set().union(*[NEEDS[s.kind] for s in specs]) if specs else set()
    return [m for m in ("n", "amt", "sq", "lab") if m in needed]


def _finish(spec: Spec, inside) -> Column:
    """Window value from measure differences; ``inside(m)`` is the measure over ``[t - W, t)``."""
    money = F.lit(float(MONEY_SCALE))
    if spec.kind == "velocity":
        return inside("n").cast("bigint")
    if spec.kind == "amount_sum":
        return inside("amt") / money
    if spec.kind == "total_fraud":
        return inside("lab").cast("bigint")
    count = F.nullif(inside("n").cast("double"), F.lit(0.0))
    if spec.kind == "amount_mean":
        return F.coalesce(inside("amt") / money / count, F.lit(0.0))
    if spec.kind == "fraud_rate":
        return F.coalesce(inside("lab") / count, F.lit(0.0))
    n, s, q = inside("n"), inside("amt"), inside("sq")
    # n·Σx² − (Σx)² in exact decimals, then sample variance.
    spread = (n.cast("decimal(10,0)") * q - s.cast("decimal(19,0)") * s.cast("decimal(19,0)")).cast("double")
    variance = spread / (n * (n - 1)).cast("double")
    return F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt(F.greatest(variance, F.lit(0.0))) / money)


def _prepare(df: DataFrame, entity: str, specs: Sequence[Spec], order_col: str | None) -> DataFrame:
    """Helper columns: key, time in µs, tie order, and the per-row measures."""
    df = with_event_time(df)
    kinds = {s.kind for s in specs}
    columns = {
        "_key": F.col(entity).cast("string"),
        "_us": micros(F.col("event_ts")),
        "_ord": row_order(df, order_col),
        "_n": F.lit(1).cast("bigint"),
    }
    if any("amt" in NEEDS[k] for k in kinds) or "amount_max" in kinds:
        columns["_amt"] = money_units(F.col("transactionAmount"))
    if "amount_std" in kinds:
        columns["_sq"] = columns["_amt"].cast("decimal(14,0)") * columns["_amt"].cast("decimal(14,0)")
    if any("lab" in NEEDS[k] for k in kinds):
        columns["_lab"] = label(F.col("isFraud")).cast("bigint")
    return df.withColumns(columns)


# -- direct windows: one exchange and one sort per entity --------------------------


def _cold(
    rows: DataFrame, specs: Sequence[Spec], lag: bool, sliding_max: Sequence[Spec], merchant: str | None
) -> DataFrame:
    by_time = Window.partitionBy("_key").orderBy("_us")
    before = by_time.rangeBetween(Window.unboundedPreceding, -1)
    if sliding_max:
        rows = _sliding_max(rows, sliding_max)
    measures = _measures(specs)
    windows = sorted({s.micros for s in specs})
    frames = {}
    for m in measures:
        frames[f"_p_{m}_0"] = F.sum(f"_{m}").over(before)
        for w in windows:
            if any(s.micros == w and m in NEEDS[s.kind] for s in specs):
                frames[f"_p_{m}_{w}"] = F.sum(f"_{m}").over(
                    by_time.rangeBetween(Window.unboundedPreceding, -(w + 1))
                )
    if lag:
        frames["_last_us"] = F.max("_us").over(before)
        frames["_first_ord"] = F.min(F.struct("_current", "_ord")).over(by_time.rangeBetween(0, 0))
    rows = rows.withColumns(frames) if frames else rows
    if merchant:
        # Hashing by entity already satisfies this partitioning: one more sort, no exchange.
        visits = Window.partitionBy("_key", merchant)
        rows = rows.withColumn("_first_pos", F.min(F.expr(POSITION)).over(visits))
    return rows


def _block(at: Column, length: int) -> Column:
    """Number of the block of ``length`` µs that holds ``at``."""
    width = F.lit(length).cast("bigint")
    return ((at - F.pmod(at, width)) / width).cast("bigint")


def _sliding_max(rows: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """Maxima over ``[t - W, t)`` of any length from growing frames: one more sort, no exchange.

    Time is cut into blocks as long as the window, so the window is a tail of one block and a head of the next. A
    growing maximum of (block, amount) is the head's; seen from the end of time, one of (-block, amount) is the tail's,
    wanted at the first row in the window. That row follows the last one before the window, which a growing frame
    finds; where there is none, it is the entity's first row.
    """
    lengths = sorted({s.micros for s in specs})
    us, amount = F.col("_us"), F.col("_amt")
    forward = Window.partitionBy("_key").orderBy("_us")
    backward = Window.partitionBy("_key").orderBy(F.col("_us").desc())
    upto = backward.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns(
        {f"_tail_{w}": F.max(F.struct((-_block(us, w)).alias("b"), amount.alias("a"))).over(upto) for w in lengths}
    )
    at = F.struct("_us", *[f"_tail_{w}" for w in lengths])
    rows = rows.withColumn("_here", at).withColumn("_next", F.lead("_here").over(forward))
    seen = forward.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    frames = {"_first": F.min("_here").over(seen)}
    for w in lengths:
        # Of rows at one time, the last has the greatest successor.
        older = F.struct("_us", F.struct(F.col("_next._us"), F.col(f"_next._tail_{w}")).alias("next"))
        frames[f"_after_{w}"] = F.max(older).over(forward.rangeBetween(Window.unboundedPreceding, -(w + 1)))
        head = F.struct(_block(us, w).alias("b"), amount.alias("a"))
        frames[f"_head_{w}"] = F.max(head).over(forward.rangeBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns(frames)
    peaks = {}
    for w in lengths:
        block = _block(us, w)
        after = F.col(f"_after_{w}")
        tail = F.when(after.isNull(), F.col(f"_first._tail_{w}")).otherwise(after["next"][f"_tail_{w}"])
        peaks[w] = F.greatest(
            F.when(F.col(f"_head_{w}.b") == block, F.col(f"_head_{w}.a")), F.when(tail["b"] == 1 - block, tail["a"])
        )
    money = float(MONEY_SCALE)
    rows = rows.withColumns({s.name: F.coalesce(peaks[s.micros] / money, F.lit(0.0)) for s in specs})
    return rows.drop("_here", "_next", *frames, *[f"_tail_{w}" for w in lengths])


# -- chunked scan for entities too large for one task ------------------------------


def _hot(
    rows: DataFrame,
    specs: Sequence[Spec],
    lag: bool,
    maxima: Sequence[Spec],
    merchant: str | None,
    chunks: int,
    limit: int,
) -> DataFrame:
    """The columns of :func:`_cold`, computed from one point per (entity, time) and joined back.

    The points are checkpointed: they are read several times and decide the chunk edges.
    """
    if merchant:
        firsts = rows.groupBy(F.col("_key").alias("_pk"), F.col(merchant).alias("_pm")).agg(
            F.min(F.expr(POSITION)).alias("_first_pos")
        )
        rows = rows.join(firsts, _same([("_key", "_pk"), (merchant, "_pm")])).drop("_pk", "_pm")
    if not (specs or lag or maxima):
        return rows
    measures = _measures(specs)
    aggregates = [F.sum(f"_{m}").alias(f"_{m}") for m in measures]
    aggregates.append(F.min(F.struct("_current", "_ord")).alias("_first_ord"))
    if maxima:
        aggregates.append(F.max("_amt").alias("_peak"))
    points = checkpointed(rows.groupBy("_key", "_us").agg(*aggregates))
    edges = _few_edges(points, limit, chunks)

    found = points.select(F.col("_key").alias("_pk"), F.col("_us").alias("_origin"), "_first_ord")
    if specs or lag:
        found = _attach(found, _prefixes(points, specs, measures, edges))
    if maxima:
        found = _attach(found, _block_max(points, maxima, edges))
    if not lag:
        found = found.drop("_first_ord")
    return rows.join(
        found, F.col("_key").eqNullSafe(F.col("_pk")) & (F.col("_us") == F.col("_origin"))
    ).drop("_pk", "_origin")


def _few_edges(points: DataFrame, limit: int, most: int) -> Column:
    """Chunk edges that leave at most ``limit`` points of an entity between two of them, from as few chunks as do;
    ``most`` chunks where fewer are not enough.

    Totals are carried for every chunk that an entity has points in, so more chunks than the largest entity needs
    would make them as many as the points.
    """
    largest = points.groupBy("_key").count().agg(F.max("count")).first()[0] or 0
    chunks = max(2, 2 * -(-largest // max(1, limit)))
    while chunks < most:
        edges = fixed_edges(points, "_us", chunks)
        fullest = with_chunk(points, "_us", edges).groupBy("_key", "_chunk").count().agg(F.max("count")).first()[0]
        if (fullest or 0) <= limit:
            return edges
        chunks *= 4
    return fixed_edges(points, "_us", most)


def _attach(found: DataFrame, more: DataFrame) -> DataFrame:
    return found.join(
        more, F.col("_pk").eqNullSafe(F.col("_mk")) & (F.col("_origin") == F.col("_mo")), "left"
    ).drop("_mk", "_mo")


def _prefixes(points: DataFrame, specs: Sequence[Spec], measures: Sequence[str], edges: Column) -> DataFrame:
    """Totals strictly before ``t`` and before each ``t - W``, per point.

    Points and look-up marks (one per window) share one scan; marks carry no measure. A point is its own mark at
    ``t``, because the scan leaves out what shares its time.
    """
    lengths = sorted({s.micros for s in specs})
    windows = [0, *lengths]
    types = dict(points.dtypes)
    none = F.lit(None).cast("bigint")
    marks = points.select(
        "_key", F.col("_us").alias("_origin"), F.explode(F.array(*[F.lit(w).cast("bigint") for w in lengths])).alias("_w")
    ).select(
        "_key",
        "_origin",
        "_w",
        (F.col("_origin") - F.col("_w")).alias("_us"),
        *[F.lit(0).cast(types[f"_{m}"]).alias(f"_{m}") for m in measures],
        none.alias("_seen"),
    )
    body = points.select(
        "_key",
        F.col("_us").alias("_origin"),
        F.lit(0).cast("bigint").alias("_w"),
        "_us",
        *[f"_{m}" for m in measures],
        F.col("_us").alias("_seen"),
    )
    scanned = segmented_scan(
        body.unionByName(marks) if lengths else body,
        ["_key"],
        "_us",
        {f"_q_{m}": f"_{m}" for m in measures},
        {"_q_last": "_seen"},
        edges=edges,
        before=True,
    )
    picked = [
        F.max(F.when(F.col("_w") == w, F.col(f"_q_{m}"))).alias(f"_p_{m}_{w}")
        for m in measures
        for w in windows
    ]
    picked.append(F.max(F.when(F.col("_w") == 0, F.col("_q_last"))).alias("_last_us"))
    return scanned.groupBy(F.col("_key").alias("_mk"), F.col("_origin").alias("_mo")).agg(*picked)


def _block_max(points: DataFrame, specs: Sequence[Spec], edges: Column) -> DataFrame:
    """Sliding maxima, linear in the points.

    Time is cut into blocks as long as the window. ``[t - W, t)`` is the tail of one block and the
    head of the next, so a suffix maximum and a prefix maximum cover it.
    """
    sizes = F.array(*[F.lit(w).cast("bigint") for w in sorted({s.micros for s in specs})])
    spread = points.select("_key", "_us", "_peak", F.explode(sizes).alias("_w"))

    def placed(at: Column, value: Column, origin: Column) -> DataFrame:
        return spread.select(
            "_key",
            "_w",
            at.alias("_us"),
            ((at - F.pmod(at, F.col("_w"))) / F.col("_w")).cast("bigint").alias("_block"),
            value.cast("bigint").alias("_peak"),
            origin.cast("bigint").alias("_origin"),
        )

    none = F.lit(None)
    body = placed(F.col("_us"), F.col("_peak"), none)
    heads = body.unionByName(placed(F.col("_us"), none, F.col("_us")))
    tails = body.unionByName(placed(F.col("_us") - F.col("_w"), none, F.col("_us")))
    segment = ["_key", "_w", "_block"]
    prefix = segmented_scan(heads, segment, "_us", maxes={"_m": "_peak"}, edges=edges, before=True)
    suffix = segmented_scan(tails, segment, "_us", maxes={"_m": "_peak"}, edges=edges, descending=True)
    both = prefix.unionByName(suffix).where("_origin IS NOT NULL")
    return both.groupBy(F.col("_key").alias("_mk"), F.col("_origin").alias("_mo")).agg(
        *[
            F.coalesce(
                F.max(F.when(F.col("_w") == s.micros, F.col("_m"))) / float(MONEY_SCALE), F.lit(0.0)
            ).alias(s.name)
            for s in specs
        ]
    )


def _outputs(specs: Sequence[Spec]) -> dict[str, Column]:
    out = {}
    for s in specs:
        if s.kind == "amount_max":
            continue

        def inside(m: str, w: int = s.micros) -> Column:
            now, then = (
                F.coalesce(F.col(f"_p_{m}_{x}"), F.lit(0).cast("bigint")) for x in (0, w)
            )
            return now - then

        out[s.name] = _finish(s, inside)
    return out


def history_features(
    df: DataFrame,
    entity: str,
    specs: Sequence[Spec],
    *,
    lookback: DataFrame | None = None,
    gap: bool = False,
    new_merchant: bool = False,
    order_col: str | None = "row_key",
    hot_rows: int | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Add one column per spec (and optionally the gap and new-merchant columns) to ``df``.

    An entity above ``hot_rows`` rows is split over tasks; ``max_rows`` lowers that bound where maxima are asked for.
    ``lookback`` rows only feed the windows; at equal times they come before current rows.
    """
    source_columns = df.columns
    rows = df.withColumn("_current", F.lit(1))
    if lookback is not None:
        past = lookback
        if order_col and order_col in {*past.columns, *rows.columns}:
            # Only what feeds the windows; without a row key, the hash of the whole row orders ties.
            fed = {entity, order_col, "event_ts", "transactionDateTime", "transactionAmount", "merchantName", "isFraud"}
            past = past.select(*[c for c in past.columns if c in fed])
        rows = past.withColumn("_current", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    rows = _prepare(rows, entity, specs, order_col)

    limit = hot_key_rows(df.sparkSession, hot_rows)
    maxima = [s for s in specs if s.kind == "amount_max"]
    plain = [s for s in specs if s.kind != "amount_max"]

    merchant = "merchantName" if new_merchant else None
    if maxima and max_rows is not None:
        limit = min(limit, max_rows)
    hot = hot_keys(rows, ["_key"], limit)
    if hot is None:
        rows = _cold(rows, plain, gap, maxima, merchant)
    else:
        cold, heavy = split_hot(rows, ["_key"], hot)
        rows = _cold(cold, plain, gap, maxima, merchant).unionByName(
            _hot(heavy, plain, gap, maxima, merchant, hot.chunks, limit), allowMissingColumns=True
        )
    rows = rows.withColumns(_outputs(plain)) if plain else rows
    if gap:
        # The first row of a tie group is measured from the last earlier time; the others from it.
        leads = F.col("_first_ord") == F.struct("_current", "_ord")
        rows = rows.withColumn(
            "_gap_us",
            F.when(~leads, F.lit(0).cast("bigint")).otherwise(F.col("_us") - F.col("_last_us")),
        )
    if new_merchant:
        first = F.expr(POSITION) == F.col("_first_pos")
        rows = rows.withColumn("is_new_merchant", first.cast("int"))
    extra = [s.name for s in specs]
    extra += ["_gap_us"] if gap else []
    extra += ["is_new_merchant"] if new_merchant else []
    kept = [c for c in source_columns if c not in extra]
    if "event_ts" not in kept:
        kept.append("event_ts")
    return rows.where("_current = 1").select(*kept, *extra)


# -- the feature-pipeline step and the wider notebook-style builders ---------------


def pipeline_history(
    df: DataFrame,
    lookback: DataFrame | None = None,
    order_col: str | None = "row_key",
    hot_rows: int | None = None,
) -> DataFrame:
    """Account velocity, amounts, gap and new-merchant flag: the history step of the pipeline."""
    df = df.withColumn(
        "transactionAmount", F.coalesce(to_number(F.col("transactionAmount")), F.lit(0.0))
    )
    out = history_features(
        df,
        "accountNumber",
        PIPELINE_SPECS,
        lookback=lookback,
        gap=True,
        new_merchant=True,
        order_col=order_col,
        hot_rows=hot_rows,
    )
    gap_seconds = F.greatest(F.coalesce(F.col("_gap_us") / 1e6, F.lit(0.0)), F.lit(0.0))
    return out.withColumn("seconds_since_last_txn", gap_seconds).drop("_gap_us")


def no_history(df: DataFrame, lookback: DataFrame | None = None) -> DataFrame:
    """The history step for rows that are each scored on their own: the values of a first transaction."""
    kinds = {"velocity": F.lit(0).cast("bigint")}
    return df.withColumns(
        {
            "transactionAmount": F.coalesce(to_number(F.col("transactionAmount")), F.lit(0.0)),
            **{s.name: kinds.get(s.kind, F.lit(0.0)) for s in PIPELINE_SPECS},
            "is_new_merchant": F.lit(1),
            "seconds_since_last_txn": F.lit(0.0),
        }
    )


def parametric_specs(kind: str, entity: str, windows: Sequence[str] = DEFAULT_WINDOWS) -> list[Spec]:
    if kind not in KINDS:
        raise ValueError(f"unknown history kind {kind!r}; expected one of {KINDS}")
    return [Spec(f"{kind}_{entity}_{w}", kind, w) for w in windows]


def parametric_history(
    df: DataFrame,
    entity: str,
    kinds: str | Sequence[str],
    windows: Sequence[str] = DEFAULT_WINDOWS,
    **options,
) -> DataFrame:
    """``{kind}_{entity}_{window}`` columns; all kinds share one exchange and sort."""
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    specs = [s for kind in kinds for s in parametric_specs(kind, entity, windows)]
    return history_features(df.where(F.col(entity).isNotNull()), entity, specs, **options)


def split_aware_history(
    train: DataFrame,
    test: DataFrame,
    entity: str,
    kinds: Sequence[str],
    windows: Sequence[str],
    **options,
) -> DataFrame:
    """Label history without leakage, tagged ``is_test``: train sees train, test sees both.

    Each side is windowed on its own, so this holds even when the two overlap in time.
    """
    specs = [s for kind in kinds for s in parametric_specs(kind, entity, windows)]
    known = F.col(entity).isNotNull()
    seen = history_features(train.where(known), entity, specs, **options).withColumn("is_test", F.lit(0))
    ahead = history_features(
        test.where(known), entity, specs, lookback=train.where(known), **options
    ).withColumn("is_test", F.lit(1))
    return seen.unionByName(ahead, allowMissingColumns=True)


def gap_features(
    df: DataFrame, entity: str = "accountNumber", order_col: str | None = "row_key", hot_rows: int | None = None
) -> DataFrame:
    """Gap to the entity's previous row in µs (``_gap_us``), null on its first row."""
    return history_features(df, entity, (), gap=True, order_col=order_col, hot_rows=hot_rows)


def recency_days(df: DataFrame, entity: str = "accountNumber", **options) -> DataFrame:
    """Whole days since the entity's last row; first rows take the exact median."""
    days = gap_features(df, entity, **options).withColumn(
        "_days", floor_div(F.col("_gap_us"), UNITS["d"])
    )
    median = days.select(F.percentile("_days", F.lit(0.5))).scalar()
    return days.withColumn(
        "days_since_last_txn", F.coalesce(F.col("_days").cast("double"), median)
    ).drop("_days", "_gap_us")


def burst_features(df: DataFrame, entity: str = "accountNumber", **options) -> DataFrame:
    """Seconds since the entity's last row (99999 on the first) and the under-five-minutes flag."""
    out = gap_features(df, entity, **options)
    seconds = F.coalesce(F.col("_gap_us") / 1e6, F.lit(99999.0))
    return out.withColumns(
        {"time_since_last_txn_sec": seconds, "is_burst": (seconds < 300).cast("int")}
    ).drop("_gap_us")


def merchant_rank(
    df: DataFrame,
    entity: str = "accountNumber",
    merchant: str = "merchantName",
    order_col: str | None = "row_key",
    hot_rows: int | None = None,
) -> DataFrame:
    """0-based visit number per (entity, merchant) and the first-visit flag."""
    rows = with_event_time(df)
    rows = rows.withColumns({"_us": micros(F.col("event_ts")), "_ord": row_order(rows, order_col)})
    limit = hot_key_rows(df.sparkSession, hot_rows)
    pair = [entity, merchant]

    def direct(part: DataFrame) -> DataFrame:
        visits = Window.partitionBy(*pair).orderBy("_us", "_ord")
        return part.withColumn("merchant_txn_rank", F.row_number().over(visits).cast("bigint") - 1)

    hot = hot_keys(rows, pair, limit)
    if hot is None:
        rows = direct(rows)
    else:
        cold, heavy = split_hot(rows, pair, hot)
        rows = direct(cold).unionByName(_hot_rank(heavy, pair, hot.chunks))
    return rows.withColumn(
        "is_new_merchant_flag", (F.col("merchant_txn_rank") == 0).cast("int")
    ).drop("_us", "_ord")


def _hot_rank(rows: DataFrame, pair: list[str], chunks: int) -> DataFrame:
    """Rank = rows at earlier times (scan over times) + rank among equal times (scan over row order)."""
    points = checkpointed(rows.groupBy(*pair, "_us").agg(F.count(F.lit(1)).alias("_n")))
    earlier = segmented_scan(
        points, pair, "_us", {"_before": "_n"}, edges=fixed_edges(points, "_us", chunks), before=True
    ).select(*[F.col(c).alias(f"_pt_{c}") for c in pair], F.col("_us").alias("_pt_us"), "_before")
    tied = segmented_scan(
        rows.withColumn("_one", F.lit(1).cast("bigint")),
        [*pair, "_us"],
        "_ord",
        {"_tie_rank": "_one"},
        edges=fixed_edges(rows, "_ord", chunks),
        before=True,
    )
    match = _same([("_us", "_pt_us"), *[(c, f"_pt_{c}") for c in pair]])
    return (
        tied.join(earlier, match)
        .withColumn("merchant_txn_rank", (F.col("_before") + F.col("_tie_rank")).cast("bigint"))
        .drop("_one", "_tie_rank", "_before", "_pt_us", *[f"_pt_{c}" for c in pair])
    )


def amount_zscore(
    df: DataFrame, entity: str = "merchantName", window: str = "30D", **options
) -> DataFrame:
    """Amount against the entity's trailing mean and deviation; no spread gives 0, clipped to ±10."""
    specs = [Spec("_mean", "amount_mean", window), Spec("_std", "amount_std", window)]
    out = history_features(df, entity, specs, **options)
    score = (F.col("transactionAmount") - F.col("_mean")) / F.nullif(F.col("_std"), F.lit(0.0))
    clipped = F.greatest(F.least(F.coalesce(score, F.lit(0.0)), F.lit(10.0)), F.lit(-10.0))
    return out.withColumn("amount_zscore", clipped).drop("_mean", "_std")


def retain_recent(history: DataFrame, current: DataFrame, days: int = 30) -> DataFrame:
    """History plus current rows no older than ``days`` before the newest current row.

    When no current row has a readable time, everything is kept.
    """
    newest = with_event_time(current).select(F.max("event_ts")).scalar()
    rows = with_event_time(history).unionByName(with_event_time(current), allowMissingColumns=True)
    cutoff = newest - F.expr(f"INTERVAL {int(days)} DAYS")
    return rows.where(cutoff.isNull() | (F.col("event_ts") >= cutoff))
