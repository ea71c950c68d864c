"""Prefix scans and order statistics that never sort a whole table in one task.

A running total over a long ordered sequence is cut into range chunks. Chunk edges are quantiles of
the order column (a scalar subquery, so no driver round trip); each chunk is scanned on its own and
the totals of earlier chunks, at most ``MAX_CHUNKS`` rows per segment, are added on top.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ledgerlens.session import checkpointed

MAX_CHUNKS = 512
MOST_EDGES = 4096  # a power of two, above the number of edges of any scan


def chunk_count(df: DataFrame) -> int:
    """As many chunks as the session has shuffle partitions, within 8 … MAX_CHUNKS."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, min(MAX_CHUNKS, wanted))


def quantile_edges(df: DataFrame, order: str, chunks: int) -> Column:
    """Scalar array of ``chunks - 1`` inner quantiles of ``order``."""
    probabilities = F.array(*[F.lit(i / chunks) for i in range(1, chunks)])
    return df.select(
        F.percentile_approx(F.col(order), probabilities, F.lit(10_000)).alias("edges")
    ).scalar()


def fixed_edges(df: DataFrame, order: str, chunks: int) -> Column:
    """The same quantiles computed now and kept as literals (``chunks - 1`` values)."""
    probabilities = F.array(*[F.lit(i / chunks) for i in range(1, chunks)])
    found = df.select(F.percentile_approx(F.col(order), probabilities, F.lit(10_000))).first()[0]
    return F.array(*[F.lit(v).cast(dict(df.dtypes)[order]) for v in sorted(set(found or []))])


def sampled_edges(values: DataFrame, order: str, chunks: int, sample: int = 4096) -> Column:
    """Scalar array of inner edges for any sortable type, from distinct ``values``.

    The sample is the ``sample`` values with the smallest hashes: uniform, repeatable and bounded.
    """
    picked = values.select(order).orderBy(F.xxhash64(order), order).limit(sample)
    ordered = F.sort_array(F.collect_list(order))
    step = F.greatest(F.lit(1), F.floor(F.size("s") / F.lit(chunks)).cast("int"))
    return (
        picked.agg(ordered.alias("s"))
        .select(F.filter(F.col("s"), lambda _, i: (i > 0) & (i % step == 0)).alias("edges"))
        .scalar()
    )


def with_chunk(df: DataFrame, order: str, edges: Column, name: str = "_chunk") -> DataFrame:
    """Add the chunk index: how many of the sorted edges are at or below the value (ties share a chunk).

    Found by halving: a comparison per binary digit and row, not one per edge.
    """
    steps = [MOST_EDGES >> i for i in range(1, MOST_EDGES.bit_length())]

    def further(below: Column, step: Column) -> Column:
        # Beyond the last edge there is null, which is not at or below anything.
        return F.when(F.get(F.col("_edges"), below + step - 1) <= F.col(order), below + step).otherwise(below)

    chunk = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)
    return df.withColumn("_edges", edges).withColumn(name, chunk).drop("_edges")


def segmented_scan(
    df: DataFrame,
    segment: Sequence[str],
    order: str,
    sums: Mapping[str, str] | None = None,
    maxes: Mapping[str, str] | None = None,
    *,
    edges: Column,
    before: bool = False,
    descending: bool = False,
) -> DataFrame:
    """Running sums and maxima per ``segment`` along ``order``.

    ``sums``/``maxes`` map an output column to its input column. ``before=True`` leaves out rows with
    the same order value (integral ``order`` only); otherwise ties are included. Every aggregate
    partial merges, so chunks combine exactly.
    """
    sums, maxes = dict(sums or {}), dict(maxes or {})
    segment = list(segment)
    direction = F.col(order).desc() if descending else F.col(order).asc()
    # Stored, so that the chunk is a plain column: as an expression over the row it is also a join key, and
    # the optimizer would infer a filter with that expression for the side that lacks its input.
    chunked = checkpointed(with_chunk(df, order, edges))

    totals = chunked.groupBy(*segment, "_chunk").agg(
        *[F.sum(src).alias(f"_tot_{out}") for out, src in sums.items()],
        *[F.max(src).alias(f"_tot_{out}") for out, src in maxes.items()],
    )
    chunk_order = F.col("_chunk").desc() if descending else F.col("_chunk").asc()
    # At most MAX_CHUNKS rows per segment.
    earlier = Window.partitionBy(*(segment or [F.lit(0)])).orderBy(chunk_order)
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_seg_{c}") for c in segment],
        F.col("_chunk").alias("_seg_chunk"),
        *[F.sum(f"_tot_{out}").over(earlier).alias(f"_off_{out}") for out in sums],
        *[F.max(f"_tot_{out}").over(earlier).alias(f"_off_{out}") for out in maxes],
    )

    inside = Window.partitionBy(*segment, "_chunk").orderBy(direction)
    inside = inside.rangeBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    scanned = chunked.withColumns(
        {
            **{f"_in_{out}": F.sum(src).over(inside) for out, src in sums.items()},
            **{f"_in_{out}": F.max(src).over(inside) for out, src in maxes.items()},
        }
    )
    match = F.col("_chunk") == F.col("_seg_chunk")
    for name in segment:
        match = match & F.col(name).eqNullSafe(F.col(f"_seg_{name}"))
    joined = scanned.join(offsets, match, "left")

    out = {}
    for name in sums:
        parts = [F.coalesce(F.col(f"{p}_{name}"), F.lit(0)) for p in ("_in", "_off")]
        out[name] = parts[0] + parts[1]
    for name in maxes:
        out[name] = F.greatest(F.col(f"_in_{name}"), F.col(f"_off_{name}"))
    helpers = ["_chunk", "_seg_chunk", *[f"_seg_{c}" for c in segment]]
    helpers += [f"{p}_{name}" for p in ("_in", "_off") for name in out]
    return joined.withColumns(out).drop(*helpers)


def running_total(
    df: DataFrame,
    order: str,
    sums: Mapping[str, str],
    segment: Sequence[str] = (),
    descending: bool = False,
    source: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running sums over a column whose values are unique per segment."""
    edges = quantile_edges(source if source is not None else df, order, chunk_count(df))
    return segmented_scan(df, segment, order, sums, edges=edges, descending=descending)


# -- order statistics ----------------------------------------------------------

GRID = 2048  # buckets of a pass, cut at approximate quantiles
PASSES = 20


class TooManyGroups(ValueError):
    """More groups than a report has."""


@dataclass
class Bracket:
    """Ranks of one group within reach of each other: ``below`` rows come before ``low``, ``rows`` lie in [low, high]."""

    group: Any
    low: Any
    high: Any
    below: int
    rows: int
    ranks: list[int]


@dataclass(frozen=True)
class Found:
    """The row at a rank: its value, how many rows have less, how many the same, and the least tie-breaker of these."""

    value: Any
    before: int
    equal: int
    least: Any


def order_statistics(
    df: DataFrame,
    value: str,
    ranks: Callable[[Any, int], Sequence[int]],
    *,
    by: Column | None = None,
    least: str | None = None,
    stats: Sequence[Column] = (),
    small: int = 200_000,
    buckets: int = GRID,
    max_groups: int | None = None,
) -> tuple[dict[Any, Row], dict[tuple[Any, int], Found]]:
    """Exact values at 0-based ranks of the non-null ``value`` in each group; ``ranks(group, n)`` says which.

    All ranks of all groups are narrowed in the same passes: one for totals and a grid of approximate quantiles, one
    that counts the rows of every bracket between grid points, one that ranks what is left, at most ``small`` rows a
    bracket. Larger brackets get a grid of their own first. Counts are exact, so a poor quantile costs a pass, not the
    result. The driver holds one grid a group: meant for the groups of a report, and ``TooManyGroups`` beyond
    ``max_groups``.

    Also returns the row of each group from the first pass, with ``n`` and ``stats`` (over the values, ``_v``).
    """
    rows = df.select(
        *[(by if by is not None else F.lit(0)).alias("_g"), F.col(value).alias("_v")],
        (F.col(least) if least else F.lit(None).cast("bigint")).alias("_t"),
    )
    known = rows.where("_v IS NOT NULL")
    totals = rows.groupBy("_g").agg(
        F.count("_v").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), _grid(buckets), *stats
    )
    first = totals.collect() if max_groups is None else totals.limit(max_groups + 1).collect()
    if max_groups is not None and len(first) > max_groups:
        raise TooManyGroups(f"more than {max_groups} groups")
    groups = {row["_g"]: row for row in first}
    brackets, grids = [], []
    for g, row in groups.items():
        wanted = sorted(set(ranks(g, row["n"]))) if row["n"] else []
        if wanted and not 0 <= wanted[0] <= wanted[-1] < row["n"]:
            raise ValueError("rank beyond the end of the table")
        if wanted:
            brackets.append(Bracket(g, row["_low"], row["_high"], 0, row["n"], wanted))
            grids.append(row["_grid"])
    for _ in range(PASSES):
        large = [i for i, b in enumerate(brackets) if b.rows > small and b.low < b.high]
        if not large:
            break
        heavy = [brackets[i] for i in large]
        if grids is None:
            found = {row["_b"]: row["_grid"] for row in _marked(known, heavy).groupBy("_b").agg(_grid(buckets)).collect()}
        else:  # the grids of the first pass serve the first cut
            found = {k: grids[i] for k, i in enumerate(large)}
        smaller = _narrowed(known, [(b, found[k]) for k, b in enumerate(heavy)], buckets)
        stuck = sum(b.rows for b in smaller) == sum(b.rows for b in heavy)
        brackets, grids = [b for i, b in enumerate(brackets) if i not in set(large)] + smaller, None
        if stuck:
            break
    return groups, _ranked(known, brackets)


def _grid(buckets: int) -> Column:
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    return F.percentile_approx("_v", shares, F.lit(10_000)).alias("_grid")


def _marked(rows: DataFrame, brackets: Sequence[Bracket]) -> DataFrame:
    """The rows of the brackets with the bracket's number ``_b``; brackets of a group do not overlap."""
    numbers = []
    for i, b in enumerate(brackets):
        inside = F.col("_g").eqNullSafe(F.lit(b.group)) & (F.col("_v") >= F.lit(b.low)) & (F.col("_v") <= F.lit(b.high))
        numbers.append(F.when(inside, F.lit(i)))
    return rows.withColumn("_b", F.coalesce(*numbers)).where("_b IS NOT NULL")


def _narrowed(rows: DataFrame, gridded: Sequence[tuple[Bracket, Sequence]], buckets: int) -> list[Bracket]:
    """Cut every bracket at the grid points next to its ranks, count the parts and keep those that hold a rank."""
    cuts = []
    for b, grid in gridded:
        near = set()
        for rank in b.ranks:
            at = (rank - b.below) * buckets // b.rows - 1  # about (at + 1) / buckets of the rows are up to grid[at]
            near |= {grid[j] for j in (at - 2, at + 2) if 0 <= j < len(grid)}
        cuts.append(sorted(v for v in near if b.low < v < b.high))
    # Parts alternate: the rows between two cuts (even) and the rows equal to a cut (odd).
    parts = []
    for i, points in enumerate(cuts):
        place = sum(((F.col("_v") >= F.lit(v)).cast("int") + (F.col("_v") > F.lit(v)).cast("int") for v in points), F.lit(0))
        parts.append(F.when(F.col("_b") == i, place))
    counted = (
        _marked(rows, [b for b, _ in gridded])
        .groupBy("_b", F.coalesce(*parts).alias("_part"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        .orderBy("_b", "_part")
        .collect()
    )
    out, below = [], {}
    for i, _, n, low, high in counted:
        b = gridded[i][0]
        start = below.get(i, b.below)
        below[i] = start + n
        held = [r for r in b.ranks if start <= r < start + n]
        if held:
            out.append(Bracket(b.group, low, high, start, n, held))
    return out


def _ranked(rows: DataFrame, brackets: Sequence[Bracket]) -> dict[tuple[Any, int], Found]:
    """Equal values are combined, then ranked within their bracket; only the rows at a rank come back."""
    if not brackets:
        return {}
    wanted = [(i, r - b.below) for i, b in enumerate(brackets) for r in b.ranks]
    asked = F.broadcast(rows.sparkSession.createDataFrame(wanted, "_b int, _rank bigint"))  # the ranks asked for
    equal = _marked(rows, brackets).groupBy("_b", "_v").agg(F.count(F.lit(1)).alias("n"), F.min("_t").alias("least"))
    upto = F.sum("n").over(Window.partitionBy("_b").orderBy("_v"))
    ranked = equal.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("n"))
    hits = ranked.join(asked, "_b").where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_upto")))
    out = {}
    for row in hits.collect():
        b = brackets[row["_b"]]
        out[b.group, b.below + row["_rank"]] = Found(row["_v"], b.below + row["_before"], row["n"], row["least"])
    return out


def nth_keys(
    df: DataFrame, order: str, tie: str, ranks: Sequence[int], *, small: int = 200_000, buckets: int = GRID
) -> list[tuple[int, int]]:
    """The rows at the given 0-based ranks by ``(order, tie)``, two integral columns; exact.

    All ranks are found in the same scans by :func:`order_statistics`; the rows that share the time of a cut are then
    selected by tie-breaker, again all at once. Nothing is sorted as a whole.
    """
    _, at = order_statistics(df, order, lambda _, n: ranks, least=tie, small=small, buckets=buckets)
    if any((0, r) not in at for r in ranks):
        raise ValueError("rank beyond the end of the table")
    shared: dict[int, set[int]] = {}
    for r in ranks:
        hit = at[0, r]
        if hit.equal > 1 and r > hit.before:
            shared.setdefault(hit.value, set()).add(r - hit.before)
    ties = {}
    if shared:
        tied = df.where(F.col(order).isin(list(shared)))
        _, ties = order_statistics(tied, tie, lambda g, _: shared[g], by=F.col(order), small=small, buckets=buckets)
    found = []
    for r in ranks:
        hit = at[0, r]
        behind = ties.get((hit.value, r - hit.before))
        found.append((hit.value, behind.value if behind else hit.least))
    return found
