"""Class balancing: synthetic minority rows and removal of borderline majority rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.scalars import label
from ledgerlens.operators.neighbors import BLOCK_ROWS, Index, nearest, vectors
from ledgerlens.operators.scan import chunk_count, fixed_edges, segmented_scan
from ledgerlens.session import checkpointed


def _is_fraud():
    return label(F.col("isFraud")) == 1


def _placed(rows: DataFrame, wanted: int, fraud: int, seed: int) -> DataFrame:
    """Add ``_at``, the place in hash order from 1, and ``_copies``, how many synthetic rows start from the row.

    wanted = each × fraud + rest: the first ``rest`` rows give one copy more.
    """
    each, rest = divmod(wanted, fraud)
    hashed = rows.withColumns({"_h": F.xxhash64("id", F.lit(seed)), "_one": F.lit(1).cast("bigint")})
    placed = segmented_scan(hashed, [], "_h", {"_at": "_one"}, edges=fixed_edges(hashed, "_h", chunk_count(rows)))
    return placed.withColumn("_copies", F.lit(each) + (F.col("_at") <= rest).cast("int")).drop("_h", "_one")


def _drawn(placed: DataFrame, k: int, seed: int) -> DataFrame:
    """One row per copy, with the rank of its neighbour and the share ``_u`` of the way to it."""
    copy = F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy")
    return placed.where("_copies > 0").select("*", copy).withColumns(
        {
            "rank": (1 + F.pmod(F.xxhash64("id", "copy", F.lit(seed + 1)), F.lit(k))).cast("int"),
            "_u": F.pmod(F.xxhash64("id", "copy", F.lit(seed + 2)), F.lit(1 << 30)) / F.lit(float(1 << 30)),
        }
    )


def smote(
    df: DataFrame,
    columns: Sequence[str],
    ratio: float = 1.0,
    k: int = 5,
    seed: int = 42,
    key: str = "row_key",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Synthetic fraud rows that bring fraud:legit up to ``ratio``.

    Each lies between a fraud row and one of its k nearest fraud neighbours. Columns: the base row's
    key, the copy number, and the interpolated ``columns``.
    """
    columns = list(columns)
    fraud, legit = df.agg(F.count_if(_is_fraud()), F.count_if(~_is_fraud())).first()
    wanted, k = max(0, int(ratio * legit) - fraud), min(k, fraud - 1)
    rows = checkpointed(vectors(df.where(_is_fraud()), columns, key))
    if k < 1 or wanted == 0:
        return rows.where(F.lit(False)).select(
            F.col("id").alias(key), F.lit(0).alias("copy"), *[F.col("x")[i].alias(c) for i, c in enumerate(columns)]
        )
    near = nearest(rows, rows, k, block_rows).select("id", "neighbor", "rank")
    bases = _drawn(_placed(rows, wanted, fraud, seed), k, seed)
    others = rows.select(F.col("id").alias("neighbor"), F.col("x").alias("_to"))
    moved = bases.join(near, ["id", "rank"]).join(others, "neighbor")
    return moved.select(
        F.col("id").alias(key),
        "copy",
        *[
            (F.col("x")[i] + F.col("_u") * (F.col("_to")[i] - F.col("x")[i])).alias(c)
            for i, c in enumerate(columns)
        ],
    )


def smote_table(
    df: DataFrame,
    columns: Sequence[str],
    categories: Sequence[str] = (),
    ratio: float = 1.0,
    k: int = 5,
    seed: int = 42,
    key: str = "row_key",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``df`` with synthetic fraud rows below it that bring fraud:legit up to ``ratio``; ``synthetic`` is 1 for these.

    Numbers (``columns``) are those of ``smote``: between a fraud row and one of its k nearest fraud rows by these
    columns, rounded where the type is integral; where one of the two has none, the other's. Each of ``categories``
    takes the value that most of the k neighbours have, null among them, and the nearest one's among equals. Keys
    must be unique whole numbers and go on after the largest. The label is set, all other columns are null.
    """
    if "synthetic" in df.columns:
        raise ValueError("the table has a column 'synthetic' already")
    columns, categories = list(columns), list(categories)
    fraud, legit, last = df.agg(F.count_if(_is_fraud()), F.count_if(~_is_fraud()), F.max(F.col(key).cast("bigint"))).first()
    wanted, k = max(0, int(ratio * legit) - fraud), min(k, fraud - 1)
    kept = df.withColumn("synthetic", F.lit(0))
    if k < 1 or wanted == 0:
        return kept

    minority = df.where(_is_fraud())
    rows = vectors(minority, columns, key)
    numbers = [F.col(c).cast("double").alias(f"n{i}") for i, c in enumerate(columns)]
    values = [F.col(c).alias(f"c{i}") for i, c in enumerate(categories)]
    own = minority.select(F.col(key).cast("bigint").alias("id"), F.struct(*numbers).alias("num"), F.struct(F.lit(0).alias("_"), *values).alias("cat"))
    rows, own = checkpointed(rows), checkpointed(own)
    around = nearest(rows, rows, k, block_rows).select("id", "neighbor", "rank")
    others = own.select(F.col("id").alias("neighbor"), F.col("num").alias("num_"), F.col("cat").alias("cat_"))
    # k entries a row, so that copies are made after all joins.
    listed = around.join(others, "neighbor").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "num_", "cat_"))).alias("near"))
    placed = _placed(own.select("id"), wanted, fraud, seed)
    draws = _drawn(placed.join(own, "id").join(listed, "id"), k, seed)
    draws = draws.withColumn("to", F.get("near", F.col("rank") - 1)["num_"])

    types = {f.name: f.dataType for f in df.schema.fields}
    made = {c: _between(F.col("num")[f"n{i}"], F.col("to")[f"n{i}"], types[c]) for i, c in enumerate(columns)}
    made |= {c: _vote(F.col("near"), f"c{i}") for i, c in enumerate(categories)}
    made[key] = (F.lit(last) + (F.col("copy") - 1) * F.lit(fraud) + F.col("_at")).cast(types[key])
    made["isFraud"] = F.lit(1).cast(types["isFraud"])
    synthetic = draws.select(*[v.alias(c) for c, v in made.items()], F.lit(1).alias("synthetic"))
    return kept.unionByName(synthetic, allowMissingColumns=True)


def _between(a: Column, b: Column, kind: T.DataType) -> Column:
    moved = a + F.col("_u") * (b - a)
    moved = F.when(F.abs(moved) < float("inf"), moved).otherwise(F.coalesce(a, b))
    return (F.round(moved) if isinstance(kind, T.IntegralType) else moved).cast(kind)


def _vote(near: Column, field: str) -> Column:
    """The most frequent value of ``field`` in the short list ``near``, the first one among equals."""
    values = F.transform(near, lambda n: n["cat_"][field])
    # The place is unique, so values themselves are never compared for order.
    votes = F.transform(
        values,
        lambda v, i: F.struct(F.size(F.filter(values, lambda w: w.eqNullSafe(v))).alias("n"), (-i).alias("first"), v.alias("v")),
    )
    return F.array_max(votes)["v"]


def smote_tomek(df: DataFrame, columns: Sequence[str], categories: Sequence[str] = (), ratio: float = 0.1, key: str = "row_key", **options) -> DataFrame:
    """``smote_table`` without the majority rows of its Tomek links over ``columns``; ``options`` go to ``smote_table``."""
    table = checkpointed(smote_table(df, columns, categories, ratio, key=key, **options))
    return drop_tomek(table, columns, key, block_rows=options.get("block_rows", BLOCK_ROWS))


def tomek_links(
    df: DataFrame, columns: Sequence[str], key: str = "row_key", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(minority, majority): pairs of opposite labels that are each other's nearest row."""
    rows = checkpointed(vectors(df, columns, key).join(
        df.select(F.col(key).cast("bigint").alias("id"), _is_fraud().alias("_fraud")), "id"
    ))
    points = rows.select("id", "x")
    index = Index.of(points, 1, block_rows)
    ahead = index.nearest(rows.where("_fraud").select("id", "x"))
    legit = rows.where("NOT _fraud").select(F.col("id").alias("neighbor"), "x")
    crossing = checkpointed(ahead.join(legit, "neighbor").select(F.col("id").alias("minority"), F.col("neighbor").alias("majority"), "x"))
    asked = crossing.select(F.col("majority").alias("id"), "x").dropDuplicates(["id"])
    back = index.nearest(asked).select(
        F.col("id").alias("majority"), F.col("neighbor").alias("minority")
    )
    return crossing.select("minority", "majority").join(back, ["minority", "majority"])


def drop_tomek(df: DataFrame, columns: Sequence[str], key: str = "row_key", **options) -> DataFrame:
    """The table without the majority rows of its Tomek links."""
    links = tomek_links(df, columns, key, **options).select(F.col("majority").alias(key)).distinct()
    return df.join(links, key, "left_anti")
