"""Near-duplicate classes with HyperMinHash sketches.

A sketch has ``bands * rows`` buckets. A shingle's hash picks a bucket and a value; the bucket keeps the
smallest value as a count of leading zeros and the ten bits after the first one. Buckets that stay empty
are filled from further hash rounds of the same shingles, so that a register of two sets is the same with
the probability of their Jaccard similarity, for short texts too.

1. Sketches are made in one pass over the texts and written. Equal sets form a class, with the smallest
   doc_id as its representative; only representatives go on.
2. ``rows`` registers at a time are hashed as a band. In every bucket of equal bands the smallest member
   is paired with each other member: pairs grow with the bucket, not with its square.
3. A pair goes on if the similarity estimated from its sketches, corrected for registers that are equal
   by chance, is within five standard errors of the threshold; it is a link if its full sets confirm it.
4. Links give components. In buckets that still hold several components, members of different components
   are compared in square blocks of bounded size, first by their sketches, then by the full sets of
   those with a near partner. So every pair that shares a band is linked, refused, or joined already.

With 44 bands of 7 registers a pair at similarity 0.85 shares no band once in 2.5e7 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import GOLDEN, KeyFilter, Words, byte_chunks, checkpointed, mix, weights
from ledgerlens.llm.components import connected_components

SHINGLE = 5
VALUE_BITS, MANTISSA_BITS = 40, 10
BLOCK = 1024
DEVIATIONS = 5
MOST_MISSED = 1e-4  # share of pairs at the threshold that may have no band in common


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending; empty without words."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes: A-Z only
    for part in byte_chunks([len(t) for t in raw]):
        words = Words(raw[part])
        shingles = words.windows(SHINGLE, range(SHINGLE), salt=1)
        for start, stop in zip(words.bounds[:-1], words.bounds[1:]):
            n = stop - start
            if n >= SHINGLE:
                yield np.unique(shingles[start : stop - SHINGLE + 1])
            elif n:
                whole = (words.hashes[start:stop] * weights(n, salt=1)).sum(dtype=np.uint64)
                yield mix(np.array([whole]) + np.array([n], np.uint64) * GOLDEN)
            else:
                yield np.empty(0, np.uint64)


def set_name(shingles: np.ndarray, salt: int) -> np.uint64:
    """64 bits that name a set, whatever the order of its members."""
    return mix(shingles + np.array([salt], np.uint64) * GOLDEN).sum(dtype=np.uint64)


def sketch(shingles: np.ndarray, buckets: int) -> np.ndarray:
    """16-bit registers of a non-empty set: leading zeros, then the bits after the first one."""
    best = np.full(buckets, -1, np.int64)
    empty = np.ones(buckets, bool)
    low, shift = np.uint64((1 << VALUE_BITS) - 1), np.uint64(VALUE_BITS)
    first, per_pass = 0, 1
    while empty.any():
        rounds = np.arange(first, first + per_pass, dtype=np.uint64) * GOLDEN
        hashed = mix((shingles[None, :] + rounds[:, None]).ravel())
        bucket = ((hashed >> shift) * np.uint64(buckets)) >> np.uint64(64 - VALUE_BITS)
        kept = np.flatnonzero(empty[bucket])
        keys = (bucket[kept] << shift) | (hashed[kept] & low)
        turn = kept // len(shingles)  # an earlier round goes first
        order = np.lexsort((keys, turn)) if per_pass > 1 else np.argsort(keys)
        found, at = np.unique(bucket[kept][order], return_index=True)
        best[found] = (keys[order][at] & low).astype(np.int64)
        empty[found] = False
        first += per_pass
        per_pass = max(1, min(64, 2048 // len(shingles)))
    length = np.frexp(best.astype(np.float64))[1].astype(np.int64)  # exact below 2^53
    zeros = VALUE_BITS - length
    mantissa = ((best << (zeros + 1)) >> (VALUE_BITS - MANTISSA_BITS)) & ((1 << MANTISSA_BITS) - 1)
    return ((zeros << MANTISSA_BITS) | mantissa).astype("<u2")


def zero_shares(n: np.ndarray, buckets: int) -> np.ndarray:
    """For sets of ``n`` shingles, the share of registers with each number of leading zeros."""
    zeros = np.arange(VALUE_BITS + 1)[None, :]
    load = np.maximum(np.asarray(n, float) / buckets, 1.0)[:, None]
    return np.exp(-load * 2.0 ** -(zeros + 1)) - np.exp(-load * 2.0**-zeros)


def estimate(equal: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers and the share that is equal by chance."""
    return (equal - chance) / (1 - chance)


def estimate_pairs(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """The estimate for each row of ``left`` and the same row of ``right``."""
    buckets = left.shape[1]
    chance = (zero_shares(n_left, buckets) * zero_shares(n_right, buckets)).sum(axis=1) / (1 << MANTISSA_BITS)
    return estimate((left == right).mean(axis=1), chance)


def _registers(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(len(column), -1)


class NearDuplicates:
    """The steps below one threshold: links where ``100 * shared >= percent * union``."""

    def __init__(self, percent: int, bands: int, rows: int):
        self.percent, self.bands, self.rows = percent, bands, rows
        share = percent / 100
        missed = (1 - share**rows) ** bands
        if missed > MOST_MISSED:
            raise ValueError(f"{bands} bands of {rows} rows miss {missed:.1e} of the pairs at {percent} percent")
        self.least = share - DEVIATIONS * (share * (1 - share) / (bands * rows)) ** 0.5

    def sketches(self, docs: DataFrame) -> DataFrame:
        """(id, n, set_a, set_b, registers) of docs (id, text); set_a and set_b name the set. A column sign is kept."""
        buckets = self.bands * self.rows

        def run(batches):
            for batch in batches:
                rows = []
                for found in shingle_sets(batch["text"].tolist()):
                    if not len(found):
                        rows.append((0, 0, 0, b""))
                        continue
                    a, b = np.array([set_name(found, k) for k in (1, 2)], np.uint64).view(np.int64)
                    rows.append((len(found), a, b, sketch(found, buckets).tobytes()))
                out = pd.DataFrame(rows, columns=["n", "set_a", "set_b", "registers"])
                out.insert(0, "id", batch["id"].to_numpy())
                yield out.assign(sign=batch["sign"].to_numpy()) if signed else out

        signed = "sign" in docs.columns
        schema = f"id {docs.schema['id'].dataType.simpleString()}, n bigint, set_a bigint, set_b bigint, registers binary"
        return docs.mapInPandas(run, schema + ", sign bigint" * signed)

    def band_rows(self, sketches: DataFrame) -> DataFrame:
        """(band, number, node): one row per node and band; ``number`` is the place of the band."""
        bands, rows = self.bands, self.rows

        def run(batches):
            for batch in batches:
                if not len(batch):
                    continue
                registers = _registers(batch["registers"]).astype(np.uint64) + np.uint64(1)
                cut = registers.reshape(len(batch), bands, rows)
                number = np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN
                keys = mix((mix(cut * weights(rows, salt=2))).sum(axis=2, dtype=np.uint64) + number)
                yield pd.DataFrame(
                    {
                        "band": keys.view(np.int64).ravel(),
                        "number": np.tile(np.arange(bands, dtype=np.int16), len(batch)),
                        "node": np.repeat(batch["node"].to_numpy(), bands),
                    }
                )

        kind = sketches.schema["node"].dataType.simpleString()
        return sketches.select("node", "registers").mapInPandas(run, f"band bigint, number smallint, node {kind}")

    def full_sets(self, texts: DataFrame, wanted: DataFrame, sketches: DataFrame) -> DataFrame:
        """(node, members): the shingle sets of the nodes in ``wanted`` (_w), made again from their texts.

        A bit filter finds them in a pass over the texts, which saves a shuffle of all texts; sets of other
        nodes that it lets through go unused. Of several texts under one id the sketched one counts.
        """
        wanted_keys = KeyFilter(wanted.select(F.xxhash64("_w").alias("key")))

        def sets(batches):
            for batch in batches:
                batch = batch[wanted_keys.passes(batch["_key"].to_numpy())]
                found = list(shingle_sets(batch["text"].tolist()))
                names = np.array([set_name(s, 1) for s in found], np.uint64).view(np.int64)
                yield pd.DataFrame({"node": batch["node"], "name": names, "members": [s.tobytes() for s in found]})

        kind = texts.schema["node"].dataType.simpleString()
        keyed = texts.select("node", "text", F.xxhash64("node").alias("_key"))
        made = keyed.mapInPandas(sets, f"node {kind}, name bigint, members binary")
        own = sketches.select(F.col("node").alias("_n"), F.col("set_a").alias("_name"))
        match = (F.col("node") == F.col("_n")) & (F.col("name") == F.col("_name"))
        return checkpointed(made.join(own, match, "left_semi").drop("name").dropDuplicates(["node"]))

    def confirmed(self, pairs: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
        """The ``pairs`` (a, b) whose estimate lets them through and whose full sets are close enough."""
        percent, least = self.percent, self.least
        kind = sketches.schema["node"].dataType.simpleString()

        def close(batches):
            for batch in batches:
                if len(batch):
                    near = estimate_pairs(
                        _registers(batch["ra"]), _registers(batch["rb"]), batch["na"], batch["nb"]
                    )
                    smaller, larger = np.minimum(batch["na"], batch["nb"]), np.maximum(batch["na"], batch["nb"])
                    ok = (near >= least) & (100 * smaller >= percent * larger).to_numpy()
                    yield batch.loc[ok, ["a", "b"]]

        def check(batches):
            for batch in batches:
                ok = np.zeros(len(batch), bool)
                for i, (x, y) in enumerate(zip(batch["ma"], batch["mb"])):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    ok[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
                yield batch.loc[ok, ["a", "b"]]

        small = sketches.select("node", "n", "registers")
        side = lambda s: small.toDF(f"_{s}", f"n{s}", f"r{s}")
        through = checkpointed(
            pairs.join(side("b"), F.col("b") == F.col("_b"))
            .join(side("a"), F.col("a") == F.col("_a"))
            .select("a", "b", "na", "nb", "ra", "rb")
            .mapInPandas(close, f"a {kind}, b {kind}")
        )
        wanted = through.select(F.col("a").alias("_w")).union(through.select("b")).distinct()
        members = self.full_sets(texts, wanted, sketches)
        full = lambda s: members.toDF(f"_{s}", f"m{s}")
        return (
            through.join(full("b"), F.col("b") == F.col("_b"))
            .join(full("a"), F.col("a") == F.col("_a"))
            .select("a", "b", "ma", "mb")
            .mapInPandas(check, f"a {kind}, b {kind}")
        )

    def across(self, members: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
        """Links (a, b) between different components that share a band; those that join components.

        ``members`` is (band, number, node, component). A bucket of m members is cut into
        k = ceil(m / BLOCK) blocks; every two blocks meet in a task of their own. First the sketches alone
        are compared, and nodes without any near partner leave; the others meet again with their full
        sets. A pair is looked at in the first band it shares only, and not if links found before in the
        task have joined it.
        """
        percent, rows = self.percent, self.rows
        kind = sketches.schema["node"].dataType.simpleString()
        size = members.groupBy(F.col("band").alias("_b")).agg(
            F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_k")
        )
        cut = (
            members.join(checkpointed(size), F.col("band") == F.col("_b"))
            .join(sketches.select(F.col("node").alias("_n"), "n", "registers"), F.col("node") == F.col("_n"))
            .withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_k")).cast("int"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
            .select(
                "band", "number", "node", "component", "n", "registers", "_own",
                F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"),
            )
        )
        least = self.least

        def near(rows_of: dict, a: int, b: int) -> Iterator[tuple[int, np.ndarray]]:
            """(row, rows) of near pairs of different components within rows a to b, each pair once."""
            number, own = int(rows_of["number"][a]), rows_of["_own"][a:b]
            right = a + np.flatnonzero(own == rows_of["_j"][a])
            left = a + np.flatnonzero(own == rows_of["_i"][a])
            same = rows_of["_i"][a] == rows_of["_j"][a]
            registers, shares = rows_of["registers"], rows_of["shares"]
            component, n = rows_of["component"], rows_of["n"]
            for row in left:
                others = right[(component[right] != component[row]) & ((right > row) | (not same))]
                smaller, larger = np.minimum(n[others], n[row]), np.maximum(n[others], n[row])
                others = others[100 * smaller >= percent * larger]
                if not len(others):
                    continue
                equal = registers[others] == registers[row]
                chance = shares[others] @ shares[row] / (1 << MANTISSA_BITS)
                ok = estimate(equal.mean(axis=1), chance) >= least
                others, equal = others[ok], equal[ok]
                if number:
                    before = equal[:, : number * rows].reshape(len(others), number, rows)
                    others = others[~before.all(axis=2).any(axis=1)]
                if len(others):
                    yield row, others

        def arrays(frame: pd.DataFrame) -> tuple[dict, np.ndarray]:
            """The columns as arrays, and where each group begins, with the end."""
            names = ("band", "number", "node", "component", "n", "_own", "_i", "_j")
            rows_of = {c: frame[c].to_numpy() for c in names}
            rows_of["registers"] = _registers(frame["registers"])
            rows_of["shares"] = zero_shares(rows_of["n"], rows_of["registers"].shape[1])
            change = np.zeros(len(frame), bool)
            change[:1] = True
            for c in ("band", "_i", "_j"):
                change[1:] |= rows_of[c][1:] != rows_of[c][:-1]
            return rows_of, np.append(np.flatnonzero(change), len(frame))

        def involved(batches):
            for frame in whole_groups(batches, ("band", "_i", "_j")):
                rows_of, bounds = arrays(frame)
                used = np.zeros(len(frame), bool)
                for a, b in zip(bounds[:-1], bounds[1:]):
                    for row, others in near(rows_of, a, b):
                        used[row] = True
                        used[others] = True
                yield frame[used]

        def check(batches):
            for frame in whole_groups(batches, ("band", "_i", "_j")):
                rows_of, bounds = arrays(frame)
                nodes, component = rows_of["node"], rows_of["component"]
                sets = [np.frombuffer(m, np.uint64) for m in frame["members"]]
                found = []
                for a, b in zip(bounds[:-1], bounds[1:]):
                    joined = {c: c for c in component[a:b]}

                    def top(c):
                        while joined[c] != c:
                            joined[c] = c = joined[joined[c]]
                        return c

                    for row, others in near(rows_of, a, b):
                        for other in others:
                            x, y = top(component[row]), top(component[other])
                            if x == y:
                                continue
                            shared = len(np.intersect1d(sets[row], sets[other], assume_unique=True))
                            if 100 * shared >= percent * (len(sets[row]) + len(sets[other]) - shared):
                                joined[max(x, y)] = min(x, y)
                                found.append((nodes[row], nodes[other]))
                yield pd.DataFrame(found, columns=["a", "b"])

        together = lambda df: df.repartition("band", "_i", "_j").sortWithinPartitions("band", "_i", "_j")
        first = checkpointed(together(cut).mapInPandas(involved, cut.schema))
        full = self.full_sets(texts, first.select(F.col("node").alias("_w")).distinct(), sketches)
        with_sets = first.join(full.toDF("_n", "members"), F.col("node") == F.col("_n")).drop("_n")
        return together(with_sets).mapInPandas(check, f"a {kind}, b {kind}")


def whole_groups(batches: Iterator[pd.DataFrame], keys: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    """The rows of sorted ``batches`` in frames that hold each group of ``keys`` as a whole."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        if held:
            tail, head = held[-1].iloc[-1], batch.iloc[0]
            if any(tail[k] != head[k] for k in keys):
                yield pd.concat(held, ignore_index=True)
                held = []
        change = np.zeros(len(batch), bool)
        for k in keys:
            values = batch[k].to_numpy()
            change[1:] |= values[1:] != values[:-1]
        cuts = np.flatnonzero(change)
        if len(cuts):
            yield pd.concat([*held, batch.iloc[: cuts[-1]]], ignore_index=True)
            held = [batch.iloc[cuts[-1] :]]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    percent: int = 85,
    bands: int = 44,
    rows: int = 7,
    signed: bool = False,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``; other columns are not read.

    With ``signed`` the xxhash64 of the row's text follows as ``sign``, which tells rows of one id apart.

    Words are runs without blanks, A-Z in lower case; a document's set has its distinct five-word
    shingles, or its whole word sequence if it is shorter. Documents are linked where
    ``100 * shared >= percent * union``; ``component_id`` is the smallest id reachable, and the row with
    that id is kept.

    A null or wordless text has no shingles and is linked with nothing. A row without an id is linked
    with nothing either: its component is null and it is kept. Repeated rows with one id share their
    component. Ids are taken to name texts: where one id has several texts, each row keeps its own size and class,
    and of the classes that the id is the smallest member of, one is compared with the rest. An empty table
    gives an empty table.
    """
    steps = NearDuplicates(percent, bands, rows)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketches = checkpointed(steps.sketches(source.withColumn("sign", F.xxhash64("text")) if signed else source))
    real = sketches.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = checkpointed(
        real.groupBy("set_a", "set_b", "n").agg(F.min("id").alias("node")).withColumnsRenamed(
            {"set_a": "_a", "set_b": "_b", "n": "_n"}
        )
    )
    same_set = (F.col("set_a") == F.col("_a")) & (F.col("set_b") == F.col("_b")) & (F.col("n") == F.col("_n"))
    # Joined by the id alone, so that one exchange serves the join and the removal of repeated rows.
    equal = lambda x, y: F.col(x).bitwiseXOR(F.col(y)) == 0
    chosen = checkpointed(
        real.join(classes, F.col("id") == F.col("node"))
        .where(equal("set_a", "_a") & equal("set_b", "_b") & equal("n", "_n"))
        .select("node", "n", "registers", "set_a")
        .dropDuplicates(["node"])
    )
    texts = source.withColumnRenamed("id", "node")
    if source.schema["id"].nullable:
        texts = texts.where(F.col("node").isNotNull())

    members = steps.band_rows(chosen)
    shared = checkpointed(
        members.groupBy(F.col("band").alias("_band"))
        .agg(F.min("node").alias("lead"), F.max("node").alias("_last"))
        .where(F.col("lead") < F.col("_last"))
        .select("_band", "lead")
    )
    crowded = checkpointed(members.join(shared, F.col("band") == F.col("_band")).select("band", "number", "lead", "node"))
    mates = crowded.select(F.col("node").alias("_mate")).distinct()
    chosen = checkpointed(chosen.join(mates, F.col("node") == F.col("_mate"), "left_semi"))
    pairs = (
        crowded.where(F.col("lead") != F.col("node"))
        .select(F.col("lead").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    links = checkpointed(steps.confirmed(pairs, chosen, texts))
    labels = connected_components(links, "a", "b")

    left = labels.toDF("_node", "_label")
    named = crowded.join(left, F.col("node") == F.col("_node"), "left").select(
        "band", "number", "node", F.coalesce("_label", "node").alias("component")
    )
    named = checkpointed(named)
    mixed = checkpointed(
        named.groupBy(F.col("band").alias("_band"))
        .agg(F.min("component").alias("_x"), F.max("component").alias("_y"))
        .where(F.col("_x") != F.col("_y"))
        .select("_band")
    )
    open_rows = checkpointed(named.join(mixed, F.col("band") == F.col("_band"), "left_semi"))
    more = checkpointed(steps.across(open_rows, chosen, texts))
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more), "a", "b")
    labels = labels.toDF("_node", "_label")

    result = checkpointed(
        classes.join(labels, F.col("node") == F.col("_node"), "left").select(
            "_a", "_b", "_n", F.coalesce("_label", "node").alias("_component")
        )
    )
    usable = F.col("id").isNotNull() & (F.col("n") > 0)
    spread = sketches.select(
        "id",
        "n",
        F.when(usable, F.col("set_a")).otherwise(F.xxhash64("id", "n")).alias("set_a"),
        F.when(usable, F.col("set_b")).otherwise(F.lit(None)).alias("set_b"),
        *(["sign"] if signed else []),
    )
    component = F.coalesce("_component", "id")
    return spread.join(result, same_set, "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
        *(["sign"] if signed else []),
    )
