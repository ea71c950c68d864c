"""Model inputs: one-hot categories with rare values pooled, median-imputed numbers, one vector.

The vocabulary is a table joined by value, not a list on the driver, so a category with very many
values is handled like any other join; one with few is broadcast by its measured size. Only the slot
count and the size of each category reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.lookup import left_lookup, part_bytes
from ledgerlens.operators.scan import chunk_count, sampled_edges, segmented_scan
from ledgerlens.schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from ledgerlens.session import checkpointed

MIN_COUNT = 10


@dataclass
class Preprocessor:
    categorical: list[str]
    numeric: list[str]
    vocabulary: DataFrame  # feature, value, slot
    slots: dict[str, int]
    stages: PipelineModel

    @cached_property
    def sizes(self) -> dict[str, int]:
        """Bytes of each category's vocabulary."""
        return part_bytes(self.vocabulary, "feature", "value")

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``features``. Unseen category values give all zeros."""
        for name in self.categorical:
            known = self.vocabulary.where(F.col("feature") == name).select(
                F.col("value").alias("_v"), F.col("slot").alias("_s")
            )
            value = F.coalesce(F.col(name).cast("string"), F.lit("unknown"))
            df = (
                left_lookup(df, known, value == F.col("_v"), self.sizes.get(name, 0))
                .withColumn(f"_ix_{name}", F.coalesce(F.col("_s"), F.lit(self.slots[name])).cast("double"))
                .drop("_v", "_s")
            )
        df = df.withColumns({f"_num_{c}": F.col(c).cast("double") for c in self.numeric})
        out = self.stages.transform(df)
        return out.drop(*[c for c in out.columns if c.startswith(("_ix_", "_oh_", "_num_", "_imp_"))])

    def slices(self) -> list[tuple[str, int, int]]:
        """(feature, start, length) of each input in the vector."""
        spans, at = [], 0
        for name in self.categorical:
            spans.append((name, at, self.slots[name]))
            at += self.slots[name]
        for name in self.numeric:
            spans.append((name, at, 1))
            at += 1
        return spans


def fit_preprocessor(
    train: DataFrame,
    categorical: Sequence[str] = CATEGORICAL_FEATURES,
    numeric: Sequence[str] = NUMERIC_FEATURES,
    min_count: int = MIN_COUNT,
) -> Preprocessor:
    categorical, numeric = list(categorical), list(numeric)
    spark = train.sparkSession
    vocabulary = checkpointed(_vocabulary(train, categorical, min_count))
    slots = dict.fromkeys(categorical, 1)
    for name, last in vocabulary.groupBy("feature").agg(F.max("slot")).collect():
        slots[name] = int(last) + 1

    encoder = OneHotEncoder(
        inputCols=[f"_ix_{c}" for c in categorical],
        outputCols=[f"_oh_{c}" for c in categorical],
        handleInvalid="keep",
        dropLast=True,
    )
    # The highest slot of each category fixes the vector size.
    sizes = spark.createDataFrame(
        [tuple(float(slots[c] - 1) for c in categorical)], [f"_ix_{c}" for c in categorical]
    )
    numbers = train.select(*[F.col(c).cast("double").alias(f"_num_{c}") for c in numeric])
    imputer = Imputer(
        strategy="median",
        inputCols=[f"_num_{c}" for c in numeric],
        outputCols=[f"_imp_{c}" for c in numeric],
    )
    assembler = VectorAssembler(
        inputCols=[f"_oh_{c}" for c in categorical] + [f"_imp_{c}" for c in numeric],
        outputCol="features",
        handleInvalid="keep",
    )
    stages = PipelineModel([encoder.fit(sizes), imputer.fit(numbers), assembler])
    return Preprocessor(categorical, numeric, vocabulary, slots, stages)


def _vocabulary(train: DataFrame, categorical: Sequence[str], min_count: int) -> DataFrame:
    """Frequent values get their own slot in sorted order; rare ones share the slot after them."""
    long = train.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in categorical]
    ).unpivot([], list(categorical), "feature", "value")
    counts = checkpointed(long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    often = counts.withColumn("_often", (F.col("n") >= min_count).cast("bigint"))
    ranked = segmented_scan(
        often,
        ["feature"],
        "value",
        {"_rank": "_often"},
        edges=sampled_edges(counts.select("value").distinct(), "value", chunk_count(train)),
    )
    frequent = counts.where(F.col("n") >= min_count).groupBy("feature").agg(
        F.count(F.lit(1)).alias("_frequent")
    )
    slot = F.when(F.col("_often") == 1, F.col("_rank") - 1).otherwise(
        F.coalesce(F.col("_frequent"), F.lit(0))
    )
    return ranked.join(frequent, "feature", "left").select("feature", "value", slot.alias("slot"))
