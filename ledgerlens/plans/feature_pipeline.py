"""From raw rows to model-ready features, as one lazy plan."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import features as local
from ledgerlens.functions.quality import REQUIRED, normalize_label, validate
from ledgerlens.operators.encoding import Encoders, encoder_apply, encoder_fit
from ledgerlens.operators.history import pipeline_history
from ledgerlens.operators.split import chrono_flag
from ledgerlens.schema import ENCODED_ENTITIES, sanitize_columns
from ledgerlens.session import checkpointed

Step = Callable[[DataFrame, DataFrame | None], DataFrame]


def row_local(step: Callable[[DataFrame], DataFrame]) -> Step:
    """A step that looks at single rows only."""
    return lambda df, lookback: step(df)


# Steps that read single rows as they come.
ROW_STEPS: list[Step] = [
    row_local(local.temporal),
    row_local(local.account_age),
    row_local(local.amount_ratio),
    row_local(local.risk_flags),
]
DEFAULT_STEPS: list[Step] = [pipeline_history, *ROW_STEPS, row_local(local.normalize_types)]
# What the default steps read of stored rows: validation, label, windows.
LOOKBACK_COLUMNS = [*REQUIRED, "transactionAmount", "transactionDateTime", "event_ts", "row_key", "isFraud"]
# What windows, split and encoders read, beside the label.
READ_LATER = ["row_key", "event_ts", "accountNumber", "merchantName", "transactionAmount", *ENCODED_ENTITIES]


def derive(df: DataFrame, lookback: DataFrame | None = None, steps: Sequence[Step] | None = None) -> DataFrame:
    """Apply the steps in order. Any callable ``(df, lookback) -> df`` can replace or extend them."""
    for step in DEFAULT_STEPS if steps is None else steps:
        df = step(df, lookback)
    return df


@dataclass
class FeaturePipeline:
    label_column: str = "isFraud"
    encoders: Encoders | None = None
    steps: Sequence[Step] = field(default_factory=lambda: list(DEFAULT_STEPS))

    def clean(self, raw: DataFrame) -> DataFrame:
        """Sanitised, validated rows with a 0/1 label."""
        return normalize_label(validate(sanitize_columns(raw)), self.label_column)

    def fit(self, raw: DataFrame) -> FeaturePipeline:
        """Learn the encoders. They need categories and labels only, so no window is computed."""
        self.encoders = encoder_fit(local.normalize_types(self.clean(raw)), target=self.label_column)
        return self

    def transform(self, raw: DataFrame, lookback: DataFrame | None = None) -> DataFrame:
        if self.encoders is None:
            raise ValueError("fit or load the encoders first")
        past = None if lookback is None else self.clean(lookback)
        return encoder_apply(derive(self.clean(raw), past, self.steps), self.encoders)

    def fit_transform(
        self, raw: DataFrame, lookback: DataFrame | None = None, with_class_weights: bool = False
    ) -> DataFrame:
        features = self.fit(raw).transform(raw, lookback)
        if not with_class_weights:
            return features
        weight = F.when(F.col(self.label_column) == 1, self.encoders.fraud_weight).otherwise(1.0)
        return features.withColumn("class_weight", weight)

    def save(self, path: str) -> None:
        spark = self.encoders.rates.sparkSession
        self.encoders.rates.write.mode("overwrite").parquet(f"{path}/rates")
        facts = {
            "label_column": self.label_column,
            "frauds": self.encoders.frauds,
            "rows": self.encoders.rows,
        }
        text = spark.createDataFrame([(json.dumps(facts),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeaturePipeline:
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
        rates = spark.read.parquet(f"{path}/rates")
        return cls(facts["label_column"], Encoders(rates, facts["frauds"], facts["rows"]))


def train_test_features(
    raw: DataFrame, test_days: int = 60, train_ratio: float = 0.8, columns: Sequence[str] | None = None
) -> tuple[DataFrame, FeaturePipeline]:
    """Features of both sides, tagged ``is_test``, and the pipeline fitted on the train side.

    The split is by time and windows only look back, so one window pass over both sides gives train
    rows their own past and test rows the train rows before them. Clean rows are stored, because split, encoders
    and windows read them about ten times and parsing is most of such a pass.

    ``columns`` names the columns that are wanted, beside ``is_test``. Row-local features are then made before the
    clean rows are stored, so that no text but the model's own goes through exchange, sort and windows. Rows must
    have a ``row_key`` for that, which orders ties.
    """
    pipeline = FeaturePipeline()
    rows, steps = pipeline.clean(raw), pipeline.steps
    if columns is not None:
        if "row_key" not in rows.columns:
            raise ValueError("rows without a row_key keep all their columns, whose hash orders ties")
        rows = derive(rows, None, ROW_STEPS)
        kept = {*columns, *READ_LATER, pipeline.label_column}
        rows, steps = rows.select(*[c for c in rows.columns if c in kept]), [s for s in steps if s not in ROW_STEPS]
    both = chrono_flag(checkpointed(rows), test_days, train_ratio)
    train = both.where(F.col("is_test") == 0)
    pipeline.encoders = encoder_fit(local.normalize_types(train), target=pipeline.label_column)
    features = encoder_apply(derive(both, None, steps), pipeline.encoders)
    return features if columns is None else features.select(*columns, "is_test"), pipeline
