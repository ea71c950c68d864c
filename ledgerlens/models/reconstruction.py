"""Reconstruction error: distance of a row to the low-rank subspace of legitimate rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class ReconstructionError:
    columns: list[str]
    stages: PipelineModel

    def transform(self, df: DataFrame, name: str = "reconstruction_error") -> DataFrame:
        """Mean squared error. The components are orthonormal and the input is centred, so the
        residual is the squared length minus the squared length of the projection."""

        def energy(column: str):
            squares = F.transform(vector_to_array(F.col(column)), lambda v: v * v)
            return F.aggregate(squares, F.lit(0.0), lambda total, v: total + v)

        out = self.stages.transform(_inputs(df, self.columns))
        error = F.greatest(energy("_scaled") - energy("_reduced"), F.lit(0.0)) / len(self.columns)
        drop = ["_vector", "_scaled", "_reduced", *[f"_in_{c}" for c in self.columns]]
        return out.withColumn(name, error).drop(*drop)


def _inputs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns(
        {f"_in_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    )


def fit_reconstruction(
    df: DataFrame, columns: Sequence[str], rank: int = 8, legit_only: bool = True
) -> ReconstructionError:
    columns = list(columns)
    train = df.where(F.coalesce(F.col("isFraud").cast("int"), F.lit(0)) == 0) if legit_only else df
    stages = Pipeline(
        stages=[
            VectorAssembler(inputCols=[f"_in_{c}" for c in columns], outputCol="_vector"),
            StandardScaler(withMean=True, withStd=True, inputCol="_vector", outputCol="_scaled"),
            PCA(k=min(rank, len(columns)), inputCol="_scaled", outputCol="_reduced"),
        ]
    )
    return ReconstructionError(columns, stages.fit(_inputs(train, columns)))
