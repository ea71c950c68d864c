"""Why a row scored as it did: contributions, local surrogates, and reason lists.

Contribution tables are long: (key, feature, label, value, method, direction).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import heuristic_reasons

TOP_FEATURES = 5
SCORE = "fraud_probability"
CONTRIBUTION = ["feature", "label", "value", "method", "direction"]


def _long(df: DataFrame, key: str, values: Mapping[str, Column], method: str) -> DataFrame:
    """One row per (key, feature); rows of a non-finite value are dropped."""
    items = F.array(
        *[F.struct(F.lit(n).alias("feature"), v.cast("double").alias("value")) for n, v in values.items()]
    )
    return _directed(df.select(key, F.inline(items)), F.col("feature"), method)


def _directed(df: DataFrame, text: Column, method: str) -> DataFrame:
    fine = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    return df.where(fine).withColumns(
        {
            "label": text,
            "method": F.lit(method),
            "direction": F.when(F.col("value") > 0, "fraud").otherwise("legit"),
        }
    )


def linear_contributions(
    df: DataFrame, weights: Mapping[str, float], means: Mapping[str, float | Column], key: str = "row_key"
) -> DataFrame:
    """Exact contributions of a linear score: weight × (value − mean)."""
    parts = {c: (F.col(c).cast("double") - means[c]) * w for c, w in weights.items()}
    return _long(df, key, parts, "linear")


def model_linear_contributions(
    model: Any, df: DataFrame, background: DataFrame, key: str = "row_key"
) -> DataFrame:
    """Contributions of a fitted linear model's inputs, one-hot slots summed per feature.

    The model vector is compared with its mean over the background rows.
    """
    p = model.preprocessor
    mean = p.transform(background).select(Summarizer.mean(F.col("features"))).first()[0].toArray()
    weights = model.classifier.coefficients.toArray()
    x = vector_to_array("features")
    ready = p.transform(df).withColumn("_x", x)
    values = {}
    for name, start, length in p.slices():
        terms = [(F.col("_x")[i] - float(mean[i])) * float(weights[i]) for i in range(start, start + length)]
        if length > 16:
            w = F.array(*[F.lit(float(v)) for v in weights[start : start + length]])
            m = float((weights[start : start + length] * mean[start : start + length]).sum())
            products = F.zip_with(F.slice("_x", start + 1, length), w, lambda a, b: a * b)
            values[name] = F.aggregate(products, F.lit(0.0), lambda t, v: t + v) - m
        else:
            values[name] = sum(terms[1:], terms[0])
    return _long(ready, key, values, "linear")


def sampled_contributions(
    model: Any,
    df: DataFrame,
    background: DataFrame,
    features: Sequence[str],
    key: str = "row_key",
) -> DataFrame:
    """Score minus the mean score with one feature taken from each background row.

    ``background`` is the bounded sample kept with a model. Variants of tree models are scored next to their row
    (:mod:`ledgerlens.operators.tree_variants`); for other models, rows × features × background variants go through
    the model in one distributed pass. Meant for the rows being explained, such as alerts.
    """
    features = list(features)
    trees = _tree_variants(model, background, features)
    if trees is not None:
        rows = trees.means(df.withColumnRenamed(SCORE, "_base"), key, "_base")
        means = rows.groupBy(key, "feature").agg((F.first("_base") - F.avg("mean")).alias("value"))
        return _directed(means, F.col("feature"), "shap")
    sample = background.select(F.collect_list(F.struct(*features))).scalar()
    which = F.array(*map(F.lit, features))
    variants = (
        df.select(key, F.col(SCORE).alias("_base"), *_inputs(model))
        .withColumn("feature", F.explode(which))
        .withColumn("_other", F.explode(sample))
    )
    swapped = {
        c: F.when(F.col("feature") == c, F.col(f"_other.{c}")).otherwise(F.col(c)) for c in features
    }
    rescored = model.transform(variants.withColumns(swapped), "_p")
    means = rescored.groupBy(key, "feature").agg((F.first("_base") - F.avg("_p")).alias("value"))
    return _directed(means, F.col("feature"), "shap")


def _tree_variants(model: Any, background: DataFrame, features: list[str]):
    from ledgerlens.operators.tree_variants import TreeVariants  # which imports this module

    return TreeVariants.of(model, background, features)


def _inputs(model: Any) -> list[str]:
    return [*model.preprocessor.categorical, *model.preprocessor.numeric]


def local_surrogate(
    model: Any,
    df: DataFrame,
    background: DataFrame,
    features: Sequence[str],
    key: str = "row_key",
    samples: int = 200,
    seed: int = 42,
    top: int = TOP_FEATURES,
) -> DataFrame:
    """Weighted linear fit around each row; its largest coefficients are the explanation.

    Every row gets ``samples`` perturbed copies that mix in values of seeded background rows. Copies are scored
    together, those of tree models next to their row; each row's fixed-size group is then fitted on its own.
    """
    features = list(features)

    def draw(name: str) -> Column:
        return F.pmod(F.xxhash64(key, "_i", F.lit(name), F.lit(seed)), F.lit(1 << 20))

    def moved(name: str) -> Column:
        # The first copy is the row itself; elsewhere each feature is replaced with even odds.
        return ((F.col("_i") > 0) & (F.pmod(draw(name), F.lit(2)) == 0)).cast("int")

    def strongest(z: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = ridge(1.0 - z, score)
        order = np.argsort(-np.abs(weights), kind="stable")[:top]
        return order, weights[order]

    trees = _tree_variants(model, background, features)
    if trees is not None:
        # Few rows give much work: their parts are not to be merged by size.
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = trees.vectors(df, key).repartition(parts, key).groupBy(key).agg(F.collect_list("_x").alias("_rows"))
        copies = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        size = len(trees.explainer.background)
        bits = [F.shiftleft(moved(c).cast("bigint"), i % 62) for i, c in enumerate(features)]
        sets = [reduce(Column.bitwiseOR, bits[i : i + 62]).alias(f"_z{i // 62}") for i in range(0, len(bits), 62)]
        pick = F.pmod(draw("row"), F.lit(size).cast("bigint")).cast("int").alias("_pick")
        copies = copies.select(key, "_i", F.when(F.col("_i") == 0, F.col("_rows")).alias("_rows"), pick, *sets)
        return _directed(trees.perturbed(copies, key, samples, strongest), F.concat(F.col("feature"), F.lit(" kept")), "lime")

    sample = background.select(F.collect_list(F.struct(*features))).scalar()
    copies = (
        df.select(key, *_inputs(model))
        .withColumn("_bg", sample)
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    )

    pick = F.element_at("_bg", (F.pmod(draw("row"), F.size("_bg").cast("bigint")) + 1).cast("int"))
    copies = copies.withColumn("_other", pick).drop("_bg")
    copies = copies.withColumns({f"_z_{c}": moved(c) for c in features})
    copies = copies.withColumns(
        {c: F.when(F.col(f"_z_{c}") == 1, F.col(f"_other.{c}")).otherwise(F.col(c)) for c in features}
    )
    scored = model.transform(copies, "_p").select(
        key, "_p", F.array(*[F.col(f"_z_{c}") for c in features]).alias("_z")
    )

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        order, weights = strongest(np.stack(group["_z"].to_numpy()), group["_p"].to_numpy())
        return pd.DataFrame(
            {
                key: group[key].iloc[0],
                "feature": [features[i] for i in order],
                "value": weights,
            }
        )

    kind = dict(df.dtypes)[key]
    fitted = scored.groupBy(key).applyInPandas(fit, f"{key} {kind}, feature string, value double")
    return _directed(fitted, F.concat(F.col("feature"), F.lit(" kept")), "lime")


def ridge(kept: np.ndarray, score: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Ridge coefficients, copies closer to the original row weighing more."""
    distance = 1.0 - kept.mean(axis=1)
    weight = np.exp(-(distance**2) / 0.25)
    x = kept - np.average(kept, axis=0, weights=weight)
    y = score - np.average(score, weights=weight)
    gram = (x * weight[:, None]).T @ x + strength * np.eye(x.shape[1])
    return np.linalg.solve(gram, (x * weight[:, None]).T @ y)


def global_importance(contributions: DataFrame, top: int = 20) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    mean = contributions.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance"))
    return mean.orderBy(F.col("importance").desc(), "feature").limit(top)


def explain_frame(
    scored: DataFrame,
    contributions: DataFrame | None = None,
    key: str = "row_key",
    top: int = TOP_FEATURES,
    max_reasons: int = 3,
) -> DataFrame:
    """Add ``top_reasons``, ``explanation_methods`` and ``feature_contributions`` to scored rows.

    Reasons name the contributions that push toward fraud; without any, the rule reasons apply.
    """
    fields = CONTRIBUTION
    rules = _rule_reasons(max_reasons)
    if contributions is None:
        empty = F.array().cast(
            "array<struct<feature:string,label:string,value:double,method:string,direction:string>>"
        )
        return scored.withColumns(
            {
                "top_reasons": rules,
                "explanation_methods": F.array(F.lit("heuristic")),
                "feature_contributions": empty,
            }
        )
    # A row has at most a few contributions per model feature.
    ranked = F.sort_array(
        F.collect_list(F.struct((-F.abs("value")).alias("size"), *[F.col(c) for c in fields]))
    )
    lists = contributions.groupBy(key).agg(F.slice(ranked, 1, top).alias("_top"))
    return explain_attached(scored.join(lists, key, "left"), max_reasons)


def _rule_reasons(max_reasons: int) -> Column:
    return heuristic_reasons(F.least(F.greatest(F.col(SCORE), F.lit(0.0)), F.lit(1.0)), max_reasons)


def explain_attached(scored: DataFrame, max_reasons: int = 3) -> DataFrame:
    """The columns of :func:`explain_frame` for rows that hold their largest contributions in ``_top``, in order."""
    fields, rules = CONTRIBUTION, _rule_reasons(max_reasons)
    joined = scored.withColumn("_top", F.coalesce("_top", F.array()))
    toward = F.filter("_top", lambda c: c["direction"] == "fraud")
    texts = F.slice(
        F.transform(toward, lambda c: F.concat(c["feature"], F.lit(" pushed score toward fraud"))), 1, max_reasons
    )
    methods = F.array_sort(F.array_distinct(F.transform("_top", lambda c: c["method"])))
    return joined.withColumns(
        {
            "top_reasons": F.when(F.size(texts) > 0, texts).otherwise(rules),
            "explanation_methods": F.when(F.size(methods) > 0, methods).otherwise(
                F.array(F.lit("heuristic"))
            ),
            "feature_contributions": F.transform(
                "_top", lambda c: F.struct(*[c[f].alias(f) for f in fields])
            ),
        }
    ).drop("_top")

