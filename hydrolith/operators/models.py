"""Baselines, skill, champion choice, encoders and classifiers over feature tables, on Spark's own learners."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolith.functions.core import round6

#: Most values of a one-hot vocabulary; a column with more is refused, not cut.
MAX_VOCABULARY = 10_000


def skill(rows: DataFrame, by: list[str], truth: str, model: str, baseline: str) -> DataFrame:
    """Mean absolute errors of model and baseline, and 1 - their ratio; null where the baseline's error is zero."""
    mae = lambda c: F.avg(F.abs(F.col(truth) - F.col(c)))
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), mae(model).alias("m"), mae(baseline).alias("b"))
    return g.select(*by, "n", round6(F.col("m")).alias("mae"), round6(F.col("b")).alias("baseline_mae"), F.when(F.col("b") > 0, F.round(1 - F.col("m") / F.col("b"), 4)).alias("skill"))


def champion(runs: DataFrame, run_id: str, comparable: str, best: list[str]) -> DataFrame:
    """The run of the largest `best` columns, ties to the larger run_id; none unless all runs share one comparable key."""
    rank = F.struct(*best, run_id)
    g = runs.agg(F.max(rank).alias("r"), F.count_distinct(comparable).alias("k"))
    return g.where("k = 1").select(F.col("r")[run_id].alias(run_id), *[F.col("r")[c].alias(c) for c in best])


def fit_vocabulary(train: DataFrame, column: str, most: int = MAX_VOCABULARY) -> list[str]:
    """Sorted distinct values of the training rows; more than `most` are an error."""
    found = train.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(r["v"] for r in found)


def one_hot(column: Column, vocabulary: list[str]) -> Column:
    """Array of 0 and 1 over the vocabulary and, last, a bucket for unknown and null values."""
    at = F.coalesce(F.array_position(F.array(*map(F.lit, vocabulary)).cast("array<string>"), column.cast("string")), F.lit(0))
    place = F.when(at == 0, len(vocabulary) + 1).otherwise(at)
    return F.transform(F.sequence(F.lit(1), F.lit(len(vocabulary) + 1)), lambda k: (k == place).cast("int"))


def _assembled(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="error")


def fit_classifier(train: DataFrame, features: list[str], label: str, kind: str = "logistic", seed: int = 42) -> PipelineModel:
    """Logistic regression (L2), random forest or boosted trees on rows without nulls; one class alone is refused."""
    rows = train.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("_label")).dropna()
    found = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    if set(found) != {0.0, 1.0}:
        raise ValueError("both classes are needed")
    scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)
    common = {"featuresCol": "_x", "labelCol": "_label"}
    learner = {
        "logistic": lambda: LogisticRegression(**common, regParam=1 / sum(found.values()), standardization=False),
        "forest": lambda: RandomForestClassifier(**common, numTrees=50, maxDepth=6, seed=seed),
        "boosted": lambda: GBTClassifier(**common, maxIter=20, maxDepth=3, stepSize=0.1, seed=seed),
    }[kind]()
    assembler = _assembled(features)
    fitted_scaler = scaler.fit(assembler.transform(rows))
    ready = fitted_scaler.transform(assembler.transform(rows))
    return PipelineModel([assembler, fitted_scaler, learner.fit(ready)])


def score(model: PipelineModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """rows without null features, with the score of class 1."""
    ready = rows.dropna(subset=features).withColumns({c: F.col(c).cast("double") for c in features})
    return model.transform(ready).select(*rows.columns, vector_to_array("probability")[1].alias("score"))


def fit_calibration(scored: DataFrame, score_col: str, label: str, method: str = "isotonic", least_positives: int = 10) -> Model:
    """Model that maps scores to calibrated probabilities: isotonic, or a sigmoid of the score. Fewer positives than least_positives are refused."""
    rows = scored.select(F.col(score_col).cast("double").alias("x"), F.col(label).cast("double").alias("label")).dropna()
    if rows.where("label = 1").limit(least_positives).count() < least_positives:
        raise ValueError(f"at least {least_positives} positives are needed")
    if method == "isotonic":
        return IsotonicRegression(featuresCol="x", labelCol="label").fit(rows)
    steps = [VectorAssembler(inputCols=["x"], outputCol="_raw"), LogisticRegression(featuresCol="_raw", labelCol="label", standardization=False)]
    return Pipeline(stages=steps).fit(rows)


def calibrated(model: Model, rows: DataFrame, score_col: str) -> DataFrame:
    """rows that have a score, with its calibrated probability; the curve stays in the model and is applied where the rows are."""
    ready = rows.where(F.col(score_col).isNotNull()).withColumn("x", F.col(score_col).cast("double"))
    out = model.transform(ready)
    value = F.col("prediction") if isinstance(model, IsotonicRegressionModel) else vector_to_array("probability")[1]
    return out.select(*rows.columns, value.alias("calibrated"))


def fit_autoregression(rows: DataFrame, station: str, target: str, lags: list[str]) -> DataFrame:
    """(station, n, coefficients): least squares of the target on its lags and a constant, the last coefficient.

    The normal equations are sums, so a station's rows need nothing but partial aggregates; a station with fewer rows than
    coefficients, or with lags that depend on each other, has null coefficients.
    """
    cols = [F.col(c).cast("double") for c in lags] + [F.lit(1.0)]
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    good = rows.dropna(subset=[target, *lags])
    g = good.groupBy(station).agg(F.count("*").alias("n"), F.array(*[F.sum(cols[i] * cols[j]) for i, j in pairs]).alias("xx"), F.array(*[F.sum(c * F.col(target)) for c in cols]).alias("xy"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, xx, xy in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                m = np.zeros((k, k))
                for (i, j), v in zip(pairs, xx, strict=True):
                    m[i, j] = m[j, i] = v
                out.append(np.linalg.solve(m, xy).tolist() if n >= k and np.linalg.matrix_rank(m) == k else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], [station, "n", "coefficients"])

    return g.mapInArrow(solve, f"`{station}` {dict(g.dtypes)[station]}, n bigint, coefficients array<double>")


def fit_station_regressors(train: DataFrame, station: str, features: list[str], target: str, least_rows: int = 50, most_stations: int = 200, seed: int = 42) -> dict[str, PipelineModel]:
    """A boosted regressor for each station with enough rows; each is fitted by all executors in turn. More stations than most_stations are refused."""
    rows = train.dropna(subset=[target, *features])
    enough = [r[0] for r in rows.groupBy(station).count().where(F.col("count") >= least_rows).orderBy(station).limit(most_stations + 1).collect()]
    if len(enough) > most_stations:
        raise ValueError(f"more than {most_stations} stations")
    learner = GBTRegressor(featuresCol="_raw", labelCol=target, maxIter=20, maxDepth=3, seed=seed)
    return {s: Pipeline(stages=[_assembled(features), learner]).fit(rows.where(F.col(station) == s)) for s in enough}
