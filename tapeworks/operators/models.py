"""Probability models on a fold: imputation and scaling from training rows alone, logistic regression. Boosted trees: ``boosting``."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.layers import DigestError, folder_digest
from .evaluation import preprocessing


def standardized(rows: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with each column's nulls set to the training median, centred, and divided by the population scale; the names
    get a ``z_`` in front. One row a feature comes to the driver."""
    fitted = {r.feature: r for r in preprocessing(train, columns, []).collect()}
    z = {}
    for c in columns:
        r = fitted[c]
        z[f"z_{c}"] = (F.coalesce(F.col(c).cast("double"), F.lit(r.median or 0.0)) - F.lit(r.mean)) / F.lit(r.scale)
    return rows.withColumns(z)


def fit_logistic(train: DataFrame, columns: list[str], c: float = 1.0, most: int = 1000) -> PipelineModel:
    """L2-regularised logistic regression with inverse strength ``c`` on standardised columns; running out of iterations is an
    error."""
    n = train.count()
    model = Pipeline(stages=[
        VectorAssembler(inputCols=[f"z_{x}" for x in columns], outputCol="x"),
        LogisticRegression(featuresCol="x", labelCol="target_up_15m", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=most, tol=1e-10),
    ]).fit(train)
    if model.stages[-1].summary.totalIterations >= most:
        raise RuntimeError("the logistic regression did not converge")
    return model


def probabilities(model: PipelineModel, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the model's probability of up as ``name``."""
    out = model.transform(rows).withColumn(name, vector_to_array("probability")[1])
    return out.select(*rows.columns, name)


def coefficients(model: PipelineModel, columns: list[str]) -> list[tuple[str, float]]:
    fitted = model.stages[-1]
    return [("intercept", float(fitted.intercept)), *zip(columns, map(float, fitted.coefficients), strict=True)]


def replay(path: str, rows: DataFrame, name: str, digest: str | None = None) -> DataFrame:
    """A saved model's probabilities. With ``digest``, that of the folder when it was saved (``layers.folder_digest``), a folder
    that has changed since is refused before anything of it is loaded."""
    if digest is not None and (found := folder_digest(rows.sparkSession, path)) != digest:
        raise DigestError(f"{path} has digest {found}, not {digest}")
    return probabilities(PipelineModel.load(path), rows, name)
