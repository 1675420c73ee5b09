"""Linear models by Spark ML. Trees are in boosting, seasonal ARIMA in sarima, trend and seasons in additive."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_columns(df: DataFrame) -> list[str]:
    """What models may see: numbers known at least a horizon ahead."""
    known = {"dayofweek", "day", "month", "weekofyear", "weekend", "days_to_next", "days_since", "snap", "price", "price_ratio", "price_change_7", "promo"}
    return [c for c in df.columns if c in known or c.startswith(("lag_", "rolling_"))]


def _assembled(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="skip").transform(df)


def fit_tweedie(train: DataFrame, cols: list[str], power: float = 1.1):
    data = _assembled(train.withColumn("label", F.col("sales").cast("double")), cols).select("features", "label")
    return GeneralizedLinearRegression(family="tweedie", variancePower=power, linkPower=0.0, regParam=0.01, maxIter=25).fit(data)
