"""Accuracy and decision metrics over forecast rows (actual, forecast)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import bias, div, mape, pinball, wmape


def scorecard(rows: DataFrame, by: list[str], q: float = 0.5) -> DataFrame:
    return rows.groupBy(*by).agg(wmape("actual", "forecast").alias("wmape"), mape("actual", "forecast").alias("mape"), pinball("actual", "forecast", q).alias("pinball"), bias("actual", "forecast").alias("bias"), F.count("*").alias("n"))


def window_sums(rows: DataFrame, days: int | Column, length: int, values: list[str], by: list[str], index: str = "step") -> DataFrame:
    """Sums over consecutive windows of `days`; index counts from 1; an incomplete last window is dropped."""
    d = F.lit(days) if isinstance(days, int) else days
    w = F.floor((F.col(index) - 1) / d)
    return rows.where(w < F.floor(F.lit(length) / d)).groupBy(*by, w.alias("window")).agg(*(F.sum(v).alias(v) for v in values))


def wmape_bias(rows: DataFrame, by: list[str]) -> DataFrame:
    """NULL where there were no sales."""
    return rows.groupBy(*by).agg(wmape("actual", "forecast", None).alias("wmape"), bias("actual", "forecast", None).alias("bias"), F.sum("actual").alias("units"))


def naive_scale(panel: DataFrame) -> DataFrame:
    """Mean squared day-to-day change since the first sale of each series."""
    s = W.partitionBy("series_id").orderBy("date")
    p = panel.select("series_id", F.max(F.col("sales") > 0).over(s.rowsBetween(W.unboundedPreceding, 0)).alias("started"), (F.lead("sales").over(s) - F.col("sales")).alias("step"))
    return p.where("started and step is not null").groupBy("series_id").agg(F.avg(F.col("step") * F.col("step")).alias("scale"))


def mad_scale(panel: DataFrame, floor: float = 0.1, days: int = 56) -> DataFrame:
    """Mean absolute weekly change over the last days of the panel, at least `floor`."""
    s = W.partitionBy("series_id").orderBy("date")
    last = F.max("date").over(W.partitionBy("series_id"))
    p = panel.select("series_id", "date", F.abs(F.col("sales") - F.lag("sales", 7).over(s)).alias("change"), last.alias("last"))
    return p.where(F.col("date") > F.date_sub("last", days)).groupBy("series_id").agg(F.greatest(F.avg("change"), F.lit(floor)).alias("scale"))


def wrmsse(rows: DataFrame, scales: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """Weighted root mean squared scaled error; series without a positive scale are left out and the others' weights made to sum to one."""
    e = rows.groupBy(*by, "series_id").agg(F.avg((F.col("actual") - F.col("forecast")) ** 2).alias("mse"))
    j = e.join(scales.where("scale > 0"), "series_id").join(weights, "series_id")
    return j.groupBy(*by).agg(div(F.sum(F.col("weight") * F.sqrt(F.col("mse") / F.col("scale"))), F.sum("weight")).alias("wrmsse"))


def tracking_signal(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean error over its standard error; 0 where errors do not vary. Also the means."""
    e = F.col("actual") - F.col("forecast")
    sd, n = F.stddev_samp(e), F.count("*")
    signal = F.when(sd > 0, F.avg(e) * F.sqrt(n) / sd).otherwise(0.0)
    return rows.groupBy(*by).agg(F.coalesce(signal, F.lit(0.0)).alias("tracking_signal"), F.avg(e).alias("per_week"), F.avg("actual").alias("mean_actual"), F.avg("forecast").alias("mean_forecast"))


def bias_exceptions(signals: DataFrame, prices: DataFrame, threshold: float = 4.0, top: int = 200) -> DataFrame:
    """The series that a forecast keeps missing in one direction, by what that is worth a week."""
    f = signals.join(prices, "series_id").where(F.abs("tracking_signal") > threshold)
    f = f.select("series_id", "tracking_signal", (-F.col("per_week")).alias("bias_units_per_week"), F.when(F.col("tracking_signal") > 0, "under-forecast").otherwise("over-forecast").alias("direction"), (F.abs("per_week") * F.col("unit_price")).alias("weekly_impact"))
    return f.orderBy(F.desc("weekly_impact"), "series_id").limit(top)


def bias_correction(signals: DataFrame, threshold: float = 4.0, strength: float = 0.5, low: float = 0.6, high: float = 1.6) -> DataFrame:
    flagged = F.abs("tracking_signal") > threshold
    ratio = F.when(F.col("mean_forecast") > 0, F.col("mean_actual") / F.col("mean_forecast")).otherwise(1.0)
    return signals.select("series_id", flagged.alias("flagged"), F.when(flagged, F.least(F.greatest(1 + strength * (ratio - 1), F.lit(low)), F.lit(high))).otherwise(1.0).alias("multiplier"))


def value_added(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: actual, forecast, adjusted. The error of the base less that of the adjusted forecast."""
    g = rows.groupBy(*by).agg(wmape("actual", "forecast", None).alias("base_wmape"), wmape("actual", "adjusted", None).alias("adjusted_wmape"), F.count("*").alias("n"))
    return g.withColumn("fva", F.col("base_wmape") - F.col("adjusted_wmape"))


def stability(previous: DataFrame, new: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """How far forecasts for the same days moved between two runs, relative to the first."""
    j = previous.select(*keys, F.col("forecast").alias("old")).join(new, keys)
    return j.groupBy(*by).agg(div(F.sum(F.abs(F.col("forecast") - F.col("old"))), F.sum(F.abs("old"))).alias("stability"))


def t_quantile(spark, p: float, df: int) -> float:
    """Student's t quantile from the mathematics library that Spark ships."""
    return spark._jvm.org.apache.commons.math3.distribution.TDistribution(float(df)).inverseCumulativeProbability(p)


def paired_ci(pairs: DataFrame, level: float = 0.95) -> DataFrame:
    """pairs: a, b. Mean difference with a t-interval (NULL for under two pairs) and how often a is larger."""
    n = pairs.count()
    d = F.col("a") - F.col("b")
    half = F.lit(t_quantile(pairs.sparkSession, 0.5 + level / 2, n - 1)) * F.stddev_samp(d) / F.sqrt(F.count("*")) if n > 1 else F.lit(None).cast("double")
    return pairs.agg(F.avg(d).alias("mean"), (F.avg(d) - half).alias("lower"), (F.avg(d) + half).alias("upper"), F.avg((d > 0).cast("double")).alias("wins"), F.count("*").alias("n"))
