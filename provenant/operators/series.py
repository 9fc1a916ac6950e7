"""Series at regular points: trend, anomalies, seasonality, forecast. A series is (t, y) with t = 0, 1, 2 and so on.

Trend and forecast need sums only; the series may come from any number of rows, as the points are grouped first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, ratio


def everything():
    """A window over all rows; only for tables of groups."""
    return Window.partitionBy()


def to_series(points: DataFrame, order: str, value: str) -> DataFrame:
    """(t, y) of points in order; the points are groups (days, quarters), not rows."""
    return points.select((F.row_number().over(Window.orderBy(col(order))) - 1).cast("int").alias("t"), col(value).cast("double").alias("y"))


def fit_trend(series: DataFrame) -> DataFrame:
    """One row: n, slope, intercept, r2, direction (flat within 1e-9)."""
    fit = series.agg(F.count("*").alias("n"), F.regr_slope("y", "t").alias("slope"), F.regr_intercept("y", "t").alias("intercept"), F.coalesce(F.regr_r2("y", "t"), F.lit(0.0)).alias("r2"))
    direction = F.when(F.col("slope") > 1e-9, "up").when(F.col("slope") < -1e-9, "down").otherwise("flat")
    return fit.withColumn("direction", direction)


def residuals(series: DataFrame) -> DataFrame:
    """t, y, fitted, residual from the trend over the whole series."""
    slope, mean_t, mean_y = F.coalesce(F.regr_slope("y", "t").over(everything()), F.lit(0.0)), F.avg("t").over(everything()), F.avg("y").over(everything())
    fitted = mean_y + slope * (F.col("t") - mean_t)
    return series.select("t", "y", fitted.alias("fitted")).withColumn("residual", F.col("y") - F.col("fitted"))


def anomalies(series: DataFrame, z: float = 3.5) -> DataFrame:
    """t, y, score: points whose residual lies more than z scaled median deviations from the median residual."""
    rows = residuals(series).withColumn("m", F.percentile("residual", 0.5).over(everything()))
    rows = rows.withColumn("mad", F.percentile(F.abs(F.col("residual") - F.col("m")), 0.5).over(everything()))
    score = ratio(F.abs(F.col("residual") - F.col("m")), F.col("mad") * 1.4826)
    return rows.withColumn("score", score).filter(F.col("score") > z).select("t", "y", "score")


def seasonal_profile(series: DataFrame, period: int) -> DataFrame:
    """phase, effect: the mean residual of each phase (classical decomposition around a linear trend)."""
    return residuals(series).groupBy((F.col("t") % period).alias("phase")).agg(F.avg("residual").alias("effect"))


def deseasonalise(series: DataFrame, period: int) -> DataFrame:
    """t, y, adjusted, seasonal; by classical decomposition, which is not STL. Below two periods nothing is adjusted."""
    by_phase = Window.partitionBy(F.col("t") % period)
    enough = F.count("*").over(everything()) >= 2 * period
    rows = residuals(series).withColumn("seasonal", F.when(enough, F.avg("residual").over(by_phase)).otherwise(F.lit(0.0)))
    return rows.select("t", "y", (F.col("y") - F.col("seasonal")).alias("adjusted"), "seasonal", "residual")


def seasonality_strength(series: DataFrame, period: int) -> DataFrame:
    """One row: the share of the detrended variance that the seasonal profile explains, 0 to 1."""
    rows = deseasonalise(series, period)
    strength = 1 - ratio(F.var_pop(F.col("residual") - F.col("seasonal")), F.var_pop("residual"))
    return rows.agg(F.greatest(F.lit(0.0), F.coalesce(strength, F.lit(0.0))).alias("strength"))


def forecast(series: DataFrame, horizon: int, period: int | None = None) -> DataFrame:
    """t, forecast, low, high for the next points: the trend, with ``period`` the mean residual of the phase, and a band
    of 1.96 residual standard deviations (n - 1)."""
    rows = residuals(series)
    if period:
        rows = rows.withColumn("seasonal", F.avg("residual").over(Window.partitionBy(F.col("t") % period)))
    else:
        rows = rows.withColumn("seasonal", F.lit(0.0))
    facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.regr_slope("y", "t"), F.lit(0.0)).alias("slope"), F.avg("y").alias("my"), F.avg("t").alias("mt"), F.coalesce(F.stddev_samp(F.col("residual") - F.col("seasonal")), F.lit(0.0)).alias("sd"))
    ahead = facts.select("*", F.explode(F.sequence(F.col("n"), F.col("n") + horizon - 1)).alias("t"))
    value = F.col("my") + F.col("slope") * (F.col("t") - F.col("mt"))
    if period:
        profile = seasonal_profile(series, period)
        ahead = ahead.join(profile, F.col("t") % period == F.col("phase"), "left")
        value = value + F.coalesce(F.col("effect"), F.lit(0.0))
    return ahead.select(F.col("t").cast("int").alias("t"), value.alias("forecast"), (value - 1.96 * F.col("sd")).alias("low"), (value + 1.96 * F.col("sd")).alias("high"))


def ratio_series(df: DataFrame, period: str, top: str, bottom: str) -> DataFrame:
    """period, value: a ratio of sums per period, from one aggregation."""
    return df.groupBy(col(period).alias("period")).agg(ratio(F.sum(col(top)), F.sum(col(bottom))).alias("value"))
