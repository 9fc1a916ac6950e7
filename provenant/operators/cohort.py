"""Cohorts by first appearance: retention, lifetime value, vintages, funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, ratio


def assign_cohorts(events: DataFrame, user: str, ts: str, unit: str = "day") -> DataFrame:
    """events with cohort (start of the unit of a user's first event) and offset (units since). Users of any number of
    events: the first event comes from an aggregation that is joined back, not from a window over each user's rows."""
    start = lambda c: F.date_trunc(unit, c).cast("date")
    first = events.groupBy(col(user).alias("_user")).agg(start(F.min(col(ts))).alias("cohort"))
    joined = events.join(first, col(user).eqNullSafe(F.col("_user"))).drop("_user")
    here = start(col(ts))
    offset = {"day": F.datediff(here, F.col("cohort")), "week": F.floor(F.datediff(here, F.col("cohort")) / 7), "month": F.round(F.months_between(here, F.col("cohort")))}[unit]
    return joined.withColumn("offset", offset.cast("int"))


def retention_matrix(rows: DataFrame, user: str, cohort: str = "cohort", offset: str = "offset") -> DataFrame:
    """cohort, offset, users, rate (users over those of offset 0; null if the cohort has none there)."""
    counts = rows.groupBy(col(cohort).alias("cohort"), col(offset).alias("offset")).agg(F.count_distinct(col(user)).alias("users"))
    base = F.max(F.when(F.col("offset") == 0, F.col("users"))).over(Window.partitionBy("cohort"))
    return counts.select("cohort", "offset", "users", ratio(F.col("users"), base).alias("rate"))


def overall_rate(matrix: DataFrame) -> DataFrame:
    """offset, rate: users at each offset over the offset-0 users of the cohorts seen there."""
    base = matrix.filter("offset = 0").select("cohort", F.col("users").alias("base"))
    return matrix.join(base, "cohort").groupBy("offset").agg(ratio(F.sum("users"), F.sum("base")).alias("rate"))


def cohort_ltv(rows: DataFrame, user: str, value: str, cohort: str = "cohort", offset: str = "offset") -> DataFrame:
    """cohort, offset, ltv: value so far per offset-0 user (at least 1), to 4 places."""
    sums = rows.groupBy(col(cohort).alias("cohort"), col(offset).alias("offset")).agg(F.sum(col(value)).alias("v"), F.count_distinct(col(user)).alias("users"))
    by = Window.partitionBy("cohort")
    base = F.greatest(F.coalesce(F.max(F.when(F.col("offset") == 0, F.col("users"))).over(by), F.lit(1)), F.lit(1))
    so_far = F.sum("v").over(by.orderBy("offset").rowsBetween(Window.unboundedPreceding, 0))
    return sums.select("cohort", "offset", F.round(so_far / base, 4).alias("ltv"))


def vintage_compare(matrix: DataFrame, offset: int) -> DataFrame:
    """Cohorts at one offset, best first."""
    return matrix.filter(F.col("offset") == offset).select("cohort", "users", "rate").orderBy(F.col("rate").desc(), "cohort")


def funnel(events: DataFrame, stage: str, user: str, stages: list[str]) -> DataFrame:
    """step, stage, users, conversion (from the step before) and drop, with the biggest drop marked. A stage without
    events has 0 users."""
    order = F.array(*[F.lit(s) for s in stages])
    counts = events.filter(col(stage).isin(stages)).groupBy(col(stage).alias("stage")).agg(F.count_distinct(col(user)).alias("users"))
    steps = events.sparkSession.range(1).select(F.posexplode(order).alias("step", "stage"))
    rows = steps.join(counts, "stage", "left").select("step", "stage", F.coalesce("users", F.lit(0)).alias("users"))
    before = F.lag("users").over(Window.orderBy("step"))
    rows = rows.withColumn("conversion", ratio(F.col("users"), before)).withColumn("drop", before - F.col("users"))
    return rows.withColumn("biggest", F.coalesce(F.col("drop") == F.max("drop").over(Window.partitionBy()), F.lit(False)))


def stage_conversion(before: Column, after: Column) -> Column:
    return ratio(after, before)
