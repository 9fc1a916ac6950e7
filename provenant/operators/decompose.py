"""Why a total or a ratio moved between two periods: exact mix, rate and interaction, contributions, Simpson's check.

Both periods come out of one pass (conditional sums by segment); a segment without rows in a period counts as 0 there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, ratio


def everything():
    """A window over all rows; only for tables of groups."""
    return Window.partitionBy()


def two_periods(df: DataFrame, dim: str, period: str, p1: object, p2: object, values: list[str]) -> DataFrame:
    """A row per segment with <value>_1 and <value>_2."""
    sums = [F.coalesce(F.sum(F.when(col(period) == F.lit(p), col(v))), F.lit(0.0)).alias(f"{v}_{i}") for v in values for i, p in ((1, p1), (2, p2))]
    return df.filter(col(period).isin(p1, p2)).groupBy(col(dim).alias("segment")).agg(*sums)


def decompose_margin(df: DataFrame, dim: str, period: str, p1: object, p2: object, revenue: str = "revenue", cogs: str = "cogs") -> DataFrame:
    """segment, share_1, share_2, margin_1, margin_2, mix, rate, interaction, total. The effects sum to the change of the
    whole margin; a segment without revenue in a period has margin 0 there; no revenue at all in a period raises."""
    both = two_periods(df, dim, period, p1, p2, [revenue, cogs])
    r1, r2, c1, c2 = (col(f"{v}_{i}") for v in (revenue, cogs) for i in (1, 2))
    whole = lambda r: F.sum(r).over(everything())
    checked = lambda r, p: F.when(whole(r) != 0, r / whole(r)).otherwise(F.raise_error(F.lit(f"no revenue in period {p}")).cast("double"))
    margin = lambda r, c: F.coalesce(ratio(r - c, r), F.lit(0.0))
    rows = both.select("segment", checked(r1, p1).alias("share_1"), checked(r2, p2).alias("share_2"), margin(r1, c1).alias("margin_1"), margin(r2, c2).alias("margin_2"))
    dw, dm = F.col("share_2") - F.col("share_1"), F.col("margin_2") - F.col("margin_1")
    rows = rows.withColumns({"mix": dw * F.col("margin_1"), "rate": F.col("share_1") * dm, "interaction": dw * dm})
    return rows.withColumn("total", F.col("mix") + F.col("rate") + F.col("interaction"))


def margin_totals(effects: DataFrame) -> DataFrame:
    """One row: both margins, their change, its three parts and the dominant one (the first of equals)."""
    s = lambda c: F.sum(c)
    totals = effects.agg(s(F.col("share_1") * F.col("margin_1")).alias("margin_1"), s(F.col("share_2") * F.col("margin_2")).alias("margin_2"), s("mix").alias("mix"), s("rate").alias("rate"), s("interaction").alias("interaction"))
    mix, rate, inter = (F.abs(F.col(c)) for c in ("mix", "rate", "interaction"))
    dominant = F.when((mix >= rate) & (mix >= inter), "mix").when(rate >= inter, "rate").otherwise("interaction")
    return totals.withColumn("delta", F.col("margin_2") - F.col("margin_1")).withColumn("dominant", dominant)


def additive_contribution(df: DataFrame, dim: str, period: str, p1: object, p2: object, value: str) -> DataFrame:
    """segment, value_1, value_2, delta and its share of the whole change (null when nothing changed)."""
    both = two_periods(df, dim, period, p1, p2, [value]).select("segment", col(f"{value}_1").alias("value_1"), col(f"{value}_2").alias("value_2"))
    both = both.withColumn("delta", F.col("value_2") - F.col("value_1"))
    return both.withColumn("contribution", ratio(F.col("delta"), F.sum("delta").over(everything())))


def simpsons_check(df: DataFrame, dim: str, period: str, p1: object, p2: object, top: str, bottom: str) -> DataFrame:
    """One row: the change of top/bottom overall, how many segments (present in both periods) moved each way, and whether
    all that moved went against the whole. Segment changes are rounded to 4 places first."""
    both = two_periods(df, dim, period, p1, p2, [top, bottom])
    t1, t2, b1, b2 = (col(f"{v}_{i}") for v in (top, bottom) for i in (1, 2))
    delta = F.round(ratio(t2, b2) - ratio(t1, b1), 4)
    whole = ratio(F.sum(t2), F.sum(b2)) - ratio(F.sum(t1), F.sum(b1))
    present = (b1 > 0) & (b2 > 0)
    row = both.agg(whole.alias("overall_delta"), F.count_if(present & (delta > 0)).alias("n_up"), F.count_if(present & (delta < 0)).alias("n_down"))
    up, down, d = F.col("n_up"), F.col("n_down"), F.col("overall_delta")
    return row.withColumn("reversed", ((d > 0) & (up == 0) & (down > 0)) | ((d < 0) & (down == 0) & (up > 0)))


@dataclass(frozen=True)
class Assumption:
    name: str
    base: float
    low: float
    high: float


def size_opportunity(assumptions: list[Assumption], model: Callable[[dict[str, float]], float]) -> dict:
    """The model's value at the base, and what moving one assumption at a time does, widest swing first."""
    base = {a.name: a.base for a in assumptions}
    swings = []
    for a in assumptions:
        low, high = model(base | {a.name: a.low}), model(base | {a.name: a.high})
        swings.append({"assumption": a.name, "low": low, "high": high, "swing": abs(high - low)})
    return {"value": model(base), "tornado": sorted(swings, key=lambda s: (-s["swing"], s["assumption"]))}


def product_model(values: dict[str, float]) -> float:
    out = 1.0
    for v in values.values():
        out *= v
    return out


def margin_opportunity(mix: float, revenue: float) -> dict:
    """Points of margin that undoing the mix would recover, on revenue: half to all of them, revenue within a tenth."""
    points = abs(mix) * 100
    sized = size_opportunity([Assumption("points", points, points / 2, points), Assumption("revenue", revenue, 0.9 * revenue, 1.1 * revenue)], lambda v: v["points"] / 100 * v["revenue"])
    return sized | {"recoverable_points": points}
