"""Ranks and running sums over a column of any number of distinct values, without one sorted partition; exact quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(values: DataFrame, key: str, sums: list[str], cuts: int = 64) -> DataFrame:
    """values (a row per distinct key) with before_<s> and total_<s> for each column s: its sum over smaller keys and over
    all. Keys are dealt into ranges by approximate quantiles; a range's own running sum and the sums of the ranges before it
    add up, so no task orders more than about 1 / cuts of the keys. Sums are bigints; keys are not null."""
    at = values.agg(F.percentile_approx(F.col(key).cast("double"), [i / cuts for i in range(1, cuts)], 10_000)).first()[0]
    edges = sorted(set(at or []))
    part = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col(key))) if edges else F.lit(0)
    dealt = values.withColumn("_part", part)
    rows = {r["_part"]: r for r in dealt.groupBy("_part").agg(*[F.sum(s).alias(s) for s in sums]).collect()}  # at most ``cuts`` rows
    own = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt
    for s in sums:
        offset, before = F.lit(0).cast("bigint"), 0
        for p in sorted(rows):
            offset = F.when(F.col("_part") == p, F.lit(before).cast("bigint")).otherwise(offset)
            before += rows[p][s] or 0
        inside = F.coalesce(F.sum(s).over(own), F.lit(0)).cast("bigint")
        out = out.withColumn(f"before_{s}", inside + offset).withColumn(f"total_{s}", F.lit(before).cast("bigint"))
    return out.drop("_part")


def exact_quantiles(long: DataFrame, q: float = 0.5, most: int = 1_000_000) -> dict[str, float]:
    """The interpolated quantile of each name's values in long (name, value; no nulls).

    An approximate quantile brackets the rank; rows outside the bracket are counted and left behind until at most ``most``
    rows, or one value, are inside. Each round is one aggregation that shrinks a bracket some thousandfold."""
    value = F.col("value")
    state = {r["name"]: {"lo": r["lo"], "hi": r["hi"], "below": 0, "inside": r["n"], "n": r["n"]} for r in long.groupBy("name").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n")).collect()}
    for s in state.values():
        s["rank"] = q * (s["n"] - 1)

    def within(names: list[str]) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | ((F.col("name") == n) & value.between(state[n]["lo"], state[n]["hi"]))
        return out

    while wide := [n for n, s in state.items() if s["inside"] > most and s["lo"] < s["hi"]]:
        accuracy, bounds = 10_000, {}
        rows = long.filter(within(wide))
        share = {n: (state[n]["rank"] - state[n]["below"]) / state[n]["inside"] for n in wide}
        found = rows.groupBy("name").agg(*[F.percentile_approx(value, [max(0.0, p - 3 / accuracy), min(1.0, p + 3 / accuracy)], accuracy).alias(f"q{i}") for i, p in enumerate(share.values())]).collect()
        for r in found:
            bounds[r["name"]] = r[f"q{list(share).index(r['name'])}"]
        lower = upper = F.lit(None).cast("double")
        for n, (lo, hi) in bounds.items():
            lower, upper = F.when(F.col("name") == n, F.lit(float(lo))).otherwise(lower), F.when(F.col("name") == n, F.lit(float(hi))).otherwise(upper)
        counts = rows.groupBy("name").agg(F.count_if(value < lower).alias("under"), F.count_if(value.between(lower, upper)).alias("inside")).collect()
        for r in counts:
            s, (lo, hi) = state[r["name"]], bounds[r["name"]]
            here = s["below"] + r["under"]
            if here <= s["rank"] and s["rank"] + 1 < here + r["inside"] and r["inside"] < s["inside"]:
                s |= {"lo": lo, "hi": hi, "below": here, "inside": r["inside"]}
            else:  # the bracket no longer shrinks: one value holds most of what is left
                s["inside"] = 0
    out = {}
    left = long.filter(within(list(state))).groupBy("name", "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("name").orderBy("value"))
    target = F.lit(None).cast("double")
    for n, s in state.items():
        target = F.when(F.col("name") == n, F.lit(s["rank"] - s["below"])).otherwise(target)
    ranked = left.withColumn("upto", upto).withColumn("rank", target)
    first, second = F.floor("rank"), F.ceil("rank")
    at = lambda r: F.min(F.when(F.col("upto") > r, value))
    for r in ranked.groupBy("name").agg(at(first).alias("a"), at(second).alias("b"), F.max(F.col("rank") - first).alias("f")).collect():
        out[r["name"]] = r["a"] + (r["b"] - r["a"]) * r["f"] if r["b"] is not None else r["a"]
    return out
