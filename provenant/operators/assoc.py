"""Association of a 0/1 outcome with columns: everything a summary by level or class can say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.columns import col, ratio
from ..functions.ranks import exact_quantiles


def everything():
    """A window over all rows; only for tables of groups."""
    return Window.partitionBy()


def wilson_bounds(x: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson's interval as columns, (0, 0) for no rows."""
    x, n = x.cast("double"), n.cast("double")
    p, down = ratio(x, n), 1 + F.try_divide(F.lit(z * z), n)
    middle = (p + F.try_divide(F.lit(z * z / 2), n)) / down
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n)) / down
    return F.coalesce(F.greatest(F.lit(0.0), middle - half), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), middle + half), F.lit(0.0))


def group_rates(df: DataFrame, level: str, target: str) -> DataFrame:
    """level, n, x, rate, ci_low, ci_high, lift, gap_pp. Null is a level of its own; rows without an outcome are left out."""
    rows = df.filter(col(target).isNotNull()).groupBy(col(level).cast("string").alias("level")).agg(F.count("*").alias("n"), F.sum(col(target).cast("bigint")).alias("x"))
    base = F.sum("x").over(everything()) / F.sum("n").over(everything())
    low, high = wilson_bounds(F.col("x"), F.col("n"))
    rate = ratio(F.col("x"), F.col("n"))
    return rows.select("level", "n", "x", rate.alias("rate"), low.alias("ci_low"), high.alias("ci_high"), ratio(rate, base).alias("lift"), ((rate - base) * 100).alias("gap_pp"))


def chi_square(df: DataFrame, level: str, target: str) -> DataFrame:
    """One row: n, levels, statistic, df, cramers_v and whether an expected count is below 5. Null levels count."""
    rows = df.filter(col(target).isNotNull()).groupBy(col(level).alias("level")).agg(F.count("*").alias("n"), F.sum(col(target).cast("bigint")).alias("x"))
    share = F.sum("x").over(everything()) / F.sum("n").over(everything())
    e1, e0 = F.col("n") * share, F.col("n") * (1 - share)
    part = F.try_divide((F.col("x") - e1) ** 2, e1) + F.try_divide((F.col("n") - F.col("x") - e0) ** 2, e0)
    out = rows.select("n", part.alias("part"), F.least(e1, e0).alias("expected")).agg(F.sum("n").alias("n"), F.count("*").alias("levels"), F.sum("part").alias("statistic"), (F.min("expected") < 5).alias("small_expected"))
    return out.withColumn("df", F.col("levels") - 1).withColumn("cramers_v", F.sqrt(ratio(F.col("statistic"), F.col("n"))))


def with_p_values(summary: DataFrame) -> list[dict]:
    """chi_square's row with the tail probability, on the driver."""
    return [r.asDict() | {"p_value": stats.chi_square_tail(r["statistic"], r["df"]) if r["statistic"] is not None and r["df"] else None} for r in summary.collect()]


def two_by_two(df: DataFrame, exposed: Column, target: str) -> DataFrame:
    """One row: a, b (exposed with and without the outcome), c, d, odds ratio and relative risk with 95 % intervals.
    0.5 is added to every cell when one is empty."""
    y = col(target) == 1
    count = lambda p: F.count_if(p).cast("double")
    row = df.filter(col(target).isNotNull() & exposed.isNotNull()).agg(count(exposed & y).alias("a"), count(exposed & ~y).alias("b"), count(~exposed & y).alias("c"), count(~exposed & ~y).alias("d"))
    add = F.when(F.least("a", "b", "c", "d") == 0, 0.5).otherwise(0.0)
    row = row.select(*[(F.col(c) + add).alias(c) for c in "abcd"])
    a, b, c, d = (F.col(x) for x in "abcd")
    odds, se_odds = a * d / (b * c), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    risk, se_risk = (a / (a + b)) / (c / (c + d)), F.sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d))
    spread = lambda v, se, s: v * F.exp(s * 1.96 * se)
    return row.select("a", "b", "c", "d", odds.alias("odds_ratio"), spread(odds, se_odds, -1).alias("or_low"), spread(odds, se_odds, 1).alias("or_high"), risk.alias("relative_risk"), spread(risk, se_risk, -1).alias("rr_low"), spread(risk, se_risk, 1).alias("rr_high"))


def _long(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    """A row per row and column: name, value (double). One scan and, after it, one shuffle for any number of columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), col(c).cast("double").alias("value")) for c in columns])
    return df.select(*more, F.inline(pairs))


def point_biserial(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """column, n, r: Pearson's correlation of each column with the outcome; null for a constant column."""
    long = _long(df.filter(col(target).isNotNull()), columns, col(target).cast("double").alias("y")).filter("value IS NOT NULL")
    x, y = F.col("value"), F.col("y")
    sums = long.groupBy(F.col("name").alias("column")).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    return sums.select("column", "n", ratio(F.col("c"), F.col("sx") * F.col("sy")).alias("r"))


def class_moments(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """column, class, n, mean, sd (sample) of each column in each class."""
    long = _long(df.filter(col(target).isNotNull()), columns, col(target).cast("bigint").alias("class")).filter("value IS NOT NULL")
    return long.groupBy(F.col("name").alias("column"), "class").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def numeric_summaries(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, min, max, mean, sd, median (exact, interpolated)."""
    long = _long(df, columns).filter("value IS NOT NULL")
    v, median = F.col("value"), F.lit(None).cast("double")
    for name, m in exact_quantiles(long).items():
        median = F.when(F.col("column") == name, F.lit(float(m))).otherwise(median)
    rows = long.groupBy(F.col("name").alias("column")).agg(F.count("*").alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    return rows.withColumn("median", median)


def numeric_findings(df: DataFrame, columns: list[str], target: str) -> list[dict]:
    """Correlation test, Welch's test and Cohen's d per column, from two summaries."""
    rs = {r["column"]: r for r in point_biserial(df, columns, target).collect()}
    by: dict[str, dict] = {}
    for r in class_moments(df, columns, target).collect():
        by.setdefault(r["column"], {})[r["class"]] = r
    out = []
    for c in sorted(rs):
        r, classes = rs[c], by.get(c, {})
        if r["r"] is None or 0 not in classes or 1 not in classes:
            continue
        one, zero = classes[1], classes[0]
        args = (one["n"], one["mean"], one["sd"] or 0.0, zero["n"], zero["mean"], zero["sd"] or 0.0)
        test, d = stats.correlation(r["r"], r["n"]), stats.cohens_d(*args)
        out.append({"column": c, "kind": "numeric", "n": r["n"], "r": r["r"], "p_value": test.p_value, "significant": test.below(), "welch": stats.welch(*args), "d": d and d["d"], "effect": abs(r["r"])})
    return out


def top_levels(df: DataFrame, columns: list[str], target: str, k: int = 20) -> DataFrame:
    """column, level, n, x of the k commonest levels of every column; the rest is folded into one level, so that rates
    weighted by n always give the base rate. One pass over all columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("level")) for c in columns])
    counts = df.filter(col(target).isNotNull()).select(col(target).cast("bigint").alias("y"), F.inline(pairs)).groupBy("column", "level").agg(F.count("*").alias("n"), F.sum("y").alias("x"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("level").asc_nulls_last()))
    ranked = counts.withColumn("rank", rank)
    folded = F.when(F.col("rank") <= k, F.struct(F.col("rank").alias("rank"), F.col("level").alias("level"))).otherwise(F.struct(F.lit(k + 1).alias("rank"), F.lit("(other)").alias("level")))
    return ranked.groupBy("column", folded.alias("l")).agg(F.sum("n").alias("n"), F.sum("x").alias("x")).select("column", F.col("l.rank").alias("rank"), F.col("l.level").alias("level"), "n", "x")


def categorical_findings(df: DataFrame, columns: list[str], target: str, k: int = 20) -> list[dict]:
    """The level furthest from the base rate against the rest, and chi-square with Cramer's V, per column."""
    by: dict[str, list] = {}
    for r in top_levels(df, columns, target, k).orderBy("column", "rank").collect():
        by.setdefault(r["column"], []).append((r["level"], r["x"], r["n"]))
    out = []
    for c, rows in sorted(by.items()):
        n, x = sum(r[2] for r in rows), sum(r[1] for r in rows)
        chi = stats.chi_square([(r[1], r[2]) for r in rows])
        if chi["statistic"] is None:
            continue
        level, lx, ln = max(rows, key=lambda r: abs(r[1] / r[2] - x / n))
        test = stats.proportions(lx, ln, x - lx, n - ln)
        v = stats.cramers_v(chi["statistic"], chi["n"], len(rows))
        out.append({"column": c, "kind": "categorical", "n": n, "level": level, "gap_pp": 100 * (lx / ln - x / n), "p_value": test.p_value, "significant": test.below(), "chi_square": chi, "cramers_v": v, "effect": v or 0.0})
    return out


def rank_score(effect: float, kind: str, significant: bool | None, n: int) -> float:
    """Comparable across kinds: correlation, V and jump as they are, d as d / (d + 1), points as a share; less without
    significance, and in proportion below 384 rows."""
    size = {"d": abs(effect) / (abs(effect) + 1), "gap_pp": abs(effect) / 100}.get(kind, abs(effect))
    return size * {True: 1.0, None: 0.7, False: 0.5}[significant] * min(1.0, n / 384)


def rank_findings(findings: list[dict], top: int | None = None) -> list[dict]:
    """Highest score first; with ``top``, the best of each column and no more than that many."""
    scored = sorted(({"score": rank_score(f["effect"], f.get("effect_kind", f["kind"]), f["significant"], f["n"])} | f for f in findings), key=lambda f: (-f["score"], f["column"], f["kind"]))
    if top is None:
        return scored
    best: dict[str, dict] = {}
    for f in scored:
        best.setdefault(f["column"], f)
    return list(best.values())[:top]
