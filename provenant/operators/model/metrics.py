"""Metrics of scored rows (y in 0/1, score) from aggregates over distinct scores; no metric sorts all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.columns import col, ratio
from ...functions.ranks import running_sums



def by_score(df: DataFrame, y: str, score: str) -> DataFrame:
    """score, n, x: rows and positives of each distinct score. Rows without outcome or score are left out."""
    return df.filter(col(y).isNotNull() & col(score).isNotNull()).groupBy(col(score).cast("double").alias("score")).agg(F.count("*").alias("n"), F.sum(col(y).cast("bigint")).alias("x"))


def confusion(df: DataFrame, y: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row at score >= threshold: tp, fp, tn, fn, precision, recall, specificity, f1, accuracy."""
    return threshold_table(df, y, score, [threshold])


def threshold_table(df: DataFrame, y: str, score: str, thresholds: list[float]) -> DataFrame:
    """A row per threshold. One aggregation, whatever their number: each row's scores meet an array of literals."""
    scores = by_score(df, y, score)
    ts = F.array(*[F.lit(float(t)) for t in thresholds])
    rows = scores.select("n", "x", F.explode(F.transform(ts, lambda t: F.struct(t.alias("threshold"), (F.col("score") >= t).alias("flag")))).alias("c")).select("n", "x", "c.*")
    some = lambda c, p: F.sum(F.when(p, c).otherwise(0)).cast("bigint")
    flag, neg = F.col("flag"), F.col("n") - F.col("x")
    out = rows.groupBy("threshold").agg(some(F.col("x"), flag).alias("tp"), some(neg, flag).alias("fp"), some(neg, ~flag).alias("tn"), some(F.col("x"), ~flag).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return out.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tn, tn + fp).alias("specificity"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"))


def roc_curve(df: DataFrame, y: str, score: str, steps: int = 100) -> DataFrame:
    """threshold, tpr, fpr at steps + 1 fixed thresholds."""
    rows = threshold_table(df, y, score, [i / steps for i in range(steps + 1)])
    return rows.select("threshold", F.col("recall").alias("tpr"), (1 - F.col("specificity")).alias("fpr"))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row: auc with ties at half, null with one class only."""
    scores = running_sums(by_score(df, y, score), "score", ["n"])
    ranked = scores.select("n", "x", (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank"))
    sums = ranked.agg(F.sum(F.col("x") * F.col("rank")).alias("r"), F.sum("x").cast("double").alias("p"), (F.sum("n") - F.sum("x")).cast("double").alias("q"))
    return sums.select(ratio(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))


def calibration(df: DataFrame, y: str, score: str, tie: list[str], k: int = 10) -> DataFrame:
    """bin, n, mean_score, rate over rows in score order, k bins of floor(n / k) rows, the remainder in the last.

    A score's rows share a bin unless a bin edge cuts through them; only those scores are ordered row by row."""
    rows = df.filter(col(y).isNotNull() & col(score).isNotNull()).select(col(score).cast("double").alias("s"), col(y).cast("bigint").alias("y"), *[col(t).alias(f"t{i}") for i, t in enumerate(tie)])
    counts = running_sums(rows.groupBy("s").agg(F.count("*").alias("n")), "s", ["n"])
    size = F.greatest(F.lit(1), F.floor(F.col("total_n") / k))
    place = lambda rank: F.least(F.floor(rank / F.col("size")), F.lit(k - 1)).cast("int")
    edges = counts.select("s", "n", F.col("before_n").alias("before"), size.alias("size")).select("s", "before", "size", place(F.col("before")).alias("first"), place(F.col("before") + F.col("n") - 1).alias("last"))
    placed = rows.join(edges, "s")
    rank = F.row_number().over(Window.partitionBy("s").orderBy(*[F.col(f"t{i}") for i in range(len(tie))])) - 1
    whole = placed.filter("first = last").select("s", "y", F.col("first").alias("bin"))
    split = placed.filter("first <> last").select("s", "y", place(F.col("before") + rank).alias("bin"))
    return whole.union(split).groupBy("bin").agg(F.count("*").alias("n"), F.avg("s").alias("mean_score"), F.avg("y").alias("rate"))


def brier(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row: brier score, majority-class accuracy, n."""
    return df.filter(col(y).isNotNull() & col(score).isNotNull()).agg(F.avg((col(score) - col(y)) ** 2).alias("brier"), F.greatest(F.avg(col(y).cast("double")), 1 - F.avg(col(y).cast("double"))).alias("majority"), F.count("*").alias("n"))


def ks_statistic(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row: the greatest distance of the two classes' cumulative shares over scores."""
    scores = running_sums(by_score(df, y, score).withColumn("z", F.col("n") - F.col("x")), "score", ["x", "z"])
    share = lambda c: ratio(F.col(f"before_{c}") + F.col(c), F.col(f"total_{c}"))
    gap = F.abs(share("x") - share("z"))
    return scores.select(gap.alias("gap")).agg(F.max("gap").alias("ks"))
