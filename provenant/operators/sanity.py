"""Checks of results: each is an aggregate or an anti join that yields a row or the offending rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, ratio


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: groups, duplicate_keys (keys of more than one row), extra_rows."""
    groups = df.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("_n"))
    return groups.agg(F.count("*").alias("groups"), F.count_if(F.col("_n") > 1).alias("duplicate_keys"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("extra_rows"))


def join_fanout(left: DataFrame, joined: DataFrame, key: str, most: float = 1.0) -> DataFrame:
    """One row: joined rows per distinct key of the left side, and whether that is at most ``most``."""
    keys = left.agg(F.count_distinct(col(key)).alias("keys"))
    return joined.agg(F.count("*").alias("rows")).join(F.broadcast(keys)).select("rows", "keys", ratio(F.col("rows"), F.col("keys")).alias("fanout"), (ratio(F.col("rows"), F.col("keys")) <= most).alias("ok"))


def percent_sum(df: DataFrame, column: str, total: float = 100.0, tolerance: float = 0.5) -> DataFrame:
    return df.agg(F.sum(col(column)).alias("total")).withColumn("ok", F.abs(F.col("total") - total) <= tolerance)


def date_bounds(df: DataFrame, column: str, low: Column, high: Column) -> DataFrame:
    return df.agg(F.min(col(column)).alias("least"), F.max(col(column)).alias("most"), F.count_if((col(column) < low) | (col(column) > high)).alias("outside"))


def missing_periods(df: DataFrame, period: str, expected: DataFrame) -> DataFrame:
    """The expected periods (a one-column table) without rows."""
    name = expected.columns[0]
    return expected.join(df.select(col(period).alias(name)).distinct(), name, "left_anti")


def functional_dependency(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: groups of a, violations (values of a with two or more of b; null counts as a value), holds."""
    groups = df.groupBy(col(a)).agg((F.count_distinct(col(b)) + F.max(F.when(col(b).isNull(), 1).otherwise(0))).alias("_n"))
    return groups.agg(F.count("*").alias("groups"), F.count_if(F.col("_n") > 1).alias("violations")).withColumn("holds", F.col("violations") == 0)


def duplicate_columns(df: DataFrame, columns: list[str]) -> list[tuple[str, str]]:
    """Pairs that agree in every row, from one aggregate of differences."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:] if df.schema[a].dataType == df.schema[b].dataType]
    row = df.agg(F.lit(0).alias("_"), *[F.count_if(~col(a).eqNullSafe(col(b))).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first()
    return [p for i, p in enumerate(pairs) if row[str(i)] == 0]


def quasi_separation(df: DataFrame, column: str, target: str) -> DataFrame:
    """The levels whose rows all have one outcome."""
    levels = df.filter(col(target).isNotNull()).groupBy(col(column).cast("string").alias("level")).agg(F.count("*").alias("n"), F.min(col(target)).alias("lo"), F.max(col(target)).alias("hi"))
    return levels.filter("lo = hi").select("level", "n", F.col("lo").alias("outcome"))


def rank_deficiency(df: DataFrame, columns: list[str]) -> int:
    """Columns less the rank of their centred Gram matrix, which one aggregate yields."""
    import numpy as np

    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(F.lit(0).alias("_"), *[F.covar_samp(col(columns[i]).cast("double"), col(columns[j]).cast("double")).alias(f"{i}_{j}") for i, j in pairs]).first()
    gram = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = row[f"{i}_{j}"] or 0.0
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    return len(columns) - int(np.linalg.matrix_rank(gram / np.outer(scale, scale), tol=1e-9))
