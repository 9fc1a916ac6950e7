"""Column builders with one meaning in every plan: identifiers, guarded casts, ratios, families of types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE_SHAPE = r"^\s*\d{4}-\d{1,2}-\d{1,2}(?:[ T].*)?\s*$"
NUMBER_SHAPE = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def quote(name: str) -> str:
    """A name as one identifier, whatever characters it holds."""
    if not name or "\x00" in name:
        raise ValueError(f"no identifier: {name!r}")
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.VarcharType, T.CharType))


def is_date(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def safe_date(text: Column) -> Column:
    """Text as a date, null unless it is written year-month-day (slashes count as dashes). A bare year is no date."""
    dashed = F.regexp_replace(F.trim(text), "/", "-")
    return F.when(dashed.rlike(DATE_SHAPE), F.to_date(F.when(dashed.rlike(DATE_SHAPE), dashed).try_cast("timestamp_ntz")))


def safe_double(text: Column) -> Column:
    """Text as a double, null unless it is written as a number (no type suffix, no separators)."""
    return F.when(text.rlike(NUMBER_SHAPE), F.trim(text).try_cast("double"))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as a double, null where bottom is 0 or null."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def project(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[col(n) for n in names])


def append(df: DataFrame, columns: dict[str, str | Column]) -> DataFrame:
    """df with declared columns; text is a SQL expression over df."""
    return df.withColumns({n: F.expr(e) if isinstance(e, str) else e for n, e in columns.items()})


def exclude(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.drop(*names)


def equals(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Rows whose columns have the given values: one value, a list of values, or None for null."""
    for name, v in values.items():
        df = df.filter(col(name).isNull() if v is None else col(name).isin(list(v)) if isinstance(v, (list, tuple, set)) else col(name) == F.lit(v))
    return df


def changed(before: Column, after: Column) -> Column:
    """Null-safe inequality."""
    return ~before.eqNullSafe(after)


def best_per_key(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Of each key the columns of the row with the least ``order``, by an aggregate: no rows of a hot key are sorted."""
    best = F.min(F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], F.struct(*[col(c) for c in columns]).alias("row"))).alias("_best")
    return df.groupBy(*[col(k) for k in keys]).agg(best).select(*[col(k) for k in keys], *[F.col("_best.row").getField(c).alias(c) for c in columns])


def value_at_maximum(df: DataFrame, keys: list[str], value: str, by: list[str], name: str) -> DataFrame:
    """The last non-null value of each key in the order of ``by``."""
    known = df.filter(col(value).isNotNull())
    return known.groupBy(*[col(k) for k in keys]).agg(F.max_by(col(value), F.struct(*[col(b) for b in by])).alias(name))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """The rows of all tables by column name; a column that one lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def condition_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: n and how many rows meet each condition; null does not."""
    return df.agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def top_levels(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The k commonest values (level, n); ties go to the smaller value, null is one."""
    return df.groupBy(col(column).alias("level")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("level").asc_nulls_last()).limit(k)
