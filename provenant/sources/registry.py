"""Declared sources as DataFrames: files, joined files, JDBC, catalogue tables; with fallback copies and introspection."""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import append, col


class SourceError(RuntimeError):
    pass


class NotSupported(SourceError):
    """A source that is declared but has no reader here."""


@dataclass(frozen=True)
class Spec:
    name: str
    kind: str
    path: str | None = None
    schema: T.StructType | str | None = None
    table: str | None = None
    sheet: str | None = None
    row_limit: int | None = None
    derived: dict[str, str] = field(default_factory=dict)
    sources: dict[str, str] = field(default_factory=dict)
    view_sql: str | None = None
    extra_views: dict[str, str] = field(default_factory=dict)
    options: dict[str, str] = field(default_factory=dict)
    fallback: str | None = None


def _encoding(spark: SparkSession, path: str) -> str:
    """utf-8 if all bytes are, else windows-1252, else latin-1 (which takes any byte). One pass over the raw lines, on the
    executors: a file may be of any size and in any store."""
    raw = spark.read.option("wholetext", "false").option("encoding", "ISO-8859-1").format("csv").option("sep", "\x01").option("quote", "\x00").load(path)
    line = F.encode(F.col("_c0"), "ISO-8859-1")
    # bytes that windows-1252 leaves without a character
    row = raw.filter("_c0 IS NOT NULL").agg(F.bool_and(F.is_valid_utf8(line.cast("string"))).alias("utf8"), F.bool_or(F.col("_c0").rlike("[\x81\x8d\x8f\x90\x9d]")).alias("undefined")).first()
    if row["utf8"] is None or row["utf8"]:
        return "UTF-8"
    return "ISO-8859-1" if row["undefined"] else "windows-1252"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """CSV or, by suffix, TSV with a header. Without a schema types are inferred by a pass of their own."""
    encoding = _encoding(spark, path)
    if encoding != "UTF-8":
        warnings.warn(f"{path} is not UTF-8; read as {encoding}", stacklevel=2)
    reader = spark.read.options(header=True, sep="\t" if path.lower().endswith((".tsv", ".tab")) else ",", encoding="UTF-8" if encoding == "UTF-8" else "ISO-8859-1", **options)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return _windows(df) if encoding == "windows-1252" else df


def _windows(df: DataFrame) -> DataFrame:
    """Text read as latin-1 as windows-1252: the two differ in 27 of the characters from 0x80 to 0x9f."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    here, there = ("".join(x) for x in zip(*[p for p in pairs if p[1]]))
    table = str.maketrans(here, there)
    return df.select(*[(F.translate(col(f.name), here, there) if isinstance(f.dataType, T.StringType) else col(f.name)).alias(f.name.translate(table)) for f in df.schema])


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The named or first sheet, through pandas on the driver (a sheet holds at most 1,048,576 rows); wholly empty rows go."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise NotSupported(f"{path}: reading Excel needs openpyxl") from e
    import pandas as pd

    book = pd.ExcelFile(path)
    if sheet is None and len(book.sheet_names) > 1:
        warnings.warn(f"{path} has sheets {book.sheet_names}; the first is read", stacklevel=2)
    frame = book.parse(sheet or book.sheet_names[0]).dropna(how="all")
    if odd := [c for c in frame.columns if str(c).startswith("Unnamed")]:
        warnings.warn(f"{path} has columns without a header: {odd}", stacklevel=2)
    return spark.createDataFrame(frame)


def read_jdbc(spark: SparkSession, table: str, url: str | None = None, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table over JDBC, read only; credentials come from options or JDBC_URL, JDBC_USER and JDBC_PASSWORD.
    ``partition``: column, low, high and number of parallel ranges, without which one task reads all."""
    found = {"url": url or os.environ.get("JDBC_URL"), "user": os.environ.get("JDBC_USER"), "password": os.environ.get("JDBC_PASSWORD")} | options
    if not found["url"]:
        raise SourceError("a JDBC source needs a url")
    reader = spark.read.format("jdbc").options(dbtable=table, sessionInitStatement="SET default_transaction_read_only = on" if "postgresql" in found["url"] else "", **{k: v for k, v in found.items() if v})
    if partition:
        c, lo, hi, n = partition
        reader = reader.options(partitionColumn=c, lowerBound=lo, upperBound=hi, numPartitions=n)
    return reader.load()


def read_joined(spark: SparkSession, sources: dict[str, str], view_sql: str, extra_views: dict[str, str] | None = None) -> DataFrame:
    """Files as views, a declared join over them, and further views."""
    for alias, path in sources.items():
        read_path(spark, path).createOrReplaceTempView(alias)
    out = spark.sql(view_sql)
    for name, sql in (extra_views or {}).items():
        spark.sql(sql).createOrReplaceTempView(name)
    return out


def read_path(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix in (".csv", ".tsv", ".tab", ".txt"):
        return read_csv(spark, path, schema, **options)
    if suffix == ".parquet":
        return spark.read.options(**options).parquet(path)
    if suffix in (".json", ".jsonl"):
        reader = spark.read.options(**options)
        return (reader.schema(schema) if schema else reader).json(path)
    if suffix == ".orc":
        return spark.read.options(**options).orc(path)
    if suffix in (".xlsx", ".xls", ".xlsm"):
        return read_excel(spark, path, options.get("sheet"))
    raise NotSupported(f"{path}: no reader for {suffix or 'a path without suffix'}")


@dataclass(frozen=True)
class Resolved:
    df: DataFrame
    name: str
    answered_by: str
    errors: tuple[str, ...] = ()


class Registry:
    """Sources by name."""

    def __init__(self, spark: SparkSession, specs: list[Spec]):
        self.spark, self.specs = spark, {s.name: s for s in specs}

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Registry:
        import yaml

        with open(path) as f:
            declared = yaml.safe_load(f)["sources"]
        known = set(Spec.__dataclass_fields__)
        rename = {"table_name": "table", "derived_columns": "derived"}
        specs = []
        for name, spec in declared.items():
            fields = {rename.get(k, k): v for k, v in spec.items()}
            specs.append(Spec(name, **{k: v for k, v in fields.items() if k in known and k != "name"}))
        return cls(spark, specs)

    def names(self) -> list[str]:
        return sorted(self.specs)

    def spec(self, name: str) -> Spec:
        if name not in self.specs:
            raise SourceError(f"no source {name}; there are {', '.join(self.names())}")
        return self.specs[name]

    def read(self, name: str) -> DataFrame:
        s = self.spec(name)
        if s.kind in ("csv", "parquet", "json", "orc", "excel", "file"):
            df = read_excel(self.spark, s.path, s.sheet) if s.kind == "excel" else read_path(self.spark, s.path, s.schema, **s.options)
        elif s.kind in ("joined", "joined_csv"):
            df = read_joined(self.spark, s.sources, s.view_sql, s.extra_views)
        elif s.kind in ("postgres", "jdbc"):
            df = read_jdbc(self.spark, s.table, s.path, **s.options)
        elif s.kind in ("table", "databricks"):
            df = self.spark.table(s.table)
        elif s.kind in ("snowflake", "bigquery"):
            raise NotSupported(f"{name}: {s.kind} needs its connector on the class path; use kind jdbc or table")
        else:
            raise NotSupported(f"{name}: no kind {s.kind}")
        df = append(df, s.derived) if s.derived else df
        if s.row_limit is not None:
            warnings.warn(f"{name} is cut to {s.row_limit} rows; numbers are not of the whole source", stacklevel=2)
            df = df.limit(s.row_limit)
        df.createOrReplaceTempView(s.table if s.table and s.kind not in ("table", "databricks", "postgres", "jdbc") else name)
        return df

    def resolve(self, name: str) -> Resolved:
        """The source, or its declared copy when it cannot be read."""
        s, errors = self.spec(name), []
        try:
            df = self.read(name)
            df.limit(1).collect()
            return Resolved(df, name, "primary")
        except (SourceError, AnalysisException, OSError) as e:
            errors.append(str(e).splitlines()[0])
        except Exception as e:  # a reader's own failure, kept for the report
            errors.append(f"{type(e).__name__}: {str(e).splitlines()[0]}")
        if not s.fallback:
            raise SourceError(f"{name} cannot be read and has no copy: {errors[0]}")
        df = read_path(self.spark, s.fallback, s.schema)
        df = append(df, s.derived) if s.derived else df
        df.createOrReplaceTempView(name)
        return Resolved(df, name, "fallback", tuple(errors))

    def is_live(self, name: str) -> bool:
        try:
            return self.resolve(name).answered_by == "primary"
        except SourceError:
            return False


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def table_schema(spark: SparkSession, name: str) -> list[tuple[str, str, bool]]:
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in spark.table(name).schema]


def write_scores(scored: DataFrame, path: str, view: str | None = None) -> None:
    """Scores as CSV with a header, and as a view. Files stay as many as there are partitions; a reader takes the folder."""
    if view:
        scored.createOrReplaceTempView(view)
    scored.write.mode("overwrite").csv(path, header=True)


def star(orders: DataFrame, dims: list[tuple[DataFrame, str, str]], most_bytes: int = 64 << 20) -> DataFrame:
    """Left equi-joins of dimensions to a fact table. A dimension's repeated rows go first. Which side is broadcast is the
    optimiser's choice by measured size, so a dimension that has grown is shuffled."""
    out = orders
    for dim, left, right in dims:
        out = out.join(dim.dropDuplicates(), col(left) == col(right), "left")
    return out
