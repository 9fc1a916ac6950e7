"""Repair modules: each names what one fused aggregate must measure, judges the figures, and repairs by a column.

``detect`` runs the measures of all modules and columns in one scan (distinct counts, which would multiply rows, come
from the unpivoted profile), so issues cost two passes whatever the number of columns. Users add modules with @register.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.columns import col, is_date, is_text, safe_date, safe_double
from ..profile import date_column, distinct_rows
from . import rules

SEVERITY = {"HIGH": 0, "MED": 1, "LOW": 2, "INFO": 3}


@dataclass(frozen=True)
class Issue:
    module: str
    column: str | None
    severity: str
    count: int
    detail: str
    confidence: float = 1.0
    structural: bool = False
    repair: Column | None = field(default=None, compare=False)
    needs_approval: bool = False

    @property
    def clean_name(self) -> str | None:
        return f"{self.column}_Clean" if self.column else None

    @property
    def critical(self) -> bool:
        return self.severity == "HIGH" and not self.structural


@dataclass(frozen=True)
class Module:
    """measures(df, column) -> {name: aggregate}; judge(column, figures, rows) -> Issue or None."""

    name: str
    applies: Callable[[DataFrame, str], bool]
    measures: Callable[[DataFrame, str], dict[str, Column]]
    judge: Callable[[DataFrame, str, dict, int], Issue | None]
    enabled: bool = True


MODULES: dict[str, Module] = {}


def register(module: Module) -> Module:
    if module.name in MODULES:
        raise ValueError(f"{module.name} is registered already")
    MODULES[module.name] = module
    return module


def _text(df: DataFrame, c: str) -> bool:
    return is_text(df.schema[c].dataType)


def _lookup(value: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(F.trim(value)))


def boolean_of(value: Column) -> Column:
    word = F.lower(F.trim(value))
    return F.when(word.isin(*rules.TRUE_WORDS), True).when(word.isin(*rules.FALSE_WORDS), False)


def country_of(value: Column) -> Column:
    return F.coalesce(_lookup(value, rules.CANONICAL_COUNTRY), F.trim(value))


def region_of(region: Column, country: Column) -> Column:
    return F.coalesce(region, _lookup(country, rules.COUNTRY_REGION))


def month_of(day: Column) -> Column:
    return F.date_format(day, "MMM")


def quarter_of(day: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"))


def year_of(day: Column) -> Column:
    return F.year(day).cast("string")


def _share(figures: dict, top: str, bottom: str) -> float:
    return figures[top] / figures[bottom] if figures[bottom] else 0.0


def _date(df, c, f, rows):
    if f["non_null"] and _share(f, "dates", "non_null") >= rules.PARSE_RATE:
        return Issue("date_repair", c, "HIGH", f["dates"], f"{f['dates']} texts are dates", _share(f, "dates", "non_null"), repair=safe_date(col(c)))


register(Module("date_repair", _text, lambda df, c: {"non_null": F.count(col(c)), "dates": F.count(safe_date(col(c)))}, _date))


def _numeric(df, c, f, rows):
    if f["non_null"] and _share(f, "numbers", "non_null") >= rules.PARSE_RATE and _share(f, "dates", "non_null") < rules.PARSE_RATE:
        return Issue("numeric_type_repair", c, "MED", f["numbers"], f"{f['numbers']} texts are numbers", _share(f, "numbers", "non_null"), repair=safe_double(col(c)))


register(Module("numeric_type_repair", _text, lambda df, c: {"non_null": F.count(col(c)), "numbers": F.count(safe_double(col(c))), "dates": F.count(safe_date(col(c)))}, _numeric))


def _boolean(df, c, f, rows):
    if f["non_null"] and f["words"] == f["non_null"]:
        return Issue("boolean_repair", c, "LOW", f["words"], "all values mean yes or no", repair=boolean_of(col(c)))


register(Module("boolean_repair", _text, lambda df, c: {"non_null": F.count(col(c)), "words": F.count(boolean_of(col(c)))}, _boolean))


def _whitespace(df, c, f, rows):
    if f["padded"]:
        return Issue("whitespace_repair", c, "LOW", f["padded"], f"{f['padded']} values have outer blanks", repair=F.trim(col(c)))


register(Module("whitespace_repair", _text, lambda df, c: {"padded": F.count_if(col(c) != F.trim(col(c)))}, _whitespace))


def _case(df, c, f, rows):
    if f["distinct"] - f["folded"] >= 1:
        return Issue("case_standardisation", c, "LOW", f["distinct"] - f["folded"], f"{f['distinct']} spellings of {f['folded']} values", repair=F.upper(F.trim(col(c))))


register(Module("case_standardisation", _text, lambda df, c: {}, _case))


def _country(df, c, f, rows):
    if f["changed"]:
        return Issue("country_standardisation", c, "MED", f["changed"], f"{f['changed']} countries in other spellings", repair=country_of(col(c)))


register(Module("country_standardisation", lambda df, c: c.lower() == "country" and _text(df, c), lambda df, c: {"changed": F.count_if(col(c) != country_of(col(c)))}, _country))


def _country_column(df: DataFrame) -> str | None:
    return next((c for c in df.columns if c.lower() == "country"), None)


def _region(df, c, f, rows):
    if f["nulls"] and f["found"]:
        return Issue("region_repair", c, "HIGH", f["found"], f"{f['found']} of {f['nulls']} missing regions follow from the country", _share(f, "found", "nulls"), repair=region_of(col(c), col(_country_column(df))))


register(Module("region_repair", lambda df, c: c.lower() == "region" and _country_column(df) is not None, lambda df, c: {"nulls": F.count_if(col(c).isNull()), "found": F.count_if(col(c).isNull() & region_of(col(c), col(_country_column(df))).isNotNull())}, _region))


def _day(df: DataFrame, found: tuple[str, bool] | None) -> Column | None:
    if not found:
        return None
    return safe_date(col(found[0])) if found[1] else col(found[0])


LABELS = {"month": (month_of, 0.98), "quarter": (quarter_of, 0.70), "year": (year_of, 0.98)}


def label_mismatch(df: DataFrame, stored: Column, derived: Column) -> DataFrame:
    """One row: compared, mismatched."""
    both = stored.isNotNull() & derived.isNotNull()
    return df.agg(F.count_if(both).alias("compared"), F.count_if(both & (stored.cast("string") != derived.cast("string"))).alias("mismatched"))


def detect(df: DataFrame, modules: list[str] | None = None) -> list[Issue]:
    """All issues, by severity, module and column; columns that a <name>_Clean stands for are skipped."""
    superseded = {c for c in df.columns if f"{c}_Clean" in df.columns}
    names = [c for c in df.columns if c not in superseded and not c.endswith("_Clean")]
    active = [m for n, m in sorted(MODULES.items()) if m.enabled and (modules is None or n in modules)]
    plan = [(m, c) for m in active for c in names if m.applies(df, c)]
    aggregates = {}
    for i, (m, c) in enumerate(plan):
        for k, e in m.measures(df, c).items():
            aggregates[f"{i}:{k}"] = e
    texts = [c for c in names if _text(df, c)]
    shares = {f"t:{c}": F.try_divide(F.count(safe_date(col(c))), F.count(col(c))) for c in texts}
    nulls = {f"n:{c}": F.count_if(col(c).isNull()) for c in names}
    row = df.agg(F.count("*").alias("rows"), *[e.alias(k) for k, e in (aggregates | shares | nulls).items()]).first()
    rows = row["rows"]
    folded: dict[str, tuple[int, int]] = {}
    if texts:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in texts])
        values = df.select(F.inline(pairs)).filter("value IS NOT NULL").distinct()
        kinds = values.withColumn("f", F.lower(F.trim(F.col("value")))).groupBy("column", "f").agg(F.count("*").alias("n"))
        folded = {r["column"]: (r["d"], r["f"]) for r in kinds.groupBy("column").agg(F.sum("n").alias("d"), F.count("*").alias("f")).collect()}
    found = []
    for i, (m, c) in enumerate(plan):
        figures = {k: row[f"{i}:{k}"] for k in m.measures(df, c)}
        figures["distinct"], figures["folded"] = folded.get(c, (0, 0))
        if issue := m.judge(df, c, figures, rows):
            found.append(issue)
    use = lambda n: modules is None or n in modules
    dated = date_column(df, {c: row[f"t:{c}"] for c in texts if row[f"t:{c}"] is not None})
    day = _day(df, dated)
    labels = [c for c in names if c.lower() in LABELS and use(f"{c.lower()}_repair")]
    if day is not None and labels:
        derived = {c: LABELS[c.lower()][0](day) for c in labels}
        wrong = lambda c: col(c).isNotNull() & derived[c].isNotNull() & (col(c).cast("string") != derived[c])
        counts = df.agg(*[F.count_if(wrong(c)).alias(c) for c in labels]).first()
        for c in labels:
            if n := counts[c]:
                confidence = LABELS[c.lower()][1]
                found.append(Issue(f"{c.lower()}_repair", c, "HIGH" if n > rules.MISMATCH_HIGH * rows else "MED", n, f"{n} labels disagree with {dated[0]}", confidence, repair=derived[c], needs_approval=confidence < rules.AUTO_APPLY))
    if use("duplicate_detection") and rows:
        extra = distinct_rows(df).first()["duplicate_rows"]
        if extra:
            found.append(Issue("duplicate_detection", None, "HIGH" if extra > rules.DUPLICATES_HIGH * rows else "MED", extra, f"{extra} rows repeat others in full"))
    if use("null_classification") and rows:
        for c in names:
            rate = row[f"n:{c}"] / rows
            if rules.STRUCTURAL_NULLS <= rate < 1:
                found.append(Issue("null_classification", c, "INFO", row[f"n:{c}"], f"{rate:.0%} null, taken as by design", structural=True))
    return sorted(found, key=lambda i: (SEVERITY[i.severity], i.module, i.column or ""))


def critical_issues(issues: list[Issue]) -> list[Issue]:
    return [i for i in issues if i.critical]


def is_dated(df: DataFrame) -> bool:
    return any(is_date(f.dataType) for f in df.schema)
