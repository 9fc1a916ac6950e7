"""The quality score: ten dimensions from 0 to 100, weighted."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.columns import col, safe_date
from ..profile import date_column, distinct_rows
from .repairs import Issue, critical_issues, detect

# Penalties by severity, the dimension of each module's issues, weights, bands.
PENALTY = {"HIGH": 40, "MED": 20, "LOW": 8, "INFO": 0}
DIMENSION = {
    "date_repair": "type_safety", "numeric_type_repair": "type_safety", "boolean_repair": "type_safety",
    "country_standardisation": "consistency", "whitespace_repair": "consistency", "case_standardisation": "consistency",
    "month_repair": "semantic_accuracy", "quarter_repair": "semantic_accuracy", "year_repair": "semantic_accuracy", "region_repair": "semantic_accuracy",
}
WEIGHT = {
    "completeness": 0.15, "uniqueness": 0.10, "validity": 0.10, "freshness": 0.08, "consistency": 0.12, "semantic_accuracy": 0.12,
    "type_safety": 0.10, "referential_integrity": 0.05, "business_readiness": 0.13, "documentation": 0.05,
}
BANDS = [(90, "Excellent"), (75, "Good"), (60, "Fair"), (float("-inf"), "Poor")]


@dataclass(frozen=True)
class Report:
    row_count: int
    dimensions: dict[str, float]
    overall: float
    band: str
    issues: tuple[Issue, ...]
    freshness: str | None = None
    not_assessed: tuple[str, ...] = field(default=())

    @property
    def critical(self) -> int:
        return len(critical_issues(list(self.issues)))


def score_table(df: DataFrame, issues: list[Issue] | None = None, documented: bool = False) -> Report:
    issues = detect(df) if issues is None else issues
    structural = {i.column for i in issues if i.module == "null_classification"}
    superseded = {c for c in df.columns if f"{c}_Clean" in df.columns}
    counted = [c for c in df.columns if c not in structural | superseded]
    nulls = df.agg(F.count("*").alias("_rows"), *[F.count_if(col(c).isNull()).alias(f"n:{c}") for c in counted]).first()
    rows = nulls["_rows"]
    if not rows:
        return Report(0, dict.fromkeys(WEIGHT, 0.0), 0.0, "Poor", tuple(issues))
    cut = lambda x: max(0.0, min(100.0, x))
    penalty = dict.fromkeys(("consistency", "semantic_accuracy", "type_safety", "validity"), 0)
    for i in issues:
        if i.module in DIMENSION:
            penalty[DIMENSION[i.module]] += PENALTY[i.severity]
    dated = date_column(df)
    latest = None
    if dated:
        latest = df.agg(F.max(safe_date(col(dated[0])) if dated[1] else col(dated[0]).cast("date")).cast("string")).first()[0]
    extra = distinct_rows(df).first()["duplicate_rows"]
    dimensions = {
        "completeness": 100 * (1 - sum(nulls[f"n:{c}"] / rows for c in counted) / len(counted)) if counted else 100.0,
        "uniqueness": 100 * (1 - extra / rows),
        "freshness": 100.0 if not dated or not dated[1] else 90.0,
        "referential_integrity": 100.0,
        "business_readiness": 100.0 - 25 * len(critical_issues(issues)),
        "documentation": 100.0 if documented else 60.0,
    } | {d: 100.0 - p for d, p in penalty.items()}
    dimensions = {d: round(cut(dimensions[d]), 2) for d in WEIGHT}
    overall = round(sum(dimensions[d] * w for d, w in WEIGHT.items()), 2)
    band = next(name for least, name in BANDS if overall >= least)
    return Report(rows, dimensions, overall, band, tuple(issues), latest, ("referential_integrity", "validity"))


def overall_confidence(parts: list[tuple[float, float]]) -> float:
    """0.6 of the weighted mean and 0.4 of the least of (value, weight) pairs."""
    total = sum(w for _, w in parts)
    return 0.6 * sum(v * w for v, w in parts) / total + 0.4 * min(v for v, _ in parts) if total else 0.0
