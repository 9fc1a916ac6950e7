"""What is known about metrics and tables: glossary, owners, catalogue entries, experiments, follow-up of decisions."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame

from ..functions import stats
from ..operators.profile import distinct_rows
from ..operators.quality.clean import snapshot
from ..operators.quality.score import score_table
from .export import certify
from .semantic import METRICS, Metric


@dataclass
class Glossary:
    """Terms with their meaning, other names and the owner of decisions about them."""

    terms: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Glossary:
        import yaml

        with open(path) as f:
            return cls(yaml.safe_load(f)["terms"])

    def resolve(self, name: str) -> dict | None:
        key = name.strip().lower()
        for term, spec in self.terms.items():
            if key == term.lower() or key in (a.lower() for a in spec.get("aliases", ())):
                return {"term": term} | spec
        return None

    def owner(self, name: str, otherwise: str = "unassigned") -> str:
        return (self.resolve(name) or {}).get("owner", otherwise)


def metric_dictionary(metrics: dict[str, Metric] = METRICS, glossary: Glossary | None = None) -> list[dict]:
    """The locked metrics as rows."""
    own = glossary or Glossary()
    return [{"metric": m.name, "formula": m.expression, "unit": m.unit, "grain": list(m.grain), "aliases": list(m.aliases), "decomposition": m.decomposition, "owner": own.owner(m.name)} for m in sorted(metrics.values(), key=lambda m: m.name)]


def catalog_entry(df: DataFrame, name: str, owner: str = "unassigned", documented: bool = False) -> dict:
    """A table's schema, rows, grain, quality and standing."""
    report, counts = score_table(df, documented=documented), distinct_rows(df).first()
    return {
        "table": name, "owner": owner, "schema": snapshot(df), "row_count": report.row_count, "unique_rows": counts["duplicate_rows"] == 0, "score": report.overall, "band": report.band,
        "freshness": report.freshness, "certification": certify(report.overall, report.critical, documented), "issues": len(report.issues), "ts": datetime.now(timezone.utc).isoformat(),
    }


class Catalog:
    """Entries by table, as JSON."""

    def __init__(self, path: str):
        self.path = Path(path)
        self.entries: dict[str, dict] = json.loads(self.path.read_text()) if self.path.exists() else {}

    def put(self, entry: dict) -> None:
        self.entries[entry["table"]] = entry
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps(self.entries, indent=1, sort_keys=True))

    def listed(self, certification: str | None = None) -> list[dict]:
        return [e for _, e in sorted(self.entries.items()) if certification in (None, e["certification"])]


def design_experiment(metric: str, base: float, effect: float, per_day: int, power: float = 0.8, alpha: float = stats.ALPHA, guardrails: tuple[str, ...] = ()) -> dict:
    """Rows per arm, days at ``per_day`` rows over both arms, the power really reached and the least effect it finds."""
    n = stats.sample_size(base, effect, power, alpha)
    days = -(-2 * n // per_day)
    return {"metric": metric, "per_arm": n, "days": days, "power": stats.power_at(n, base, effect, alpha), "detectable": stats.detectable_effect(n, base, power, alpha), "guardrails": list(guardrails), "warnings": ["longer than four weeks"] if days > 28 else []}


def close_the_loop(promised: float, before: float, after: float, tolerance: float = 0.1) -> dict:
    """What a decision was to change, and what changed."""
    measured = after - before
    met = promised != 0 and measured * promised > 0 and abs(measured) >= (1 - tolerance) * abs(promised)
    return {"promised": promised, "measured": measured, "share": measured / promised if promised else None, "met": met}
