"""Named checks that run over a table on their own; the first says whether its clean layer is fit for use."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.quality.clean import CleanLayer
from ..operators.quality.repairs import critical_issues
from ..operators.quality.score import Report, score_table
from .evidence import Journal

COPILOTS: dict[str, Callable[[DataFrame, str], dict]] = {}


def copilot(name: str):
    def put(f: Callable[[DataFrame, str], dict]):
        if name in COPILOTS:
            raise ValueError(f"{name} is registered already")
        COPILOTS[name] = f
        return f

    return put


@dataclass(frozen=True)
class Decision:
    decision: str
    ready: bool
    reason: str


def decide(after: Report, pending: list[str], hopeless: list[str], least: float = 60.0, good: float = 90.0) -> Decision:
    """NO-GO below ``least`` or with a critical issue that no step repairs; with caveats while steps wait for approval, the
    score is below ``good`` or a warning is left; else GO."""
    if after.overall < least:
        return Decision("NO-GO", False, f"the clean layer scores {after.overall:.0f} of at least {least:.0f}")
    if hopeless:
        return Decision("NO-GO", False, f"no repair for {', '.join(hopeless)}")
    if pending:
        return Decision("GO-WITH-CAVEATS", True, f"waiting for approval: {', '.join(pending)}")
    left = [i for i in after.issues if not i.critical]
    if after.overall < good or left:
        return Decision("GO-WITH-CAVEATS", True, f"score {after.overall:.0f}, {len(left)} warnings")
    return Decision("GO", True, "")


@copilot("data-quality")
def data_quality(df: DataFrame, source: str, approve: tuple[str, ...] = ()) -> dict:
    """Scores a table, applies the repairs that are sure or approved, and decides on what comes out."""
    layer = CleanLayer(df)
    planned = layer.plan()
    before = score_table(df, layer.issues)
    clean = layer.apply(approve)
    after = score_table(clean) if layer.applied else before
    pending, known = [s.name for s in layer.pending()], {(s.module, s.column) for s in planned} | {(None, s.column) for s in planned if s.column}
    hopeless = [f"{i.module}:{i.column or '*'}" for i in critical_issues(list(after.issues)) if (i.module, i.column) not in known and (None, i.column) not in known]
    out = decide(after, pending, hopeless)
    return {
        "source": source, "score_before": before.overall, "score_after": after.overall, "applied": [s.name for s in layer.applied], "pending": pending, "unrepairable": hopeless,
        "decision": out.decision, "ready": out.ready, "reason": out.reason, "clean": clean,
    }


def remember_repairs(journal: Journal, source: str, layer: CleanLayer) -> int:
    """Notes the applied steps; those noted before are not noted again. The number of new ones."""
    return sum(journal.add("repair", source=source, module=s.module, column=s.column, confidence=s.confidence) for s in layer.applied)


def recall_repairs(journal: Journal, source: str) -> tuple[str, ...]:
    """Names of the steps that were applied to the source before, to be approved again."""
    return tuple(f"{r['module']}:{r['column'] or '*'}" for r in journal.read("repair") if r["source"] == source)


def next_actions(pending: list[str], driver_found: bool, forecast_made: bool, experiment_made: bool = False) -> list[str]:
    """What to do after an analysis, most urgent first."""
    ways = [
        (bool(pending), f"approve or refuse the waiting repairs: {', '.join(pending)}"),
        (driver_found, "watch the driver that was found as a weekly figure"),
        (not forecast_made, "forecast the metric to see whether it will happen again"),
        (not experiment_made, "design an experiment before money is spent on the recommendation"),
    ]
    return [text for due, text in ways if due]
