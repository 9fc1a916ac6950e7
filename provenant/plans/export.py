"""Results as text: html, markdown, chat, mail, brief. Nothing leaves without evidence."""

from __future__ import annotations

import html
from collections.abc import Callable

from .evidence import Ledger

EXPORTERS: dict[str, Callable[[dict], str]] = {}


class NoEvidence(ValueError):
    """A number has no backed claim."""


def exporter(name: str):
    def put(f):
        if name in EXPORTERS:
            raise ValueError(f"{name} is registered already")
        EXPORTERS[name] = f
        return f

    return put


def _rows(report: dict) -> list[tuple[str, str]]:
    return [(k, f"{v:,.4g}" if isinstance(v, (int, float)) else str(v)) for k, v in report["numbers"].items()]


@exporter("html")
def _html(report: dict) -> str:
    body = "".join(f"<tr><td>{html.escape(k)}</td><td>{html.escape(v)}</td></tr>" for k, v in _rows(report))
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(report['title'])}</title><h1>{html.escape(report['title'])}</h1><table>{body}</table><p>{html.escape(report.get('recommendation', ''))}</p>"


@exporter("markdown")
def _markdown(report: dict) -> str:
    return f"# {report['title']}\n\n| number | value |\n|---|---|\n" + "".join(f"| {k} | {v} |\n" for k, v in _rows(report)) + f"\n{report.get('recommendation', '')}\n"


@exporter("slack")
def _slack(report: dict) -> str:
    return f"*{report['title']}*\n" + "\n".join(f"• {k}: {v}" for k, v in _rows(report)[:5]) + f"\n_{report.get('recommendation', '')}_"


@exporter("email")
def _email(report: dict) -> str:
    return f"Subject: {report['title']}\n\n" + "\n".join(f"{k}: {v}" for k, v in _rows(report)) + f"\n\n{report.get('recommendation', '')}\n"


@exporter("exec")
def _exec(report: dict) -> str:
    k, v = next(iter(_rows(report)), ("no number", ""))
    return f"{report['title']}: {k} {v}. {report.get('recommendation', '')}".strip()


@exporter("dax")
def _dax(report: dict) -> str:
    """The measures of a report (name, expression, format, confidence), each with how it came about."""
    parts = [f"-- {m.confidence}\n{m.name} =\n    {m.expression}\n" for m in report.get("measures", ())]
    return f"-- {report['title']}\n\n" + "\n".join(parts)


def emit(name: str, report: dict, ledger: Ledger) -> str:
    """The report in a format; an unknown format and a number without evidence are refused."""
    if name not in EXPORTERS:
        raise KeyError(f"no format {name}; there are {', '.join(sorted(EXPORTERS))}")
    if orphans := ledger.orphans(list(report["numbers"])):
        raise NoEvidence(f"no evidence for {', '.join(orphans)}")
    return EXPORTERS[name](report)


def lineage(source: str, steps: list[str], metric: str, query_hash: str, deliverable: str) -> list[tuple[str, str]]:
    """Edges from a source through its repairs to what is delivered."""
    path = [f"source:{source}", *[f"step:{s}" for s in steps], f"metric:{metric}", f"query:{query_hash}", f"deliverable:{deliverable}"]
    return list(zip(path, path[1:]))


def contrast_ratio(a: str, b: str) -> float:
    """Of two #rrggbb colours, 1 to 21."""
    def light(c: str) -> float:
        parts = [int(c.lstrip("#")[i:i + 2], 16) / 255 for i in (0, 2, 4)]
        r, g, bl = (p / 12.92 if p <= 0.03928 else ((p + 0.055) / 1.055) ** 2.4 for p in parts)
        return 0.2126 * r + 0.7152 * g + 0.0722 * bl

    hi, lo = sorted((light(a), light(b)), reverse=True)
    return (hi + 0.05) / (lo + 0.05)


def spread_labels(places: list[float], gap: float) -> list[float]:
    """Label places moved up until none is nearer than gap to the one below, in the given order."""
    order = sorted(range(len(places)), key=lambda i: (places[i], i))
    out, last = list(places), float("-inf")
    for i in order:
        out[i] = last = max(places[i], last + gap)
    return out


def certify(score: float, critical: int, documented: bool) -> str:
    """The standing of a catalogue entry."""
    if critical or score < 60:
        return "uncertified"
    return "certified" if score >= 90 and documented else "provisional"
