"""Driver-side graph of steps over Spark jobs: tiers, retries, timeouts that cancel, a circuit breaker, resume."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

from pyspark import InheritableThread
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Node:
    name: str
    run: Callable[[dict], object]
    deps: tuple[str, ...] = ()
    critical: bool = True
    timeout_s: float = 600.0
    retries: int = 1


def tiers(nodes: list[Node]) -> list[list[str]]:
    """Names in layers, each after all it depends on; a cycle or an unknown name raises."""
    left = {n.name: set(n.deps) for n in nodes}
    if unknown := {d for deps in left.values() for d in deps} - set(left):
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    out = []
    while left:
        free = sorted(n for n, deps in left.items() if not deps)
        if not free:
            raise ValueError(f"a cycle among {sorted(left)}")
        out.append(free)
        left = {n: deps - set(free) for n, deps in left.items() if n not in free}
    return out


@dataclass
class State:
    """What each step returned (as JSON, for resume) and how it ended."""

    path: str | None = None
    outputs: dict = field(default_factory=dict)
    status: dict = field(default_factory=dict)
    #: open, complete or failed.
    standing: str = "open"

    def save(self) -> None:
        if self.path:
            Path(self.path).parent.mkdir(parents=True, exist_ok=True)
            Path(self.path).write_text(json.dumps({"outputs": {k: v for k, v in self.outputs.items() if _plain(v)}, "status": self.status, "standing": self.standing}))

    def end(self, standing: str) -> None:
        self.standing = standing
        self.save()

    @classmethod
    def load(cls, path: str) -> State:
        if not Path(path).exists():
            return cls(path)
        saved = json.loads(Path(path).read_text())
        done = {k for k, s in saved["status"].items() if s == "done" and k in saved["outputs"]}
        return cls(path, {k: saved["outputs"][k] for k in done}, {k: "done" for k in done})


def runs(folder: str) -> list[dict]:
    """The runs whose states (<run>.json) lie in a folder, the latest first: run, standing, steps done, steps failed."""
    out = []
    for p in sorted(Path(folder).glob("*.json"), key=lambda p: (-p.stat().st_mtime_ns, p.name)):
        saved = json.loads(p.read_text())
        if "status" in saved and "outputs" in saved:
            named = lambda s: [k for k, v in saved["status"].items() if v == s]
            out.append({"run": p.stem, "standing": saved.get("standing", "open"), "done": named("done"), "failed": named("failed")})
    return out


def _plain(v: object) -> bool:
    try:
        json.dumps(v)
    except TypeError:
        return False
    return True


class StepFailed(RuntimeError):
    pass


def run_graph(spark: SparkSession | None, nodes: list[Node], state: State | None = None, at_once: int = 3, breaker: int = 3) -> State:
    """Runs the graph. Each step's jobs are a job group: at its timeout they are cancelled. A failed step that is not
    critical leaves None; a critical one ends the run, as do ``breaker`` failures in a tier. Finished steps are skipped."""
    state, by = state or State(), {n.name: n for n in nodes}

    def once(n: Node) -> object:
        box: dict = {}

        def work() -> None:
            try:
                if spark:
                    spark.sparkContext.setJobGroup(f"step-{n.name}", n.name, interruptOnCancel=True)
                box["value"] = n.run({d: state.outputs.get(d) for d in n.deps})
            except Exception as e:  # the step's own failure, raised again below
                box["error"] = e

        t = InheritableThread(target=work, daemon=True) if spark else threading.Thread(target=work, daemon=True)
        t.start()
        t.join(n.timeout_s)
        if t.is_alive():
            if spark:
                spark.sparkContext.cancelJobGroup(f"step-{n.name}")
            raise TimeoutError(f"{n.name} took more than {n.timeout_s} s")
        if "error" in box:
            raise box["error"]
        return box["value"]

    def attempt(n: Node) -> tuple[str, object]:
        for left in range(n.retries, -1, -1):
            try:
                return "done", once(n)
            except Exception as e:
                if not left or isinstance(e, TimeoutError):
                    return "failed", e
        raise AssertionError

    for tier in tiers(nodes):
        todo = [by[t] for t in tier if state.status.get(t) != "done"]
        with ThreadPoolExecutor(max_workers=at_once) as pool:
            results = list(pool.map(attempt, todo))
        failures = [(n, e) for n, (s, e) in zip(todo, results) if s == "failed"]
        for n, (s, v) in zip(todo, results):
            state.status[n.name], state.outputs[n.name] = s, v if s == "done" else None
        state.save()
        bad = next(((n, e) for n, e in failures if n.critical), None)
        if bad or len(failures) >= breaker:
            state.end("failed")
        if bad:
            raise StepFailed(f"{bad[0].name}: {bad[1]}") from bad[1]
        if len(failures) >= breaker:
            raise StepFailed(f"{len(failures)} steps of one tier failed")
    state.end("complete")
    return state
