"""Analyses from a bound table to claims, each with an independent second derivation by a differently built plan."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.columns import col, ratio
from ..operators import assoc, bins, decompose, profile, series
from ..operators.model import logit, metrics
from ..operators.model.tiers import TierPolicy
from ..operators.quality.clean import CleanLayer
from ..operators.quality.score import score_table
from . import evidence as ev
from .dag import Node, State, StepFailed, run_graph
from .runlog import Engine
from .semantic import Binding, Metric, Requirement, bind, cap_features, classify, metric_from_text, period_hints, plan_run, select_playbook, split_features

PLAYBOOKS: dict[str, type] = {}


def register(cls: type) -> type:
    if cls.id in PLAYBOOKS:
        raise ValueError(f"{cls.id} is registered already")
    PLAYBOOKS[cls.id] = cls
    return cls


@dataclass
class Outcome:
    """What a playbook found: numbers for claims, ranked findings, validation layers, a plan for the model."""

    numbers: dict[str, float] = field(default_factory=dict)
    findings: list[dict] = field(default_factory=list)
    layers: list[ev.Layer] = field(default_factory=list)
    feature_plan: dict = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)
    attacks: list[str] = field(default_factory=list)


@dataclass
class Context:
    engine: Engine
    df: DataFrame
    binding: Binding
    question: str = ""
    params: dict = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.engine.spark


@register
class Margin:
    """Why a margin moved between two periods."""

    id = "margin"
    needs = (
        Requirement("value", shape="numeric", hints=("revenue", "sales")), Requirement("cost", shape="numeric", hints=("cogs", "cost")),
        Requirement("time", hints=("quarter", "period", "year", "month")), Requirement("dimension", hints=("product_line", "segment", "category")),
    )

    def explore(self, c: Context) -> Outcome:
        dim, period, value, cost = (c.binding.roles[r][0] for r in ("dimension", "time", "value", "cost"))
        p1, p2 = c.params["p1"], c.params["p2"]
        effects = c.engine.run(decompose.decompose_margin(c.df, dim, period, p1, p2, value, cost), f"margin {dim} {p1} {p2}").df
        total = decompose.margin_totals(effects).first()
        simpson = decompose.simpsons_check(c.df.withColumn("_profit", col(value) - col(cost)), dim, period, p1, p2, "_profit", value).first()
        ranked = effects.withColumn("_at", F.row_number().over(Window.orderBy(F.abs("total").desc(), "segment")))
        parts = [r.asDict() for r in ranked.where("_at <= 50").orderBy("_at").drop("_at").collect()]
        notes = [f"dominant effect: {total['dominant']}"]
        sums = {k: F.sum(k).alias(k) for k in ("share_1", "share_2", "mix", "rate", "interaction", "total")}
        margins = [ratio(F.sum(F.col(f"share_{i}") * F.col(f"margin_{i}")), F.sum(f"share_{i}")).alias(f"margin_{i}") for i in (1, 2)]
        rest = ranked.where("_at > 50").agg(F.count("*").alias("n"), *sums.values(), *margins).first().asDict()
        n = rest.pop("n")
        if n:
            parts.append({"segment": f"{n} other segments"} | rest)
            notes.append(f"{n} segments of smaller effect are one part")
        numbers = {k: total[k] for k in ("margin_1", "margin_2", "delta", "mix", "rate", "interaction")}
        layers = [ev.structural(len(parts)), ev.identity([total["mix"], total["rate"], total["interaction"]], total["delta"]), ev.in_range({"margin_1": total["margin_1"], "margin_2": total["margin_2"]}), ev.Layer("simpson", not simpson["reversed"])]
        return Outcome(numbers, parts, layers, notes=notes)

    def rederive(self, c: Context, found: Outcome) -> tuple[bool, list[str]]:
        """The two margins from plain filtered sums."""
        value, cost, period = (c.binding.roles[r][0] for r in ("value", "cost", "time"))
        ok = True
        for name, p in (("margin_1", c.params["p1"]), ("margin_2", c.params["p2"])):
            again = c.df.filter(col(period) == F.lit(p)).agg(1 - ratio(F.sum(col(cost)), F.sum(col(value)))).first()[0]
            ok &= again is not None and abs(again - found.numbers[name]) <= 1e-9
        return ok, []

    def size(self, c: Context, found: Outcome) -> dict:
        value, period = c.binding.roles["value"][0], c.binding.roles["time"][0]
        revenue = c.df.filter(col(period) == F.lit(c.params["p2"])).agg(F.sum(col(value))).first()[0]
        return decompose.margin_opportunity(found.numbers["mix"], float(revenue))


@register
class Descriptive:
    """Which columns go with a 0/1 outcome, and where a numeric one steps."""

    id = "descriptive"
    needs = (Requirement("target", shape="binary", hints=("churn", "target", "return", "flag", "converted")), Requirement("entity", required=False, shape="unique", hints=("id", "key")))

    def explore(self, c: Context) -> Outcome:
        target = c.binding.roles["target"][0]
        used = {x for names in c.binding.roles.values() for x in names}
        numeric, categorical, dropped = split_features(profile.probes(c.df), used)
        numeric, categorical = cap_features(numeric, categorical)
        df = c.df.withColumn(target, col(target).cast("int"))
        base = c.engine.run(df.filter(col(target).isNotNull()).agg(F.avg(col(target)).alias("rate"), F.count("*").alias("n")), f"base rate of {target}").df.first()
        found = assoc.numeric_findings(df, numeric, target) if numeric else []
        found += assoc.categorical_findings(df, categorical, target) if categorical else []
        entity = c.binding.roles.get("entity", [])
        cuts = {}
        for name in numeric:
            t = bins.find_threshold(df, name, target, entity or [name])
            if t.recommend:
                cuts[name] = list(t.cuts)
                found.append({"column": name, "kind": "threshold", "n": base["n"], "effect": t.jump, "p_value": t.p_value, "significant": True, "cuts": list(t.cuts), "detail": t.detail})
        ranked = assoc.rank_findings(found)
        parts = {}
        if categorical:
            first = categorical[0]
            parts = {r["level"]: r["x"] / base["n"] for r in assoc.top_levels(df, [first], target).collect()}
        top = ranked[0] if ranked else None
        layers = [ev.structural(base["n"]), ev.enough_rows(base["n"]), ev.in_range({"base": base["rate"]})]
        layers += [ev.identity(list(parts.values()), base["rate"])] if parts else []
        layers += [ev.real_effect(top["significant"], top["effect"])] if top else []
        plan = {"numeric": [n for n in numeric if n not in cuts], "categorical": categorical, "binned": cuts, "target": target, "entity": entity[0] if entity else None, "dropped": dropped}
        return Outcome({"base_rate": base["rate"], "rows": float(base["n"])} | {f"jump:{f['column']}": f["effect"] for f in ranked if f["kind"] == "threshold"}, ranked, layers, plan)

    def rederive(self, c: Context, found: Outcome) -> tuple[bool, list[str]]:
        """The base rate from a filtered count, cuts from a CASE over the raw column."""
        target = c.binding.roles["target"][0]
        y = col(target).cast("int")
        rate = c.df.agg(ratio(F.count_if(y == 1), F.count(y))).first()[0]
        ok = abs(rate - found.numbers["base_rate"]) <= 0.005 * max(abs(rate), 1e-12)
        attacks = []
        for f in found.findings:
            if f["kind"] != "threshold":
                continue
            best = 0.0
            for cut in f["cuts"]:
                row = c.df.filter(col(f["column"]).isNotNull()).agg(F.avg(F.when(col(f["column"]) >= cut, y)).alias("a"), F.avg(F.when(col(f["column"]) < cut, y)).alias("b")).first()
                best = max(best, abs((row["a"] or 0) - (row["b"] or 0)))
            if abs(best - f["effect"]) > 0.05 * f["effect"] + 1e-9:
                attacks.append(f"the step of {f['column']} is {best:.4f}, not {f['effect']:.4f}")
        return ok, attacks


@register
class Logistic(Descriptive):
    """A scored model on the explored plan, with its own attacks."""

    id = "logistic"

    def model(self, c: Context, found: Outcome, policy: TierPolicy = TierPolicy()) -> dict:
        plan = found.feature_plan
        y, key = plan["target"], plan["entity"]
        if not key:
            raise ValueError("a model needs a unique key to split rows by")
        df = c.df.withColumn(y, col(y).cast("int"))
        split = logit.stratified_split(df, y, key)
        train, test = split.filter("NOT is_test"), split.filter("is_test")
        design = logit.build_design(train, plan["numeric"], plan["categorical"], plan["binned"])
        fit = logit.fit_logit(train, y, design)
        scored = logit.score_table(split, design, fit, key, policy, y, "is_test")
        held = scored.filter("is_test")
        auc = metrics.roc_auc(held, "actual", "score").first()["auc"]
        confusion = metrics.confusion(held, "actual", "score", policy.flag_threshold).first().asDict()
        sums = scored.filter("is_test").selectExpr("count_if(score >= 0.5 AND actual = 1) tp", "count_if(score >= 0.5 AND actual = 0) fp").first() if policy.flag_threshold == 0.5 else confusion
        best_rule = 0.5
        for name, cuts in plan["binned"].items():
            area = metrics.roc_auc(test.withColumn("_rule", (col(name) >= cuts[0]).cast("double")), y, "_rule").first()["auc"]
            best_rule = max(best_rule, area or 0.5, 1 - (area or 0.5))
        attacks = []
        if (sums["tp"], sums["fp"]) != (confusion["tp"], confusion["fp"]):
            attacks.append("the confusion matrix differs between two plans")
        if auc is None or auc <= 0.60:
            attacks.append(f"held-out AUC {auc} is no better than 0.60")
        elif plan["binned"] and auc < best_rule + 0.02:
            attacks.append(f"held-out AUC {auc:.3f} is no better than one rule's {best_rule:.3f}")
        univariate = {f["column"]: f for f in found.findings if f["kind"] == "numeric"}
        for row, kind in zip(fit.table(), fit.kinds):
            f = univariate.get(row["term"])
            if kind == "continuous" and f and f["significant"] and row["p_value"] < stats.ALPHA and (f["r"] > 0) != (row["coef"] > 0):
                attacks.append(f"{row['term']} changes its sign in the model")
            if f and abs(f["r"]) > 0.95:
                attacks.append(f"{row['term']} gives the outcome away")
        found.attacks = attacks
        found.numbers |= {"auc": auc, "mcfadden": fit.mcfadden}
        return {"fit": fit, "design": design, "scored": scored, "auc": auc, "confusion": confusion, "attacks": attacks, "policy": policy.digest()}


def run_analysis(engine: Engine, df: DataFrame, question: str, table: str = "table", metric: Metric | None = None, playbook: str | None = None, overrides: dict[str, str] | None = None, params: dict | None = None, state_path: str | None = None) -> dict:
    """A question over a table: profile, quality, semantics, exploration, model, second derivation, claims and gates.

    Returns status COMPLETE, BLOCKED (a gate failed; with defects and owners) or FAILED, and what was found so far."""
    metric = metric or metric_from_text(question)
    level = classify(question)["level"]
    chosen = PLAYBOOKS[select_playbook(playbook, metric, level)]()
    shared: dict = {"df": df}
    ledger, gates = ev.Ledger(), []

    class Blocked(Exception):
        pass

    def passed(g: ev.Gate) -> None:
        gates.append(g)
        if not g.passed:
            raise Blocked(g.name)

    def step_profile(_: dict) -> dict:
        p = profile.profile_table(df)
        passed(ev.gate_profile({table: profile.verdict(p)}))
        return {"row_count": p["row_count"], "warnings": p["warnings"], "freshness": p["freshness"]}

    def step_quality(_: dict) -> dict:
        layer = CleanLayer(df)
        shared["df"] = layer.apply()
        report = score_table(shared["df"])
        passed(ev.gate_readiness(report.overall >= 60, [f"score {report.overall}"]))
        return {"score": report.overall, "band": report.band, "pending": [s.name for s in layer.pending()]}

    def step_semantics(_: dict) -> dict:
        b = bind(profile.probes(df), list(chosen.needs), table, overrides)
        passed(ev.gate_semantics([], b.block_message()))
        hints = period_hints(question)
        shared["context"] = Context(engine, df, b, question, hints | (params or {}))
        return {"roles": b.roles, "notes": b.notes}

    def step_explore(_: dict) -> dict:
        shared["found"] = chosen.explore(shared["context"])
        return {"numbers": shared["found"].numbers}

    def step_model(_: dict) -> dict | None:
        if not hasattr(chosen, "model"):
            return None
        shared["model"] = chosen.model(shared["context"], shared["found"])
        return {"auc": shared["model"]["auc"], "fingerprint": shared["model"]["fit"].fingerprint()}

    def step_redteam(_: dict) -> dict:
        ok, attacks = chosen.rederive(shared["context"], shared["found"])
        passed(ev.gate_redteam(ok, attacks + shared["found"].attacks))
        return {"rederived": ok}

    def step_claims(_: dict) -> dict:
        done = engine.run(engine.spark.createDataFrame([(k, float(v)) for k, v in shared["found"].numbers.items() if v is not None], "name string, value double"), f"{question} on {table}")
        for k, v in shared["found"].numbers.items():
            ledger.record(ev.Claim(k, k, v, done.query_hash, done.result_hash))
        passed(ev.gate_provenance(ledger, list(ledger.claims)))
        return {"claims": sorted(ledger.claims)}

    def step_sizing(_: dict) -> dict | None:
        return chosen.size(shared["context"], shared["found"]) if hasattr(chosen, "size") else None

    nodes = [
        Node("profile", step_profile, retries=0), Node("quality", step_quality, ("profile",), retries=0), Node("semantics", step_semantics, ("quality",), retries=0),
        Node("explore", step_explore, ("semantics",), retries=0), Node("model", step_model, ("explore",), retries=0), Node("redteam", step_redteam, ("model",), retries=0),
        Node("sizing", step_sizing, ("model",), critical=False, retries=0), Node("claims", step_claims, ("redteam", "sizing"), retries=0),
    ]
    state = State(state_path)
    try:
        run_graph(engine.spark, nodes, state)
        status = "COMPLETE"
    except StepFailed as e:
        status = "BLOCKED" if isinstance(e.__cause__, Blocked) else "FAILED"
        shared["error"] = str(e)
    found = shared.get("found")
    defects = [f"{g.name}: {d.kind}: {d.detail}" for g in gates for d in g.defects]
    grade = ev.grade_layers(found.layers) if found else None
    return {"status": status, "plan": plan_run(question), "playbook": chosen.id, "steps": state.outputs, "found": found, "model": shared.get("model"), "ledger": ledger, "grade": grade, "defects": defects, "owners": [o for g in gates for o in g.owners()], "error": shared.get("error")}


def recommend(outcome: Outcome, playbook: str) -> str:
    """What to do, from what was found."""
    if playbook == "margin" and outcome.findings:
        worst = min(outcome.findings, key=lambda f: f["total"])
        return f"Look at {worst['segment']} first: it moved the margin by {100 * worst['total']:.2f} points."
    if outcome.findings:
        f = outcome.findings[0]
        return f"Look at {f['column']} first ({f['kind']}, effect {f['effect']:.3f})."
    return "No column goes with the outcome strongly enough to act on."


def to_json(outcome: Outcome) -> str:
    return json.dumps({"numbers": outcome.numbers, "findings": [{k: (asdict(v) if hasattr(v, "__dataclass_fields__") else v) for k, v in f.items()} for f in outcome.findings], "feature_plan": outcome.feature_plan}, default=str)


def pipeline_forecast(df: DataFrame, period: str, top: str, bottom: str, horizon: int = 1) -> DataFrame | None:
    """A ratio per period and its forecast; None below three periods."""
    points = series.ratio_series(df, period, top, bottom)
    return series.forecast(series.to_series(points, "period", "value"), horizon) if points.count() >= 3 else None


def text_runner(spark: SparkSession) -> Callable[[str], DataFrame]:
    """Read-only SQL under a fresh budget."""
    return lambda sql: Engine(spark).run(sql).df
