"""Unregularised logistic regression with standard errors, distributed: Newton steps on aggregated Gram matrices.

The driver holds what grows with the features (at most a few dozen), never rows: each step is one aggregation over the
design that yields the gradient and the information matrix. One class, dependent columns and separation are refused.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions import stats
from ...functions.columns import col
from ..bins import bin_column, labels_of


class DegenerateFit(ValueError):
    """The data do not determine the coefficients."""


@dataclass(frozen=True)
class Design:
    """The columns of a design matrix: standardised numerics, then indicators of all but the first sorted level."""

    names: tuple[str, ...]
    columns: tuple[Column, ...]
    kinds: tuple[str, ...]


def build_design(df: DataFrame, numeric: list[str], categorical: list[str], binned: dict[str, list[float]] | None = None, most_levels: int = 50) -> Design:
    """A null numeric counts as the mean; null is a level of a categorical or binned column, so it never passes for the
    baseline. A constant numeric has spread 1. Levels come from one aggregation; more than ``most_levels`` are refused."""
    binned = binned or {}
    for name in binned:
        if name in numeric:
            raise ValueError(f"{name} is binned and cannot enter as a slope too")
    facts = df.agg(F.lit(0).alias("_"), *[a for n in numeric for a in (F.avg(col(n)).alias(f"m:{n}"), F.stddev_samp(col(n)).alias(f"s:{n}"))]).first()
    names, columns, kinds = [], [], []
    for n in numeric:
        mean, sd = facts[f"m:{n}"], facts[f"s:{n}"]
        mean, sd = (0.0 if mean is None else float(mean)), (float(sd) if sd and sd > 0 else 1.0)
        names.append(n)
        columns.append(F.coalesce((col(n).cast("double") - mean) / sd, F.lit(0.0)))
        kinds.append("continuous")
    level_of = {c: F.coalesce(col(c).cast("string"), F.lit("None")) for c in categorical}
    level_of |= {c: F.coalesce(bin_column(col(c), e), F.lit("None")) for c, e in binned.items()}
    if level_of:
        found = df.agg(*[F.collect_set(v).alias(c) for c, v in level_of.items()]).first()
        for c, v in level_of.items():
            order = {x: i for i, x in enumerate(labels_of(binned[c]))} if c in binned else {}
            levels = sorted(found[c], key=lambda x: (order.get(x, len(order)), x))
            if len(levels) > most_levels:
                raise ValueError(f"{c} has {len(levels)} levels")
            for level in levels[1:]:
                names.append(f"{c}={level}")
                columns.append((v == level).cast("double"))
                kinds.append("bin" if c in binned else "category")
    return Design(tuple(names), tuple(columns), tuple(kinds))


def stratified_split(df: DataFrame, y: str, key: str, fraction: float = 0.25, seed: int = 0) -> DataFrame:
    """df with ``is_test``: per class, the round(n * fraction) rows of smallest sha256 of seed and key. Keys are unique."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), col(key).cast("string")), 256)
    keyed = df.withColumn("_h", order)
    # the hash is even: its leading bits, counted by class, say where the cut lies; only one prefix is then ordered
    prefix = F.substring("_h", 1, 3)
    counts = keyed.groupBy(col(y).alias("_y"), prefix.alias("_p")).agg(F.count("*").alias("_n"))
    by = Window.partitionBy("_y")
    before = F.coalesce(F.sum("_n").over(by.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    want = F.floor(F.sum("_n").over(by) * fraction + 0.5)
    edge = counts.select("_y", "_p", (want - before).alias("_left"), "_n")
    joined = keyed.withColumn("_q", prefix).join(edge, col(y).eqNullSafe(F.col("_y")) & (F.col("_q") == F.col("_p"))).drop("_q")
    whole = joined.filter("_left <= 0 OR _left >= _n").withColumn("is_test", F.col("_left") >= F.col("_n"))
    cut = joined.filter("_left > 0 AND _left < _n").withColumn("is_test", F.row_number().over(Window.partitionBy("_y", "_p").orderBy("_h")) <= F.col("_left"))
    return whole.unionByName(cut).drop("_h", "_p", "_y", "_left", "_n")


@dataclass
class Fit:
    names: list[str]
    coef: np.ndarray
    se: np.ndarray
    n: int
    log_likelihood: float
    null_log_likelihood: float
    iterations: int
    kinds: list[str]
    flags: list[str] = field(default_factory=list)

    @property
    def mcfadden(self) -> float:
        return 1 - self.log_likelihood / self.null_log_likelihood

    def table(self) -> list[dict]:
        out = []
        for name, b, se in zip(self.names, self.coef, self.se):
            z = b / se
            out.append({"term": name, "coef": float(b), "se": float(se), "z": float(z), "p_value": 2 * stats.normal_tail(abs(z)), "low": float(b - 1.959963984540054 * se), "high": float(b + 1.959963984540054 * se), "odds_ratio": math.exp(b)})
        return out

    def score(self, design: Design) -> Column:
        z = F.lit(float(self.coef[0]))
        for b, c in zip(self.coef[1:], design.columns):
            z = z + F.lit(float(b)) * c
        return 1 / (1 + F.exp(-z))

    def fingerprint(self) -> str:
        recipe = {"terms": self.names, "coef": [round(float(b), 10) for b in self.coef], "n": self.n}
        return hashlib.sha256(json.dumps(recipe, sort_keys=True).encode()).hexdigest()[:16]


def fit_logit(df: DataFrame, y: str, design: Design, most_iterations: int = 50, tolerance: float = 1e-8) -> Fit:
    rows = df.filter(col(y).isNotNull()).select(col(y).cast("double").alias("y"), F.array(F.lit(1.0), *design.columns).alias("x")).cache()
    try:
        k = len(design.names) + 1
        n, events = rows.agg(F.count("*"), F.sum("y")).first()
        if not n or events in (0, n):
            raise DegenerateFit("the outcome has one class only")
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        x = F.col("x")

        def step(beta: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray, float]:
            z = F.lit(0.0)
            for i, b in enumerate(beta):
                z = z + F.lit(float(b)) * x[i]
            soft = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
            r = rows.withColumn("z", z).withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
            w = F.col("p") * (1 - F.col("p")) if weighted else F.lit(1.0)
            sums = r.agg(F.sum(F.col("y") * z - soft), *[F.sum(x[i] * (F.col("y") - F.col("p"))) for i in range(k)], *[F.sum(w * x[i] * x[j]) for i, j in pairs]).first()
            h = np.zeros((k, k))
            for (i, j), v in zip(pairs, sums[1 + k:]):
                h[i, j] = h[j, i] = v
            return np.array(sums[1:1 + k]), h, sums[0]

        beta = np.zeros(k)
        _, gram, _ = step(beta, False)
        scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
        if np.linalg.matrix_rank(gram / np.outer(scale, scale), tol=1e-9) < k:
            raise DegenerateFit("columns depend on one another: " + ", ".join(design.names))
        for iteration in range(1, most_iterations + 1):
            gradient, h, ll = step(beta, True)
            try:
                move = np.linalg.solve(h, gradient)
            except np.linalg.LinAlgError:
                raise DegenerateFit("separation: the information matrix vanished") from None
            beta = beta + move
            if np.abs(beta).max() > 30:
                raise DegenerateFit("separation: a coefficient grows without bound")
            if np.abs(move).max() < tolerance:
                break
        else:
            raise DegenerateFit(f"no convergence in {most_iterations} iterations")
        _, h, ll = step(beta, True)
        se = np.sqrt(np.diag(np.linalg.inv(h)))
        share = events / n
        null = n * (share * math.log(share) + (1 - share) * math.log(1 - share))
        names = ["(intercept)", *design.names]
        flags = [f"|coefficient| > 10: {a}" for a, b in zip(names, beta) if abs(b) > 10]
        return Fit(names, beta, se, int(n), float(ll), null, iteration, ["intercept", *design.kinds], flags)
    finally:
        rows.unpersist()


def phrase(term: str, odds: float, p_value: float) -> str:
    """What an odds ratio says, as association."""
    if p_value >= stats.ALPHA:
        return f"{term} shows no clear association with the outcome (p = {p_value:.3g})"
    way = "higher" if odds > 1 else "lower"
    return f"{term} is associated with {abs(odds - 1):.0%} {way} odds of the outcome (p = {p_value:.3g})"


def score_table(df: DataFrame, design: Design, fit: Fit, entity: str, policy, y: str | None = None, split: str | None = None) -> DataFrame:
    """entity, score, tier, flagged, the three terms of largest |coefficient * x|, and actual and split if there."""
    score = fit.score(design)
    terms = F.array(*[F.struct(F.abs(F.lit(float(b)) * c).alias("size"), F.lit(name).alias("name"), (F.lit(float(b)) * c).alias("effect")) for name, b, c in zip(design.names, fit.coef[1:], design.columns)])
    first = F.transform(F.slice(F.sort_array(terms, asc=False), 1, 3), lambda t: t["name"])
    extra = [col(c).alias(n) for c, n in ((y, "actual"), (split, "is_test")) if c]
    out = df.select(col(entity).alias("entity"), score.alias("score"), first.alias("_top"), *extra)
    return out.select("entity", "score", policy.column(F.col("score")).alias("tier"), (F.col("score") >= policy.flag_threshold).alias("flagged"), *[F.get("_top", F.lit(i)).alias(f"factor_{i + 1}") for i in range(3)], *[n for c, n in ((y, "actual"), (split, "is_test")) if c])


def scoring_fingerprint(fit: Fit, policy, rows: int, result_hash: str) -> str:
    return hashlib.sha256(json.dumps([fit.fingerprint(), policy.digest(), rows, result_hash]).encode()).hexdigest()[:16]
