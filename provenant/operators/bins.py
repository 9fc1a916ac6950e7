"""Buckets of a numeric column and the cut at which an outcome's rate steps."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.columns import col
from ..functions.ranks import running_sums


def should_group_by_value(distinct: int, rows: int, k: int = 10, most: int = 60, least_rows: int = 30) -> bool:
    """Whether each value is a bucket of its own: few values, or up to 60 with at least 30 rows each on average."""
    return distinct <= max(k, 2) or (distinct <= most and rows >= least_rows * distinct)


def value_buckets(df: DataFrame, column: str, target: str) -> DataFrame:
    """bucket (from 0), lo, hi, n, x: a bucket per value."""
    rows = df.filter(col(column).isNotNull() & col(target).isNotNull()).groupBy(col(column).cast("double").alias("lo")).agg(F.count("*").alias("n"), F.sum(col(target).cast("bigint")).alias("x"))
    return rows.select((F.row_number().over(Window.orderBy("lo")) - 1).alias("bucket"), "lo", F.col("lo").alias("hi"), "n", "x")


def ntile_buckets(df: DataFrame, column: str, target: str, tie: list[str], k: int = 10) -> DataFrame:
    """bucket (1 to k), n, lo, hi, x of NTILE(k) over column and the tie-break columns, without sorting all rows in one task.

    Rows are first counted by value; running sums over ranges of values give the rank at which each starts. Only values whose
    rows fall into two buckets need an order among their own rows, which is a window partitioned by value.
    """
    rows = df.filter(col(column).isNotNull() & col(target).isNotNull()).select(col(column).cast("double").alias("v"), col(target).cast("bigint").alias("y"), *[col(t).alias(f"t{i}") for i, t in enumerate(tie)])
    starts = running_sums(rows.groupBy("v").agg(F.count("*").alias("n")), "v", ["n"]).select("v", "n", F.col("before_n").alias("before"), F.col("total_n").alias("total"))
    starts = starts.select("v", "before", "total", _tile(F.col("before"), F.col("total"), k).alias("first"), _tile(F.col("before") + F.col("n") - 1, F.col("total"), k).alias("last"))
    placed = rows.join(starts, "v")
    whole = placed.filter("first = last").select("v", "y", F.col("first").alias("bucket"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy(*[F.col(f"t{i}") for i in range(len(tie))])) - 1
    split = placed.filter("first <> last").select("v", "y", _tile(F.col("before") + rank, F.col("total"), k).alias("bucket"))
    return whole.union(split).groupBy("bucket").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("y").alias("x"))


def _tile(rank: Column, total: Column, k: int) -> Column:
    """NTILE of a rank from 0: the first total % k buckets get one row more."""
    size, more = F.floor(total / k), total % k
    edge = more * (size + 1)
    return F.when(rank < edge, F.floor(rank / (size + 1)) + 1).otherwise(more + F.coalesce(F.floor(F.try_divide(rank - edge, size)), F.lit(0)) + 1).cast("int")


# ---------------------------------------------------------------- edges

def labels_of(edges: list[float]) -> list[str]:
    """Names of the bins between inclusive lower edges. Whole edges name whole values, the first bin from 0: ``0-15``,
    ``16-20``, ``21+`` for [16, 21]; others name their limits: ``<0.5``, ``0.5-2``, ``2+``. Without edges all is one bin."""
    if not edges:
        return ["all"]
    cuts = sorted(edges)
    whole = all(float(c).is_integer() for c in cuts)
    tops = [f"{c - 1 if whole else c:g}" for c in cuts]
    lows = ["0", *(f"{c:g}" for c in cuts)]
    first = f"0-{tops[0]}" if whole else f"<{tops[0]}"
    return [first, *(f"{a}-{b}" for a, b in zip(lows[1:], tops[1:])), f"{lows[-1]}+"]


def bin_column(value: Column, edges: list[float], labels: list[str] | None = None) -> Column:
    """The label of a value; each edge belongs to the bin above it; null stays null."""
    labels = labels or labels_of(edges)
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(sorted(edges), labels):
        out = out.when(value < edge, label)
    return out.otherwise(labels[-1])


def bin_sql(column: str, edges: list[float], labels: list[str] | None = None, quote: str = '"') -> str:
    labels = labels or labels_of(edges)
    name, text = f"{quote}{column}{quote}", lambda s: "'" + s.replace("'", "''") + "'"
    arms = " ".join(f"WHEN {name} < {e:g} THEN {text(x)}" for e, x in zip(sorted(edges), labels))
    return f"CASE WHEN {name} IS NULL THEN NULL {arms} ELSE {text(labels[-1])} END"


def bin_dax(table: str, column: str, edges: list[float], labels: list[str] | None = None) -> str:
    labels = labels or labels_of(edges)
    name, text = f"'{table}'[{column}]", lambda s: '"' + s.replace('"', '""') + '"'
    arms = "".join(f"{name} < {e:g}, {text(x)}, " for e, x in zip(sorted(edges), labels))
    return f"SWITCH(TRUE(), ISBLANK({name}), BLANK(), {arms}{text(labels[-1])})"


# ---------------------------------------------------------------- thresholds

@dataclass(frozen=True)
class Bucket:
    lo: float
    hi: float
    n: int
    x: float

    @property
    def rate(self) -> float:
        return self.x / self.n if self.n else 0.0


@dataclass(frozen=True)
class Threshold:
    kind: str  # cliff, monotone, non_monotone, flat or insufficient
    cuts: tuple[float, ...] = ()
    recommend: bool = False
    jump: float = 0.0
    ratio: float = 0.0
    p_value: float | None = None
    linear_r2: float = 0.0
    step_r2: float = 0.0
    monotonicity: float = 0.0
    detail: str = ""


class _Fit:
    """Weighted fits of bucket rates, from prefix sums."""

    def __init__(self, buckets: list[Bucket]):
        self.buckets = buckets
        self.n, self.x, self.xx = [0.0], [0.0], [0.0]
        for b in buckets:
            self.n.append(self.n[-1] + b.n)
            self.x.append(self.x[-1] + b.x)
            self.xx.append(self.xx[-1] + b.n * b.rate**2)
        self.total = self.within(0, len(buckets))

    def within(self, i: int, j: int) -> float:
        """Squares around the mean of buckets i to j."""
        n = self.n[j] - self.n[i]
        return max(0.0, self.xx[j] - self.xx[i] - (self.x[j] - self.x[i]) ** 2 / n) if n else 0.0

    def r2(self, residual: float) -> float:
        if self.total <= 1e-15:
            return 1.0 if residual <= 1e-15 else 0.0
        return max(0.0, 1 - residual / self.total)

    def steps(self, cuts: list[int]) -> float:
        ends = [0, *sorted(cuts), len(self.buckets)]
        return self.r2(sum(self.within(a, b) for a, b in zip(ends, ends[1:])))

    def line(self) -> float:
        weight = self.n[-1]
        middle = [(b.lo + b.hi) / 2 for b in self.buckets]
        mx = sum(m * b.n for m, b in zip(middle, self.buckets)) / weight
        sxx = sum(b.n * (m - mx) ** 2 for m, b in zip(middle, self.buckets))
        sxy = sum(b.n * (m - mx) * b.rate for m, b in zip(middle, self.buckets))
        return self.r2(self.total - sxy**2 / sxx) if sxx > 0 else 0.0


def detect_threshold(buckets: list[Bucket], min_jump: float = 0.10, min_ratio: float = 1.5, min_rows: int = 30, min_gain: float = 0.5, alpha: float = stats.ALPHA, max_cuts: int = 2) -> Threshold:
    """Whether a rate steps at some value rather than drifts.

    The strongest single split is the one of greatest difference of rates (the first of equals). A staircase of up to
    ``max_cuts`` cuts, each of which must add 0.01 of R2, is weighed against a line through the bucket midpoints: it is
    recommended when the step is material (jump or ratio), significant, and removes ``min_gain`` of what the line leaves.
    """
    if len(buckets) < 3 or any(b.n < min_rows for b in buckets):
        return Threshold("insufficient", detail="fewer than 3 buckets" if len(buckets) < 3 else f"a bucket has fewer than {min_rows} rows")
    fit = _Fit(buckets)
    best, jump = None, -1.0
    for i in range(1, len(buckets)):
        gap = abs((fit.x[-1] - fit.x[i]) / (fit.n[-1] - fit.n[i]) - fit.x[i] / fit.n[i])
        if gap > jump + 1e-12:
            best, jump = i, gap
    below, above = fit.x[best] / fit.n[best], (fit.x[-1] - fit.x[best]) / (fit.n[-1] - fit.n[best])
    test = stats.proportions(fit.x[-1] - fit.x[best], fit.n[-1] - fit.n[best], fit.x[best], fit.n[best])
    hi, lo = max(below, above), min(below, above)
    ratio = hi / lo if lo > 0 else math.inf
    cuts, r2 = [], fit.steps([])
    while len(cuts) < max_cuts:
        options = [(fit.steps([*cuts, i]), i) for i in range(1, len(buckets)) if i not in cuts]
        top = max(v for v, _ in options)
        if top < r2 + 0.01:
            break
        cuts.append(next(i for v, i in options if v >= top - 1e-12))
        r2 = top
    line = fit.line()
    gain = (r2 - line) / (1 - line) if line < 1 - 1e-9 else 0.0
    recommend = (jump >= min_jump or ratio >= min_ratio) and bool(test.below(alpha)) and gain >= min_gain
    rates = [b.rate for b in buckets]
    rising = sum(b > a for a, b in zip(rates, rates[1:])) / (len(rates) - 1)
    kind = "cliff" if recommend else "monotone" if rising >= 0.8 else "non_monotone" if rising <= 0.5 else "flat"
    values = tuple(sorted(buckets[i].lo for i in cuts)) or (buckets[best].lo,)
    return Threshold(kind, values if recommend else (), recommend, jump, ratio, test.p_value, line, r2, rising, f"rate {below:.4f} -> {above:.4f} at {buckets[best].lo:g}")


def find_threshold(df: DataFrame, column: str, target: str, tie: list[str], k: int = 10) -> Threshold:
    """Buckets from Spark (at most 60 rows), the search on the driver."""
    facts = df.filter(col(column).isNotNull() & col(target).isNotNull()).agg(F.count("*").alias("n"), F.count_distinct(col(column)).alias("d")).first()
    made = value_buckets(df, column, target) if should_group_by_value(facts["d"], facts["n"], k) else ntile_buckets(df, column, target, tie, k)
    rows = made.orderBy("bucket").collect()
    return detect_threshold([Bucket(r["lo"], r["hi"], r["n"], r["x"]) for r in rows])
