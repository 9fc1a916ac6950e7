"""Risk tiers: one policy for the score file, SQL and measures."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.columns import col


@dataclass(frozen=True)
class TierPolicy:
    """Bands of (name, least, most), each from its least up to but without its most."""

    bands: tuple[tuple[str, float, float], ...] = (("Low", 0.0, 0.40), ("Medium", 0.40, 0.70), ("High", 0.70, 1.01))
    flag_threshold: float = 0.5
    score_field: str = "score"

    def __post_init__(self) -> None:
        if not self.bands or self.bands[0][1] != 0 or self.bands[-1][2] <= 1:
            raise ValueError("bands must cover 0 to 1")
        if any(a[2] != b[1] for a, b in zip(self.bands, self.bands[1:])) or any(lo >= hi for _, lo, hi in self.bands):
            raise ValueError("bands must follow one another without gaps")
        if len({b[0] for b in self.bands}) != len(self.bands):
            raise ValueError("band names must differ")

    def of(self, p: float) -> str:
        return next(name for name, lo, hi in self.bands if lo <= p < hi)

    def column(self, score: Column) -> Column:
        out = F.when(score.isNull(), F.lit(None).cast("string"))
        for name, _, hi in self.bands[:-1]:
            out = out.when(score < hi, name)
        return out.otherwise(self.bands[-1][0])

    def sql(self, field: str | None = None) -> str:
        f = field or self.score_field
        arms = " ".join(f"WHEN {f} < {hi:g} THEN '{name}'" for name, _, hi in self.bands[:-1])
        return f"CASE WHEN {f} IS NULL THEN NULL {arms} ELSE '{self.bands[-1][0]}' END"

    def dax(self, table: str, field: str | None = None) -> str:
        f = f"'{table}'[{field or self.score_field}]"
        arms = ", ".join(f'{f} < {hi:g}, "{name}"' for name, _, hi in self.bands[:-1])
        return f'SWITCH(TRUE(), {arms}, "{self.bands[-1][0]}")'

    def digest(self) -> str:
        return hashlib.sha256(json.dumps([self.bands, self.flag_threshold, self.score_field]).encode()).hexdigest()[:16]

    @classmethod
    def load(cls, path: str, name: str = "default") -> TierPolicy:
        import yaml

        with open(path) as f:
            spec = yaml.safe_load(f)["tiers"][name]
        return cls(tuple((b["name"], float(b["min"]), float(b["max"])) for b in spec["bands"]), float(spec.get("flag_threshold", 0.5)), spec.get("score_field", "score"))


def tier_counts(scored: DataFrame, score: str, policy: TierPolicy = TierPolicy()) -> DataFrame:
    return scored.groupBy(policy.column(col(score)).alias("tier")).agg(F.count("*").alias("n"), F.avg(col(score)).alias("mean_score"))
