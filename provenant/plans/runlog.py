"""Runs with evidence: every query has a hash of what was asked and, in any row order, of what came out."""

from __future__ import annotations

import hashlib
import json
from collections import deque
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from ..sources.store import read_text, write_text
from .guard import Budget, assert_read_only, estimated_bytes


def query_hash(text: str, source: str, dialect: str = "spark") -> str:
    """Of the text with white space made even, its dialect and source."""
    return hashlib.sha256("\x1f".join([dialect, source, " ".join(text.split())]).encode()).hexdigest()[:16]


def digest(df: DataFrame, digits: int = 6) -> tuple[int, str]:
    """The count of rows and a hash of them in whatever order: a sum of row hashes, in the same aggregation. Doubles are
    rounded, as the order of a sum moves their last digits; columns go by name."""
    names = sorted(df.columns)
    values = [F.round(col(n), digits) if dict(df.dtypes)[n] in ("double", "float") else col(n).cast("string") for n in names]
    row = F.xxhash64(*[F.coalesce(v.cast("string"), F.lit("\x00null")) for v in values]) if names else F.lit(0)
    n, total = df.agg(F.count("*"), F.sum(row.cast("decimal(38,0)"))).first()
    return n, hashlib.sha256(json.dumps([names, n, str(total)]).encode()).hexdigest()[:16]


def result_hash(df: DataFrame, digits: int = 6) -> str:
    return digest(df, digits)[1]


@dataclass(frozen=True)
class Run:
    df: DataFrame
    query_hash: str
    result_hash: str
    source: str
    text: str
    row_count: int
    ts: str

    def scalar(self):
        return self.df.first()[0]


class Engine:
    """The one way to a result: read-only check, budget, execution, hashes, storage.

    The last ``most_cached`` results stay cached; an older one is computed anew if it is asked again."""

    def __init__(self, spark: SparkSession, source: str = "session", budget: Budget | None = None, store: QueryStore | None = None, most_cached: int = 8):
        self.spark, self.source, self.budget, self.store = spark, source, budget or Budget(), store
        self.most_cached, self._cached = most_cached, deque()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()

    def release(self, keep: int = 0) -> None:
        """Gives back the memory of all results but the last ``keep``."""
        while len(self._cached) > keep:
            self._cached.popleft().unpersist()

    def run(self, query: str | DataFrame, text: str | None = None, most_bytes: int | None = None) -> Run:
        """``query``: SQL text, or a DataFrame with a text that names it. The result is cached for its hash and its use."""
        if isinstance(query, str):
            assert_read_only(self.spark, query)
            df, text = self.spark.sql(query), query
        else:
            df, text = query, text or query._jdf.queryExecution().analyzed().canonicalized().toString()
        size = estimated_bytes(df)
        if most_bytes is not None and size > most_bytes:
            raise ValueError(f"the query reads about {size} bytes of at most {most_bytes}")
        self.budget.charge(size)
        df = df.cache()
        self._cached.append(df)
        self.release(self.most_cached)
        n, rows = digest(df)
        out = Run(df, query_hash(text, self.source), rows, self.source, text, n, datetime.now(timezone.utc).isoformat())
        if self.store:
            self.store.put(out)
        return out


class QueryStore:
    """Queries as JSON beside their results as Parquet, by hash, in a folder that driver and executors share."""

    def __init__(self, folder: str):
        self.folder = str(folder).rstrip("/")

    def put(self, run: Run) -> None:
        meta = {"query_hash": run.query_hash, "result_hash": run.result_hash, "source": run.source, "text": run.text, "row_count": run.row_count, "ts": run.ts}
        run.df.write.mode("overwrite").parquet(f"{self.folder}/{run.result_hash}.parquet")
        write_text(f"{self.folder}/{run.query_hash}.json", json.dumps(meta, indent=1))

    def query(self, qh: str) -> dict:
        text = read_text(f"{self.folder}/{qh}.json")
        if text is None:
            raise KeyError(f"no query {qh} in {self.folder}")
        return json.loads(text)

    def result(self, spark: SparkSession, rh: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{rh}.parquet")

    def verify(self, spark: SparkSession, qh: str) -> bool:
        """Whether the stored result still has the hash that was recorded."""
        meta = self.query(qh)
        return result_hash(self.result(spark, meta["result_hash"])) == meta["result_hash"]


class QueryArchive:
    """Proven queries, found again by source, metric and the overlap of tags."""

    def __init__(self, path: str):
        self.path = str(path)
        self.rows = [json.loads(x) for x in (read_text(self.path) or "").splitlines()]

    def _save(self) -> None:
        write_text(self.path, "".join(json.dumps(r) + "\n" for r in self.rows))

    def add(self, source: str, metric: str, text: str, tags: list[str]) -> None:
        key = query_hash(text, source)
        if all(r["key"] != key or r["metric"] != metric for r in self.rows):
            self.rows.append({"key": key, "source": source, "metric": metric, "text": text, "tags": sorted(set(tags)), "used": 0})
            self._save()

    def find(self, source: str, metric: str, tags: list[str]) -> dict | None:
        def overlap(r: dict) -> float:
            a, b = set(tags), set(r["tags"])
            return len(a & b) / len(a | b) if a | b else 1.0

        fit = [r for r in self.rows if (r["source"], r["metric"]) == (source, metric)]
        if not fit:
            return None
        best = max(fit, key=lambda r: (overlap(r), r["used"], r["key"]))
        best["used"] += 1
        self._save()
        return best | {"overlap": overlap(best)}

    def stats(self) -> dict:
        return {"queries": len(self.rows), "reused": sum(r["used"] for r in self.rows)}
