"""Read-only SQL, judged by the parser, and budgets of queries, bytes and time."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession


class UnsafeSQL(ValueError):
    """Not a single read-only statement."""


#: Logical plans of statements that only read. Others (commands, inserts, DDL) are refused.
READING_COMMANDS = ("ShowTables", "ShowColumns", "ShowNamespaces", "ShowViews", "ShowFunctions", "ShowTableProperties", "ShowCatalogsCommand", "DescribeRelation", "DescribeColumn", "DescribeQueryCommand", "DescribeFunction", "ExplainCommand")


def _nodes(plan) -> list:
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        out.append(p)
        for kids in (p.children(), p.innerChildren()):
            it = kids.iterator()
            while it.hasNext():
                kid = it.next()
                if hasattr(kid, "children"):
                    todo.append(kid)
    return out


def assert_read_only(spark: SparkSession, sql: str) -> None:
    """Raises UnsafeSQL unless the text is one statement that only reads. The parser decides, so words in literals,
    comments or names do not matter; a second statement does not parse."""
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise UnsafeSQL("empty statement")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except (ParseException, Py4JError) as e:
        raise UnsafeSQL(f"no single SQL statement: {str(e).splitlines()[0][:200]}") from e
    root = plan.getClass().getSimpleName()
    for node in _nodes(plan):
        name = node.getClass().getSimpleName()
        is_command = "Command" in name or any(i.getSimpleName() == "Command" for i in _interfaces(node.getClass()))
        if (is_command or name.startswith(("Insert", "Create", "Drop", "Alter", "Replace", "Delete", "Update", "Merge", "Truncate", "Set"))) and name not in READING_COMMANDS:
            raise UnsafeSQL(f"{name} is no read-only statement")
    if root == "ExplainCommand":
        inner = plan.logicalPlan()
        if "Command" in inner.getClass().getSimpleName():
            raise UnsafeSQL("EXPLAIN of a command")


def _interfaces(cls) -> list:
    out, todo = [], [cls]
    while todo:
        c = todo.pop()
        if c is None:
            continue
        for i in c.getInterfaces():
            out.append(i)
            todo.append(i)
        todo.append(c.getSuperclass())
    return out


def is_read_only(spark: SparkSession, sql: str) -> bool:
    try:
        assert_read_only(spark, sql)
    except UnsafeSQL:
        return False
    return True


class BudgetExceeded(RuntimeError):
    pass


@dataclass
class Budget:
    """Caps of a run, checked before each query."""

    queries: int = 60
    bytes: int = 5_000_000_000
    seconds: float = 1200.0
    used_queries: int = 0
    used_bytes: int = 0
    began: float = field(default_factory=time.monotonic)

    def charge(self, size: int = 0) -> None:
        self.used_queries += 1
        self.used_bytes += size
        self.check()

    def check(self) -> None:
        for what, used, most in (("queries", self.used_queries, self.queries), ("bytes", self.used_bytes, self.bytes), ("seconds", time.monotonic() - self.began, self.seconds)):
            if used > most:
                raise BudgetExceeded(f"{used:.0f} {what} used of {most:.0f}")

    def snapshot(self) -> dict:
        return {"queries": self.used_queries, "bytes": self.used_bytes, "seconds": time.monotonic() - self.began}


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's size of what the scans of a plan read; a scan without statistics counts as 0."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total, it = 0, leaves.iterator()
    while it.hasNext():
        size = int(str(it.next().stats().sizeInBytes()))
        total += size if size < 1 << 60 else 0
    return total
