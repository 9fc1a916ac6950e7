"""SQL aggregate expressions as DAX measures, from the parser's own tree. What has no sure equivalent is refused."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import ParseException
from pyspark.sql import SparkSession

from ..operators.model.tiers import TierPolicy
from .semantic import METRICS, Metric


class CannotTranslate(ValueError):
    """A construct without a DAX form, with the reason."""


REFUSED = {
    "WindowExpression": "a window function is no measure; rank with RANKX by hand", "ScalarSubquery": "subqueries are not supported", "Exists": "subqueries are not supported",
    "InSubquery": "subqueries are not supported", "ListQuery": "subqueries are not supported", "LambdaFunction": "lambdas are not supported",
}
BINARY = {"Add": "+", "Subtract": "-", "Multiply": "*", "EqualTo": "=", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "LessThan": "<", "LessThanOrEqual": "<=", "And": "&&", "Or": "||"}
AGGREGATES = {"sum": "SUM", "avg": "AVERAGE", "mean": "AVERAGE", "min": "MIN", "max": "MAX"}


def _list(seq) -> list:
    out, it = [], seq.iterator()
    while it.hasNext():
        out.append(it.next())
    return out


def _kind(e) -> str:
    return e.getClass().getSimpleName()


class _Walk:
    def __init__(self, table: str):
        self.table, self.columns = table, set()

    def __call__(self, e) -> str:
        kind = _kind(e)
        if kind in REFUSED:
            raise CannotTranslate(f"{e.sql() if kind != 'ScalarSubquery' else kind}: {REFUSED[kind]}")
        kids = _list(e.children())
        if kind == "UnresolvedAttribute":
            name = _list(e.nameParts())[-1]
            self.columns.add(name)
            return f"{self.table}[{name}]"
        if kind == "Literal":
            return self.literal(e)
        if kind in BINARY:
            a, b = (self.operand(k, kind) for k in kids)
            return f"({a} {BINARY[kind]} {b})" if kind in ("And", "Or") else f"{a} {BINARY[kind]} {b}"
        if kind == "Divide":
            return f"DIVIDE({self(kids[0])}, {self(kids[1])})"
        if kind == "UnaryMinus":
            return f"-{self(kids[0])}"
        if kind == "Not":
            inner = kids[0]
            if _kind(inner) == "EqualTo":
                a, b = _list(inner.children())
                return f"{self(a)} <> {self(b)}"
            return f"NOT({self(inner)})"
        if kind == "IsNull":
            return f"ISBLANK({self(kids[0])})"
        if kind == "IsNotNull":
            return f"NOT(ISBLANK({self(kids[0])}))"
        if kind in ("Cast", "UnresolvedAlias", "Alias"):
            return self(kids[0])  # DAX has no casts of its own
        if kind == "In":
            return f"{self(kids[0])} IN {{{', '.join(self(k) for k in kids[1:])}}}"
        if kind == "CaseWhen":
            return self.case(kids)
        if kind == "If":
            return f"IF({', '.join(self(k) for k in kids)})"
        if kind == "UnresolvedFunction":
            return self.function(e, kids)
        raise CannotTranslate(f"{kind} has no DAX form here")

    def operand(self, e, parent: str) -> str:
        text = self(e)
        weak = _kind(e) in ("Add", "Subtract")
        return f"({text})" if weak and parent in ("Multiply", "Subtract") else text

    def literal(self, e) -> str:
        kind = e.dataType().typeName()
        value = e.value()
        if value is None:
            return "BLANK()"
        if kind == "string":
            return '"' + str(value).replace('"', '""') + '"'
        if kind == "boolean":
            return "TRUE()" if str(value).lower() == "true" else "FALSE()"
        return str(value)

    def case(self, kids: list) -> str:
        arms, rest = kids[: len(kids) // 2 * 2], kids[len(kids) // 2 * 2:]
        if len(arms) == 2 and rest:
            return f"IF({self(arms[0])}, {self(arms[1])}, {self(rest[0])})"
        return "SWITCH(TRUE(), " + ", ".join(self(k) for k in [*arms, *rest]) + ")"

    def function(self, e, kids: list) -> str:
        name = _list(e.nameParts())[-1].lower()
        where = e.filter()
        out = self.call(name, e.isDistinct(), kids)
        return f"CALCULATE({out}, {self(where.get())})" if where.isDefined() else out

    def call(self, name: str, distinct: bool, kids: list) -> str:
        if name in AGGREGATES and len(kids) == 1 and not distinct:
            return f"{AGGREGATES[name]}({self(kids[0])})"
        if name == "count":
            if not kids or _kind(kids[0]) in ("UnresolvedStar", "Literal"):
                return f"COUNTROWS({self.table})"
            if len(kids) != 1:
                raise CannotTranslate("a count of several columns has no DAX form here")
            if _kind(kids[0]) == "CaseWhen":
                arms = _list(kids[0].children())
                if len(arms) != 2:
                    raise CannotTranslate("a counted CASE may have one WHEN and no ELSE")
                return f"CALCULATE({'DISTINCTCOUNT' if distinct else 'COUNTA'}({self(arms[1])}), {self(arms[0])})"
            return f"{'DISTINCTCOUNT' if distinct else 'COUNTA'}({self(kids[0])})"
        if name == "try_divide":
            return f"DIVIDE({self(kids[0])}, {self(kids[1])})"
        if name == "nullif":
            if _kind(kids[1]) == "Literal" and str(kids[1].value()) == "0":
                return self(kids[0])  # DIVIDE gives blank for a denominator of 0
            return f"IF({self(kids[0])} = {self(kids[1])}, BLANK(), {self(kids[0])})"
        if name == "coalesce":
            return f"COALESCE({', '.join(self(k) for k in kids)})"
        raise CannotTranslate(f"{name}() has no DAX form here")


def transpile(spark: SparkSession, expression: str, table: str, columns: set[str] | None = None) -> str:
    """DAX for one scalar aggregate expression; with ``columns``, a name that is none of them is refused."""
    text = " ".join(expression.split())
    if text.lower().startswith(("select ", "with ")):
        raise CannotTranslate("a query is no measure; give a scalar aggregate")
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    except (ParseException, Py4JError) as e:
        raise CannotTranslate(f"{text}: does not parse: {str(e).splitlines()[0][:120]}") from e
    walk = _Walk(table)
    out = walk(tree)
    missing = sorted(c for c in walk.columns if columns is not None and c.lower() not in {x.lower() for x in columns})
    if missing:
        raise CannotTranslate(f"{table} has no column {', '.join(missing)}")
    return out


@dataclass(frozen=True)
class Measure:
    name: str
    expression: str
    format: str = ""
    confidence: str = "exact"

    def tmdl(self) -> str:
        lines = [f"\tmeasure '{self.name}' = {self.expression}"]
        return "\n".join(lines + ([f"\t\tformatString: {self.format}"] if self.format else []))


FORMATS = {"ratio": '"0.0%"', "currency": '"\\$#,0.00"', "count": '"#,0"'}


def measure_of(spark: SparkSession, metric: Metric, table: str, columns: set[str] | None = None, overrides: dict[str, str] | None = None) -> Measure:
    """An override, marked as one, or the translated formula."""
    name, written = metric.name.replace("_", " ").title(), (overrides or {}).get(metric.name)
    return Measure(name, written or transpile(spark, metric.expression, table, columns), FORMATS.get(metric.unit, ""), "override" if written else "exact")


def bound_measures(table: str, target: str, entity: str, numeric: tuple[str, ...] = (), value: str | None = None, scores: str = "RiskScores", policy: TierPolicy = TierPolicy()) -> list[Measure]:
    """Measures from the columns that an analysis bound to its roles: how many entities, how many with the outcome, means of
    the numeric columns on both sides of it, and the tiers with a check that file and model agree on them."""
    at = lambda t, c: f"'{t}'[{c.replace(']', ']]')}]"
    having = lambda what, v: f"CALCULATE({what}, {at(table, target)} = {v})"
    riskiest, tier = policy.bands[-1][0], at(scores, "risk_tier")
    out = [
        Measure("Entities", f"DISTINCTCOUNT({at(table, entity)})", FORMATS["count"], "bound"),
        Measure("Entities with Outcome", having("[Entities]", 1), FORMATS["count"], "bound"),
        Measure("Outcome Rate", "DIVIDE([Entities with Outcome], [Entities])", FORMATS["ratio"], "bound"),
    ]
    for c in numeric:
        mean = f"AVERAGE({at(table, c)})"
        out += [Measure(f"Mean {c} {side}", having(mean, v), '"0.0"', "bound") for v, side in ((1, "with Outcome"), (0, "without Outcome"))]
    out.append(Measure(f"{riskiest} Tier Entities", f'CALCULATE([Entities], {tier} = "{riskiest}")', FORMATS["count"], "bound"))
    if value:
        out.append(Measure(f"{riskiest} Tier Value", f'CALCULATE(SUM({at(table, value)}), {tier} = "{riskiest}")', FORMATS["currency"], f"assumes that {value} is the value at risk"))
    again = policy.dax(scores)
    out.append(Measure("Tier Mismatches", f"COUNTROWS(FILTER('{scores}', {tier} <> {again}))", FORMATS["count"], "must be 0"))
    return out


def measures_of_all(spark: SparkSession, table: str, columns: set[str], metrics: dict[str, Metric] = METRICS) -> tuple[list[Measure], dict[str, str]]:
    """The locked metrics that the table's columns allow, and for the others why not."""
    made, refused = [], {}
    for m in metrics.values():
        try:
            made.append(measure_of(spark, m, table, columns))
        except CannotTranslate as e:
            refused[m.name] = str(e)
    return made, refused


def project(name: str, tables: dict[str, dict[str, str]], measures: dict[str, list[Measure]], relationships: list[tuple[tuple[str, str], tuple[str, str]]] = ()) -> dict[str, str]:
    """The text files of a semantic model by path: the model, a file per table, the relationships. A relationship to a
    table or column that is not in the model is refused. Reports and layouts are not made."""
    for t, c in (end for r in relationships for end in r):
        if c not in tables.get(t, {}):
            raise CannotTranslate(f"no column {c} in a table {t} of {name}")
    root = f"{name}.SemanticModel/definition"
    files = {f"{root}/model.tmdl": f"model '{name}'\n" + "".join(f"ref table '{t}'\n" for t in tables)}
    files |= {f"{root}/tables/{t}.tmdl": table_tmdl(t, schema, measures.get(t, [])) for t, schema in tables.items()}
    if relationships:
        files[f"{root}/relationships.tmdl"] = "\n".join(relationship_tmdl(a, b) for a, b in relationships)
    return files


TYPES = {"bigint": "int64", "int": "int64", "smallint": "int64", "tinyint": "int64", "double": "double", "float": "double", "boolean": "boolean", "date": "dateTime", "timestamp": "dateTime", "timestamp_ntz": "dateTime"}


def table_tmdl(name: str, schema: dict[str, str], measures: list[Measure]) -> str:
    """A table of a semantic model: columns by type, then measures."""
    kind = lambda t: "decimal" if t.startswith("decimal") else TYPES.get(t, "string")
    lines = [f"table '{name}'"] + [m.tmdl() for m in measures]
    lines += [f"\tcolumn '{c}'\n\t\tdataType: {kind(t)}\n\t\tsourceColumn: {c}" for c, t in schema.items()]
    return "\n".join(lines) + "\n"


def relationship_tmdl(left: tuple[str, str], right: tuple[str, str]) -> str:
    return f"relationship {left[0]}_{right[0]}\n\tfromColumn: '{left[0]}'.'{left[1]}'\n\ttoColumn: '{right[0]}'.'{right[1]}'\n"
