"""Mixing sources to target weights (5), native: hash-threshold histograms.

A document's size is its number of words (runs of anything but ASCII white space). Sources in code-point order, null
last, weigh ``weights``, repeating, and share the total size by weight; a target stops at ``cap`` times its source's
size and the excess is reshared by weight until none is above (that limit has a closed form over the sources in order of
size per weight). A source whose target is q whole sizes and a rest takes every document q times, and those whose hash
is at most a threshold once more.

The threshold comes without sorting: sizes are summed by source and the leading ``bits`` of a 60-bit hash of id and text;
the bucket in which the running sum crosses the budget is the only one that is refined by its next bits, until it holds
one hash value. That value is taken if it brings the sum nearer to the budget. Each level costs one aggregation, of
which only the first is over all rows; the hash makes it stable between runs and nested between budgets.

Defined results: null and blank texts have size 0 and are never counted; rows equal in id and text share a hash and are
taken together; without words all targets are 0; a null id hashes as an empty one; an empty table has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, n_words, table

HASH_BITS = 60


@dataclass(frozen=True)
class Params:
    weights: tuple[int, ...] = (5, 2, 1)
    cap: int = 3
    bits: int = 12


def hash60(id_column: Column, text: Column) -> Column:
    name = F.concat(F.coalesce(id_column.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")


def targets(sizes: DataFrame, params: Params) -> DataFrame:
    """(source, source_size) to (source, source_size, target): a row per source, in one task."""
    cap, everything = params.cap, Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in params.weights]), F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(params.weights))).cast("int") + 1)
    big = lambda c: c.cast("decimal(38,0)")
    rows = sizes.select("source", "source_size", weight.alias("w"))
    order = Window.orderBy(F.col("source_size") * float(cap) / F.col("w"), F.col("source").asc_nulls_last())
    rows = rows.select(
        "*", F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum(F.col("source_size") * cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")).alias("before"),
        F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("after"),
    )
    free = big(F.col("total") - F.col("before")) * big(F.col("w")) <= big(F.col("source_size") * cap) * big(F.col("after"))
    rows = rows.withColumn("free", free)
    shared = F.col("total") - F.min(F.when(F.col("free"), F.col("before"))).over(everything)
    among = F.max(F.when(F.col("free"), F.col("after"))).over(everything)
    target = F.when(F.col("free"), (shared * F.col("w")).cast("double") / among.cast("double")).otherwise((F.col("source_size") * cap).cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, tables: Tables, params: Params) -> DataFrame:
    """A stored row per source: source, source_size, target, whole (times all documents are taken), last (the largest
    hash taken once more; -1: none). ``sized`` is a stored table (source, size, h)."""
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(per_source, params)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    goal = goal.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    state = tables.put(goal.select("*", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("base"), F.when(F.col("budget") > 0, F.lit(None)).otherwise(F.lit(-1)).cast("bigint").alias("last")))
    shift = HASH_BITS
    while shift > 0 and not state.where("last is null").isEmpty():
        above, shift = shift, max(0, shift - params.bits)
        docs = sized.where("size > 0").select("source", "size", "h", F.shiftright("h", above).alias("prefix"))
        active = state.where("last is null").select(F.col("source").alias("_s"), F.col("prefix").alias("_p"))
        docs = docs.join(active, F.col("source").eqNullSafe(F.col("_s")) & (F.col("prefix") == F.col("_p")), "left_semi")
        sums = docs.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("s"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        upto = F.sum("s").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        sums = sums.select(F.col("source").alias("_s"), "bucket", "s", "lo", "hi", upto.alias("upto"))
        met = state.join(sums, F.col("source").eqNullSafe(F.col("_s")) & F.col("last").isNull(), "left").where("last is not null or base + upto >= budget")
        edge = met.groupBy(*state.columns).agg(F.min(F.struct("bucket", "s", "lo", "hi", "upto")).alias("e"))
        start = F.col("base") + F.col("e.upto") - F.col("e.s")
        nearer = start + F.col("e.s") - F.col("budget") < F.col("budget") - start
        done = F.when(F.col("last").isNotNull(), F.col("last")).when(F.col("e.lo") == F.col("e.hi"), F.when(nearer, F.col("e.lo")).otherwise(F.col("e.lo") - 1))
        after = tables.put(edge.select("source", "source_size", "target", "whole", "budget", F.coalesce("e.bucket", "prefix").alias("prefix"), F.coalesce(start, F.col("base")).alias("base"), done.alias("last")))
        tables.drop(state)
        state = after
    return state.select("source", "source_size", "target", "whole", F.coalesce("last", F.lit(-1)).alias("last"))


def _sized(docs: DataFrame, text: str, source: str, id_column: str, *more: Column) -> DataFrame:
    text_of = docs[text].cast("string")
    return docs.select(*more, docs[source].cast("string").alias("source"), n_words(text_of).alias("size"), hash60(docs[id_column], text_of).alias("h"))


def mix(docs: DataFrame, params: Params = Params(), text: str = "text", source: str = "source", id_column: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source), taken (words, repeats counted)."""
    tables = Tables(docs.sparkSession, "mixing")
    sized = tables.put(_sized(docs, text, source, id_column, docs[id_column].alias("doc_id")))
    limits = thresholds(sized, tables, params).withColumnRenamed("source", "_s")
    rows = sized.join(limits, F.col("source").eqNullSafe(F.col("_s")))
    times = F.col("whole") + F.when(F.col("h") <= F.col("last"), 1).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def take_mix(docs: DataFrame, params: Params = Params(), text: str = "text", source: str = "source", id_column: str = "doc_id") -> DataFrame:
    """The rows of the mix: each document as often as it is taken, with its columns."""
    tables = Tables(docs.sparkSession, "mixing")
    sized = tables.put(_sized(docs, text, source, id_column))
    limits = thresholds(sized, tables, params).withColumnRenamed("source", "_s")
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), docs[source].cast("string").alias("_source"), hash60(docs[id_column], docs[text].cast("string")).alias("_h"))
    times = F.col("whole") + F.when(F.col("_h") <= F.col("last"), 1).otherwise(0)
    met = rows.join(limits, F.col("_source").eqNullSafe(F.col("_s"))).select("_row", times.cast("int").alias("_times")).where("_times > 0")
    repeated = met.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return repeated.select(*[F.col("_row").getField(c).alias(c) for c in names])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
  FROM s WINDOW o AS (ORDER BY source_size * 3.0::DOUBLE / w, source NULLS LAST)
), f AS (
  SELECT *, (total - before) * w <= 3 * source_size * after AS free FROM r
), t AS (
  SELECT source, source_size, CASE WHEN free
    THEN CAST((total - min(before) FILTER (WHERE free) OVER ()) * w AS DOUBLE) / CAST(max(after) FILTER (WHERE free) OVER () AS DOUBLE)
    ELSE CAST(3 * source_size AS DOUBLE) END AS target
  FROM f
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), c AS (
  SELECT d.*, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS budget,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING), 0) AS BIGINT) AS upto,
    CAST(sum(size) OVER (PARTITION BY d.source, h) AS BIGINT) AS own
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, source, size, source_size, target,
  CAST(size * (whole + CASE WHEN budget > 0 AND (upto < budget OR (upto - own < budget AND upto - budget < budget - (upto - own))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""

QUERIES = {"op5_mixing": op5_mixing}
SQL = {"op5_mixing": OP5_SQL}
