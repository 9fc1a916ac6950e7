"""Benchmark decontamination (1), native: SimHash windows of item size, Hamming block index, exact verification.

A text is lower-cased and cut into words (runs of anything but ASCII white space). An item of w words is compared with
windows of w words (the whole text where that is shorter). Shingles are ``shingle`` words long, or all w of a shorter
item. Similarity is weighted Jaccard: shingles weigh as often as they occur, sum of minima over sum of maxima.

1. Similarity above 0 needs a shared shingle, so windows are cut only where an item and a text share one: the shingle at
   word p of the text and q of the item puts the window at p - q. A Bloom filter of the item shingles, of at
   most ``bloom_bits`` bits whatever the benchmark, first sets aside the texts without any (it loses none); the shingles
   of the rest that pass it are joined with those of the items by value.
2. Each window gets a SimHash of its words, 64 bits, weighted by occurrence. Fingerprints are cut into ``blocks`` blocks;
   two that differ in at most ``radius`` bits differ in at most ``radius // blocks`` bits of some block, so an equi-join on
   (item size, block, value), the items' side spread to all values that near, finds every pair within the radius.
3. Those pairs are verified exactly. A hit is a similarity of ``similarity`` or more.

Defined results: null and blank texts and items match nothing; rows equal in doc_id and text give one hit per item;
ties between windows of a text go to the first; a doc_id with several texts may have several hits of an item; an empty table of either kind gives no hits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, table, words


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    similarity: float = 0.8
    radius: int = 15
    blocks: int = 8
    bloom_bits: int = 1 << 24
    #: An item table of more shingles than this is joined by shuffle, below it by broadcast.
    broadcast_rows: int = 500_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once per row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _one() -> Column:
    return F.lit(1).cast("bigint")


def _runs(ws: Column, size: int) -> Column:
    """The hashes of all runs of ``size`` words, in order; none where the text is shorter."""
    at = lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(size)])
    return F.when(F.size(ws) >= size, F.transform(F.sequence(F.lit(0), F.size(ws) - size), at)).otherwise(F.array().cast("array<bigint>"))


def _sized_runs(ws: Column, k: Column, sizes: list[int]) -> Column:
    """_runs with the size in a column, one of sizes."""
    out = F.array().cast("array<bigint>")
    for size in sizes:
        out = F.when(k == size, _runs(ws, size)).otherwise(out)
    return out


def simhash(ws: Column) -> Column:
    """64 bits; bit i is set where the words whose hash has it outnumber the others. Repeats count."""
    def of(hashes: Column) -> Column:
        votes = lambda i: F.aggregate(hashes, F.lit(0), lambda acc, h: acc + F.getbit(h, i))
        bit = lambda i: F.when(2 * votes(i) > F.size(hashes), F.call_function("shiftleft", _one(), i)).otherwise(F.lit(0).cast("bigint"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, i: acc.bitwiseOR(bit(i)))

    return let(F.transform(ws, lambda w: F.xxhash64(w)), of)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two non-empty arrays of hashes, as multisets."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    return let(shared, lambda s: s / (F.size(a) + F.size(b) - s))


class Index:
    """The item tables of a benchmark and what is asked of them. Item tables stay DataFrames; the driver sees a count,
    the shingle sizes (at most ``shingle`` of them) and the bits of the Bloom filter (of bounded size)."""

    def __init__(self, benchmark: DataFrame, params: Params = Params(), text: str = "text", item_id: str = "item_id"):
        self.params = params
        ws = words(F.lower(benchmark[text].cast("string")))
        items = benchmark.select(benchmark[item_id].alias("item_id"), ws.alias("iw")).where("size(iw) > 0")
        items = items.withColumn("n", F.size("iw")).withColumn("k", F.least(F.lit(params.shingle), F.col("n")))
        sizes = list(range(1, params.shingle + 1))
        self.items = items.withColumn("ish", _sized_runs(F.col("iw"), F.col("k"), sizes)).withColumn("ifp", simhash(F.col("iw"))).drop("iw")
        self.anchors = self.items.select("n", "k", F.posexplode("ish").alias("q", "h")).distinct()
        facts = self.items.agg(F.sum(F.size("ish")), F.collect_set("k")).first()
        self.rows, self.sizes = facts[0] or 0, sorted(facts[1] or [])
        self.bits = min(params.bloom_bits, max(1 << 10, 1 << (128 * self.rows).bit_length()))
        self.bloom = self._fill() if self.rows else None

    def small(self, df: DataFrame, rows: int) -> DataFrame:
        """Broadcast if the counted rows are few enough."""
        return F.broadcast(df) if rows <= self.params.broadcast_rows else df

    def _probe(self, h: Column, p: int) -> Column:
        return F.shiftrightunsigned(h, 20 * p).bitwiseAND(F.lit(self.bits - 1)).cast("int")

    def _fill(self) -> Column:
        probes = self.anchors.select(F.explode(F.array(*[self._probe(F.col("h"), p) for p in range(3)])).alias("bit"))
        word = F.call_function("shiftleft", _one(), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))
        out = [0] * (self.bits // 64)
        for r in probes.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(word).alias("v")).collect():  # at most bits / 64 rows
            out[r["at"]] = r["v"]
        return F.from_json(F.lit("[" + ",".join(map(str, out)) + "]"), "array<bigint>")  # folded to one literal

    def inside(self, h: Column) -> Column:
        """False only if no item has the shingle hash."""
        hit = lambda p: F.getbit(F.get(self.bloom, F.shiftright(self._probe(h, p), 6)), self._probe(h, p).bitwiseAND(F.lit(63))) == 1
        return hit(0) & hit(1) & hit(2)

    def may_hit(self, text: Column) -> Column:
        """False only if the text shares no shingle with any item."""
        if self.bloom is None:
            return F.lit(False)

        def found(ws: Column) -> Column:
            out = F.lit(False)
            for k in self.sizes:
                out = out | F.exists(_runs(ws, k), self.inside)
            return out

        return F.coalesce(let(words(F.lower(text)), found), F.lit(False))

    def windows(self, texts: DataFrame) -> DataFrame:
        """(tk, start, n, k, window) of texts (tk, text): item-sized windows that put a shared shingle where the item has it.

        Shared shingles travel without the words; a window's words are cut out where it meets its text again."""
        def passed(ws: Column) -> Column:
            of = lambda k: F.filter(F.transform(_runs(ws, k), lambda h, p: F.struct(F.lit(k).alias("k"), p.alias("p"), h.alias("h"))), lambda x: self.inside(x["h"]))
            return F.concat(*[of(k) for k in self.sizes])

        found = texts.select("tk", let(words(F.lower("text")), lambda ws: F.struct(F.size(ws).alias("m"), passed(ws).alias("xs"))).alias("t"))
        rows = found.select("tk", F.col("t.m").alias("m"), F.inline("t.xs"))
        start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("m") - F.col("n")))
        places = rows.join(self.small(self.anchors, self.rows), ["k", "h"]).select("tk", start.alias("start"), "n", "k").distinct()
        cut = places.join(texts.select("tk", words(F.lower("text")).alias("ws")), "tk")
        return cut.select("tk", "start", "n", "k", F.slice("ws", F.col("start") + 1, F.col("n")).alias("window"))

    def pairs(self, texts: DataFrame) -> DataFrame:
        """(tk, n, start, item_id, similarity, hamming) of windows within the radius of an item and similar enough."""
        p = self.params
        width, near = 64 // p.blocks, p.radius // p.blocks
        masks = [sum(1 << i for i in c) for size in range(near + 1) for c in combinations(range(width), size)]
        block = lambda fp: F.posexplode(F.array(*[F.shiftrightunsigned(fp, b * width).bitwiseAND(F.lit((1 << width) - 1)) for b in range(p.blocks)])).alias("b", "v")
        spread = self.items.select("*", block(F.col("ifp"))).select("item_id", "n", "ish", "ifp", "b", F.explode(F.array(*[F.col("v").bitwiseXOR(F.lit(m)) for m in masks])).alias("v"))
        w = self.windows(texts).withColumn("wsh", _sized_runs(F.col("window"), F.col("k"), self.sizes)).withColumn("wfp", simhash(F.col("window"))).drop("window", "k")
        met = w.select("*", block(F.col("wfp"))).join(self.small(spread, self.rows * p.blocks * len(masks)), ["n", "b", "v"])
        hamming = F.bit_count(F.col("wfp").bitwiseXOR(F.col("ifp")))
        within = met.where(hamming <= p.radius).dropDuplicates(["tk", "start", "n", "item_id"])
        return within.select("tk", "n", "start", "item_id", weighted_jaccard(F.col("wsh"), F.col("ish")).alias("similarity"), hamming.cast("int").alias("hamming")).where(F.col("similarity") >= p.similarity)

    def best(self, asked: DataFrame) -> DataFrame:
        """(tk, item_id, start, similarity, hamming) of stored texts (tk, text, ...): the first window of greatest
        similarity. Equal texts are looked at once."""
        found = self.pairs(asked.select("tk", "text").dropDuplicates(["tk"])).groupBy("tk", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "hamming")).alias("best"))
        return found.select("tk", "item_id", (-F.col("best.back")).alias("start"), "best.similarity", "best.hamming")


def _asked(docs: DataFrame, index: Index, text: str, *more: Column) -> DataFrame:
    """The texts that may hold an item, with a key of their own, stored: what follows reads them several times."""
    rows = docs.select(*more, docs[text].cast("string").alias("text")).where(index.may_hit(F.col("text")))
    return Tables(docs.sparkSession, "decontaminate").put(rows.withColumn("tk", F.sha2("text", 256)))


def find_contamination(docs: DataFrame, benchmark: DataFrame, params: Params = Params(), text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, start (word), similarity, hamming."""
    index = Index(benchmark, params)
    asked = _asked(docs, index, text, docs[id_column].alias("doc_id"))
    if index.bloom is None:
        return asked.select("doc_id", F.lit(None).cast(index.items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start"), F.lit(0.0).alias("similarity"), F.lit(0).alias("hamming"))
    ids = asked.select("doc_id", "tk").distinct()
    return ids.join(index.best(asked), "tk").select("doc_id", "item_id", "start", "similarity", "hamming")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, params: Params = Params(), text: str = "text") -> DataFrame:
    """The documents without a hit, with their columns. Texts that share no shingle with an item pass without a shuffle."""
    index = Index(benchmark, params)
    if index.bloom is None:
        return docs
    names = docs.columns
    row = F.struct(*[docs[c] for c in names]).alias("_row")
    clean = docs.select(row, docs[text].cast("string").alias("text")).where(~index.may_hit(F.col("text")))
    asked = _asked(docs, index, text, row)
    kept = clean.select("_row").unionByName(asked.join(index.best(asked).select("tk").distinct(), "tk", "left_anti").select("_row"))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in names])


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontamination": op1_decontamination}
SQL: dict[str, str] = {}
