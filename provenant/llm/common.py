"""What the operators of this subpackage share: words, the shared folder, intermediate tables, graph components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space. ``bytes.split()`` splits on exactly these six characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one under a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """At the end of a task: what it freed goes back to the system. Spark keeps Python workers for later stages, which would
    else hold the memory of earlier ones."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_KEPT: dict = {}
_IDLE: list[threading.Timer] = []


def kept(key: Hashable, make: Callable):
    """What this worker keeps between tasks: Spark reuses Python workers, so a later task finds what an earlier one made.
    Only one thing is kept; a task that asks for another one, or lets go, has the memory for itself."""
    while _IDLE:
        _IDLE.pop().cancel()
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """What an earlier task of this worker kept goes, and its memory goes back to the system."""
    while _IDLE:
        _IDLE.pop().cancel()
    if _KEPT:
        _KEPT.clear()
        release()


def rests(seconds: float) -> None:
    """After a task: what is kept goes if no other task asks for it soon, so an idle worker holds no memory."""
    timer = threading.Timer(seconds, let_go)
    timer.daemon = True
    timer.start()
    _IDLE.append(timer)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Meanwhile a batch of rows goes to Python when it has so many bytes, however few rows they are: Spark counts rows (10,000),
    and both sides hold the batch. It holds for what is both planned and run
    in the meantime. The session's setting comes back, and a smaller one stays."""
    own = spark.conf.get(BATCH_BYTES, None)  # None: the default holds
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_BYTES))
    if 0 < now <= size:
        yield
        return
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, own)


class Tables:
    """Intermediate tables, written once in the shared folder (lineage ends there); dropped when no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, new_folder(spark, name), 0

    def put(self, df: DataFrame) -> DataFrame:
        """The stored table; its ``rows`` were counted as they were written."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stored_at, out.rows = path, seen.get["rows"]
        return out

    def drop(self, *stored: DataFrame) -> None:
        for df in stored:
            delete(self.spark, df.stored_at)


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """size(words(text)) without a pass over the array: only its first and last pieces can be empty."""
    pieces = F.split(F.coalesce(text, F.lit("")), SPACE)
    count = F.aggregate(
        F.array(pieces), F.lit(0).cast("bigint"),
        lambda acc, p: acc + F.size(p) - F.when(F.element_at(p, 1) == "", 1).otherwise(0)
        - F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0),
    )
    return count


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers without visible structure."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def smallest_in_component(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, label of each) of links in memory: every root is hooked to the least root it is linked with, then paths are
    halved until they end; a few rounds for any shape."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a):]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low < high
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(up := root[root], root):
            root = up
    return nodes, nodes[root]


def _in_one_task(links: DataFrame) -> DataFrame:
    """(node, label) of links that were counted and are few."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            made = smallest_in_component(*(np.concatenate(c) for c in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], names=["node", "label"])
        release()

    return links.select("a", "b").coalesce(1).mapInArrow(work, "node bigint, label bigint")


def components(links: DataFrame, tables: Tables, few: int = 4_000_000, rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b): a stored row (node, label) for every node of a link, label the smallest node.

    Links are stored and counted. Up to ``few`` of them (32 bytes each) are settled by one task. More go through alternating
    large-star and small-star steps, by shuffles, until no link changes or few are left. Only a count and a checksum reach
    the driver. Self links and repeated links are allowed; without links there are no rows.
    """
    def step(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = near.join(low, "a")
        moved = joined.where("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if large:
            return moved.where("a <> b").distinct()
        return moved.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    edges, seen = tables.put(links.where("a <> b").select("a", "b")), None
    for _ in range(rounds):
        if edges.rows <= few:
            out = tables.put(_in_one_task(edges))
            tables.drop(edges)
            return out
        after = tables.put(step(step(edges, True), False))
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        tables.drop(edges)
        edges = after
        if tuple(state) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        seen = tuple(state)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def joined_components(labels: DataFrame, more: DataFrame, tables: Tables, few: int = 4_000_000) -> DataFrame:
    """The components of the links behind ``labels`` (node, label) and of further ones (a, b): only what the further links
    join, seen from the components so far, is worked out."""
    if not more.rows:
        return labels
    of_a, of_b = labels.toDF("a", "la"), labels.toDF("b", "lb")
    between = more.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    over = components(between, tables, few)
    moved = labels.join(over.toDF("label", "lower"), "label", "left").select("node", F.coalesce("lower", "label").alias("label"))
    return tables.put(moved.unionByName(over.join(labels.select("node"), "node", "left_anti")))
