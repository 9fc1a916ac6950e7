"""MinHash near-dedup (7): banded candidates, sequential Bayesian pruning of signature batches, exact verification.

A document's set holds its distinct shingles of ``Params.shingle`` words (A-Z lower-cased; a word is a run of anything
but ASCII white space); a shorter text has one shingle, the whole sequence. Documents are linked when the Jaccard
similarity of their full sets reaches ``percent``; the connected components of these links are the groups.

How links are found without expanding a group into its pairs:

1. One Arrow pass makes a row (node, size, signature) per document. A node is a distinct set, so exact copies meet in
   one node; a task sends the signature of a node once, so a hot text costs a row per task and not one per copy.
2. ``bands`` band keys per node; a bucket is a key with two or more nodes. Each node is paired with the hub of each of
   its buckets, the member with the most neighbours over all its buckets, which in a family of variants is the text they
   vary: as many pairs as memberships, never a bucket's square.
3. Sequential Bayesian verification: signatures are compared in batches; after each batch a pair is dropped once the
   posterior (uniform prior) that its similarity reaches the threshold is below ``miss``.
4. Survivors are verified on full texts, for each node the likeliest hub first; pairs already in one component need no
   verification, the others follow.
5. Buckets whose nodes still lie in several components are settled in blocks: a further sketch of ``fine`` bytes per node
   is compared, by the same sequential test, for the pairs across components, in memory and within tasks that get two
   blocks of a bucket each; only survivors become rows and are verified.

A pair at the threshold shares no band with probability (1 - t^rows)^bands, 5e-6 with the defaults; steps 3 and 5 add
``miss`` per batch. Nothing else is lost: no cap on buckets, partners or text.

Defined results: null and blank texts have an empty set and link with nothing; copies share a component; rows that repeat
a doc_id are one document and stay together; a null doc_id is larger than any number; an empty table has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, Tables, components, joined_components, mix64, release, table


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6
    batch: int = 48
    miss: float = 1e-5
    fine: int = 1024
    block: int = 1024
    #: Up to so many links their components are worked out by one task, above it by shuffles.
    few: int = 4_000_000
    seed: int = 20240229

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


class _Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: bytes, size: int, words: dict) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text."""
    ws = text.lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws))
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(len(h), size), np.uint64)
    for k in range(min(size, len(h))):
        out = out * GOLDEN + h[k:k + n]
    return np.unique(mix64(out))


def signature(shingle_set: np.ndarray, params: Params) -> bytes:
    rng = np.random.default_rng(params.seed)
    flip = rng.integers(0, 2**32, params.hashes, np.uint32)
    factor = rng.integers(0, 2**31, params.hashes, np.uint32) * np.uint32(2) + np.uint32(1)
    return _signature(shingle_set, flip, factor)


def _signature(shingle_set: np.ndarray, flip: np.ndarray, factor: np.ndarray) -> bytes:
    x = (mix64(shingle_set) >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(flip), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        part = x[i:i + 1024, None] ^ flip
        part *= factor
        np.minimum(low, part.min(axis=0), out=low)
    return low.astype("<u4").tobytes()


def _node(shingle_set: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(shingle_set.tobytes()) - 2**63


def _sketch(df: DataFrame, params: Params, text: str, id_column: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sent = _Words(), set()
        rng = np.random.default_rng(params.seed)
        flip = rng.integers(0, 2**32, params.hashes, np.uint32)
        factor = rng.integers(0, 2**31, params.hashes, np.uint32) * np.uint32(2) + np.uint32(1)
        for b in batches:
            for piece in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                nodes, sizes, signatures = [], [], []
                for t in piece.column(1).cast(pa.large_binary()).to_pylist():
                    s = shingles(t or b"", params.shingle, words)
                    node = _node(s) if len(s) else None
                    if node is None or node in sent:
                        signatures.append(None)
                    else:
                        sent.add(node)
                        signatures.append(_signature(s, flip, factor))
                    nodes.append(node)
                    sizes.append(len(s))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary())], names=["doc_id", "node", "n_shingles", "signature"])
        release()

    return df.select(df[id_column].cast("bigint").alias("doc_id"), df[text].cast("string").alias("text")).mapInArrow(work, "doc_id bigint, node bigint, n_shingles bigint, signature binary")


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest matches in n hashes at which the posterior of reaching the threshold is at least ``miss``.

    With a uniform prior, P(similarity >= t | m of n match) is P(Binomial(n + 1, t) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def _bayes(pairs: DataFrame, signatures: DataFrame, params: Params) -> DataFrame:
    """The pairs (a, b) that survive, with their number of matching hashes."""
    a, b = signatures.toDF("a", "sa"), signatures.toDF("b", "sb")
    bounds = [(n, least_matches(n, params.percent / 100, params.miss)) for n in range(params.batch, params.hashes + 1, params.batch)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                left, right = (np.frombuffer(b"".join(piece.column(k).to_pylist()), "<u4").reshape(-1, params.hashes) for k in (2, 3))
                alive, matches, done = np.arange(piece.num_rows), np.zeros(piece.num_rows, np.int64), 0
                for n, least in bounds:
                    matches[alive] += (left[alive, done:n] == right[alive, done:n]).sum(1)
                    alive, done = alive[matches[alive] >= least], n
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(alive)), piece.column(1).take(pa.array(alive)), pa.array(matches[alive])], names=["a", "b", "matches"])
        release()

    joined = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(work, "a bigint, b bigint, matches bigint")


def _fine(texts: DataFrame, params: Params) -> DataFrame:
    """(node, fine): four bytes of each band, then one byte of each of ``fine`` further hashes."""
    def lanes(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(seed)
        flip = rng.integers(0, 2**32, n, np.uint32)
        return flip, rng.integers(0, 2**31, n, np.uint32) * np.uint32(2) + np.uint32(1)

    def sketch(s: np.ndarray, first: tuple, further: tuple) -> bytes:
        own = np.frombuffer(_signature(s, *first), "<u4").reshape(params.bands, params.rows)
        more = np.frombuffer(_signature(s, *further), "<u4")
        bands = b"".join(xxhash.xxh32_digest(b.tobytes()) for b in own)
        return bands + (more * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, first, further = _Words(), lanes(params.seed, params.hashes), lanes(params.seed + 1, params.fine)
        for batch in batches:
            for piece in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                made = [sketch(shingles(t, params.shingle, words), first, further) for t in piece.column(1).cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(made, pa.binary())], names=["node", "fine"])
        release()

    return texts.select("node", "text").mapInArrow(work, "node bigint, fine binary")


def _crossing(unsettled: DataFrame, fine: DataFrame, params: Params) -> DataFrame:
    """The pairs (a < b) of a bucket in different components that survive batches of the fine sketch, once each.

    A bucket is dealt into blocks of about ``block`` nodes, and a task gets the nodes of two blocks, never a whole bucket.
    Pairs are compared in memory, each in the bucket of the first band that its nodes share, and only survivors become
    rows. At the threshold two bytes agree at least as often as the sets' hashes do, so the bounds hold."""
    blocks = F.ceil(F.col("n") / params.block).cast("int")
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    rows = unsettled.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "band", "own", "node", "label").join(fine, "node")
    sizes = [n for n in (32, 64, 128, 256, 512, 1024) if n < params.fine] + [params.fine]
    bounds = [(n, least_matches(n, params.percent / 100, params.miss)) for n in sizes]

    def compare(band: int, i: int, j: int, own: np.ndarray, node: np.ndarray, label: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bands, sketch = raw[:, : 4 * params.bands].copy().view("<u4"), raw[:, 4 * params.bands:]
        left, right, first, second = np.flatnonzero(own == i), np.flatnonzero(own == j), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(left), 64):  # 64 * block * batch bytes at a time
            part = left[at:at + 64]
            x, y = np.nonzero(label[part][:, None] != label[right][None, :])
            x, y, done, matches = part[x], right[y], 0, None
            new = ~(bands[x, :band] == bands[y, :band]).any(1) & ((i != j) | (x < y))
            x, y = x[new], y[new]
            for n, least in bounds:
                more = (sketch[x, done:n] == sketch[y, done:n]).sum(1)
                matches = more if matches is None else matches + more
                alive = matches >= least
                x, y, matches, done = x[alive], y[alive], matches[alive], n
            first.append(node[x])
            second.append(node[y])
        a, b = np.concatenate(first), np.concatenate(second)
        return np.minimum(a, b), np.maximum(a, b)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            own, node, label, sketch = zip(*held)
            a, b = compare(current[3], current[1], current[2], np.array(own), np.array(node), np.array(label), np.frombuffer(b"".join(sketch), np.uint8).reshape(len(held), -1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        current = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:4] != current:
                    if len(held) > 1:
                        yield flush()
                    held, current = [], row[:4]
                held.append(row[4:])
        if len(held) > 1:
            yield flush()
        release()

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own", "node")
    return dealt.select("key", "i", "j", "band", "own", "node", "label", "fine").mapInArrow(work, "a bigint, b bigint").distinct()


def _exact(pairs: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, own = _Words(), None, None
        for batch in batches:
            for piece in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                a, b, ta, tb = (c.to_pylist() for c in (piece.column(0), piece.column(1), piece.column(2).cast(pa.large_binary()), piece.column(3).cast(pa.large_binary())))
                good = []
                for i in range(len(a)):
                    if a[i] != last:
                        last, own = a[i], shingles(ta[i], params.shingle, words)
                    other = shingles(tb[i], params.shingle, words)
                    shared = len(np.intersect1d(own, other, assume_unique=True))
                    good.append(100 * shared >= params.percent * (len(own) + len(other) - shared))
                yield pa.RecordBatch.from_arrays([piece.column(0).filter(pa.array(good)), piece.column(1).filter(pa.array(good))], names=["a", "b"])
        release()

    a, b = texts.toDF("a", "ta"), texts.toDF("b", "tb")
    joined = pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "ta", "tb")
    return joined.mapInArrow(work, "a bigint, b bigint")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components; a node without a label is its own."""
    la, lb = labels.toDF("a", "la"), labels.toDF("b", "lb")
    return pairs.join(la, "a", "left").join(lb, "b", "left").where("coalesce(la, a) <> coalesce(lb, b)").select(*pairs.columns)


def find_groups(df: DataFrame, params: Params = Params(), text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    spark = df.sparkSession
    tables = Tables(spark, "neardup")
    sketch = tables.put(_sketch(df, params, text, id_column))
    keys = F.transform(F.sequence(F.lit(0), F.lit(params.bands - 1)), lambda j: F.xxhash64(F.expr("signature").substr(j * (4 * params.rows) + 1, F.lit(4 * params.rows)), j))
    member = sketch.where("signature is not null").select("node", F.posexplode(keys).alias("band", "key"))
    full = member.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
    shared = tables.put(member.join(full, "key").select("key", "band", "node", "n").distinct())
    weight = shared.groupBy("node").agg(F.sum("n").alias("w"))
    hubs = shared.join(weight, "node").groupBy("key").agg(F.min(F.struct((-F.col("w")).alias("w"), "node")).alias("h")).select("key", F.col("h.node").alias("hub"))
    members = tables.put(shared.join(hubs, "key").drop("n"))
    tables.drop(shared)
    pairs = members.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    candidates = members.select("node").distinct()
    signatures = tables.put(sketch.where("signature is not null").join(candidates.hint("shuffle_hash"), "node", "left_semi").select("node", "signature").dropDuplicates(["node"]))
    likely = tables.put(_bayes(pairs, signatures, params))
    tables.drop(signatures)

    # texts of the nodes in question: one copy each, found by its doc_id and named again from the text itself
    chosen = sketch.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(candidates, "node")
    wanted = chosen.select(F.col("doc_id").alias("_wanted")).distinct()
    raw = df.select(df[id_column].cast("bigint").alias("_id"), df[text].cast("string").alias("_text")).join(wanted.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_wanted")), "left_semi")
    texts = tables.put(_named(raw, params).dropDuplicates(["node"]))

    first = likely.groupBy("b").agg(F.max_by("a", F.struct("matches", -F.col("a"))).alias("a")).select("a", "b")
    links = tables.put(_exact(first, texts, params))
    labels = components(links, tables, params.few)
    more = tables.put(_exact(_across(likely, labels), texts, params))
    labels = joined_components(labels, more, tables, params.few)

    # buckets of three or more nodes in several components
    several = members.join(labels, "node", "left").select("key", "band", "node", F.coalesce("label", "node").alias("label"))
    open_keys = several.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("n > 2 and lo <> hi").select("key", "n")
    unsettled = tables.put(several.join(open_keys, "key"))
    if unsettled.rows:
        fine = tables.put(_fine(texts.join(unsettled.select("node").distinct(), "node", "left_semi"), params))
        crossing = tables.put(_crossing(unsettled, fine, params).join(likely.select("a", "b"), ["a", "b"], "left_anti"))
        labels = joined_components(labels, tables.put(_exact(crossing, texts, params)), tables, params.few)
        tables.drop(fine, crossing)
    tables.drop(members, unsettled, texts)

    ids = sketch.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_id"))
    named = ids.join(labels, "node", "left").select("node", "least_id", F.coalesce("label", "node").alias("label"))
    lowest = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = named.join(lowest, "label").select(F.col("node").alias("_node"), "component_id")
    out = sketch.select("doc_id", "n_shingles", "node").join(named, F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _named(raw: DataFrame, params: Params) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for piece in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                nodes = []
                for t in piece.column(0).cast(pa.large_binary()).to_pylist():
                    s = shingles(t or b"", params.shingle, words)
                    nodes.append(_node(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), piece.column(0).cast(pa.string())], names=["node", "text"])
        release()

    return raw.select("_text").mapInArrow(work, "node bigint, text string").where("node is not null")


def keep_one(df: DataFrame, params: Params = Params(), text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The documents without those that a smaller doc_id of their group stands for; all columns stay."""
    dropped = find_groups(df, params, text, id_column).where("not kept").select(F.col("doc_id").alias("_dropped"), F.lit(True).alias("_gone")).distinct()
    names = df.columns
    inner = df.select(F.struct(*[df[c] for c in names]).alias("_row"), df[id_column].cast("bigint").alias("_id"))
    kept = inner.join(dropped.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_dropped")), "left_anti")
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in names])


#: The contract of the query: two words to a shingle.
QUERY = Params(shingle=2)


def op7_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY)


#: Pairs of distinct sets through shared shingles, then the closure by repeated smallest labels.
OP7_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS sh
  FROM t
), g AS (
  SELECT list_sort(sh) AS k, min(doc_id) AS rep, len(any_value(sh)) AS n FROM s WHERE len(sh) > 0 GROUP BY 1
), e AS (
  SELECT rep, n, unnest(k) AS x FROM g
), rare AS (
  SELECT rep, n, x, row_number() OVER (PARTITION BY rep ORDER BY f, x) AS pos
  FROM e JOIN (SELECT x AS y, count(*) AS f FROM e GROUP BY 1) c ON c.y = e.x
), pre AS (
  SELECT rep, n, x FROM rare WHERE pos <= n - ceil(0.8 * n) + 1
), cand AS (
  SELECT DISTINCT p.rep AS a, q.rep AS b FROM pre p JOIN pre q ON p.x = q.x AND p.rep < q.rep
  WHERE 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n)
), links AS (
  SELECT a, b FROM cand JOIN g ga ON ga.rep = a JOIN g gb ON gb.rep = b
  WHERE 100 * len(list_intersect(ga.k, gb.k)) >= 80 * (ga.n + gb.n - len(list_intersect(ga.k, gb.k)))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT rep AS a, rep AS b FROM g
  UNION
  SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b
), comp AS (
  SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY 1
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id,
  s.doc_id = coalesce(c.component_id, s.doc_id) AS kept
FROM s LEFT JOIN g ON len(s.sh) > 0 AND g.k = list_sort(s.sh) LEFT JOIN comp c ON c.rep = g.rep
"""

QUERIES = {"op7_minhash_bayes": op7_minhash_bayes}
SQL = {"op7_minhash_bayes": OP7_SQL}
