"""Substring dedup (6): compact windows of token min-hashes find near-duplicate passages across documents.

Tokens are shingles of ``shingle`` words (A-Z lower-cased; a word is a run of anything but ASCII white space). For a hash
function, the Cartesian tree of a text's token hashes has a node c for every maximal range [l, r] whose least hash is at
c: all passages [i, j] with l <= i <= c <= j <= r share that signature, so the range stands for all of them. Only ranges
of at least t tokens (``words`` words) are kept, about 2 n / t of n. Their nodes are the minima of sliding windows of t
tokens; a passage of t tokens is told by the first and last start that its node is the least of.

Between the steps rows are dealt as arrays: all that a task has for a bucket is one row, a column of bytes for each kind, so that Spark
shuffles few rows: tasks times buckets, whatever the size of a group (or as many as the integers need).

1. An Arrow pass emits (signature value, text, range) for ``hashes`` functions. Values of a single text go. A value that a
   piece of the input holds in three texts is known to be shared: its further rows go anywhere.
2. Per text, the ranges of every two functions are joined as intervals: where both hold a passage of t tokens, a cell
   (both values, the starts of these passages) arises. Two passages share a cell key if two functions agree on them.
3. Cells of a key with the same tokens around them are a class. Its members repeat the member of smallest hash, word by
   word; the class goes by that member. Of ``few`` classes of a key all pairs are verified.
4. Of more classes the tokens around the shared one are read, and the passages that hold it are compared in memory, a large key
   in blocks: only classes that near passages of this key join already are not compared with one another. Pairs that cannot
   share as many tokens as the threshold needs are told by their rarer tokens, so a frequent line alone makes no pairs.
   What goes on are the pairs that join, fewer than classes (times blocks).
5. Pairs of texts are verified on the tokens that passages around their anchors can read; every text is tokenised once for
   all its pairs. Along the aligned diagonals every passage of t tokens is compared, and those whose Jaccard similarity
   (tokens of the one that have a partner in the other) reaches ``similarity`` are joined into spans.
6. Overlapping passages of a text are one stretch; stretches that found passages link have one class_id.

Two passages of t tokens at the threshold agree on a function with probability 0.8, so on two or more of four with
0.973 (0.996 at similarity 0.9, 1 for copies); longer passages have more chances, as they hold more ranges. Two near passages
that agree so are linked or are joined through others, so they have one class_id. A token's partner is the nearest one, in
step 4 among the tokens around the shared one and in step 5 in the text, so in runs of repeated words the two can differ.

Defined results: a text of fewer than ``words`` words, null and empty ones included, has no passage; exact copies of
such length repeat the copy of smallest doc_id over their whole length (class_id: the text's hash), and any other passage is reported for every copy;
an original is the text of smaller hash, named by its smallest doc_id; ties go to the smaller position;
null doc_ids are reported as null; an empty table has no rows. Texts are told apart by a hash of 64 bits.
"""

from __future__ import annotations

import gc
import itertools
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import GOLDEN, Tables, components, mix64, release, table

WIDE = (1 << 14) - 1
SPANS = "a bigint, b bigint, start bigint, n_words bigint, of_start bigint, similarity double"


@dataclass(frozen=True)
class Params:
    words: int = 50
    shingle: int = 5
    similarity: float = 0.8
    hashes: int = 4
    words_at_once: int = 400_000
    block: int = 8192
    few: int = 4
    seed: int = 97

    @property
    def t(self) -> int:
        return self.words - self.shingle + 1


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n or more powers of an odd number and of its inverse; kept, as they are the same for every piece."""
    if len(_POWERS["up"]) < n:
        for name, base in (("up", int(GOLDEN)), ("down", pow(int(GOLDEN), -1, 1 << 64))):
            held = np.full(n, base, np.uint64)
            held[0] = 1
            _POWERS[name] = np.cumprod(held)
    return _POWERS["up"], _POWERS["down"]


def _word_hashes(chars: np.ndarray, start: np.ndarray, end: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
    """A hash of each word chars[start:end], from sums of bytes times powers; worked out in blocks of whole words."""
    out, k = np.empty(len(start), np.uint64), 0
    while k < len(start):
        lo = int(start[k])
        stop = max(k + 1, int(np.searchsorted(end, lo + at_once, "right")))
        part = chars[lo:int(end[stop - 1])]
        up, down = _powers(max(len(part), 1 << 12))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:len(part)], out=total[1:])
        x, y = start[k:stop] - lo, end[k:stop] - lo
        out[k:stop] = mix64((total[y] - total[x]) * down[x])
        k = stop
    return out


def tokens_of(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of ``size`` words of each text, in order and on end, and how many each text has."""
    whole = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    space = _SPACES[whole]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[::2], edge[1::2]
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    h, doc = _word_hashes(whole, start, end), np.searchsorted(ends_of, start, "right")
    n = len(h) - size + 1
    if n < 1:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * GOLDEN + h[k:k + n]
    whole_runs = doc[:n] == doc[size - 1:]
    return mix64(out[whole_runs]), np.bincount(doc[:n][whole_runs], minlength=len(texts))


def tokens(text: bytes, size: int) -> np.ndarray:
    """The hashes of all runs of ``size`` words, in order."""
    return tokens_of([text], size)[0]


def passages(tok: np.ndarray, doc: np.ndarray, t: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token with its place, c, first, last, value of c): the tokens that are the least of a passage of t tokens under one hash
    function, and the first and last start of the passages each is the least of.

    tok: the tokens of several texts on end; doc: the index of each token's text, ascending. Of equal hashes the first
    counts as the least.
    """
    n, empty = len(tok), np.empty(0, np.int64)
    if n < t:
        return np.empty(0, np.uint64), empty, empty, empty, np.empty(0, np.uint64)
    value = mix64(tok ^ mix64(np.array([seed], np.uint64))[0])
    packed = (value & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    low, width = packed, 1
    while 2 * width <= t:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < t:
        low = np.minimum(low[: len(low) - (t - width)], low[t - width:])
    start = np.flatnonzero(doc[: n - t + 1] == doc[t - 1:])
    if not len(start):
        return np.empty(0, np.uint64), empty, empty, empty, np.empty(0, np.uint64)
    where = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    c = where[new]
    return packed, c, start[new], start[np.append(new[1:], len(start)) - 1], value[c]


def compact_windows(tok: np.ndarray, doc: np.ndarray, t: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(value, c, l, r) of all compact windows of at least t tokens under one hash function."""
    packed, c, first, last, value = passages(tok, doc, t, seed)
    if not len(c):
        return value, c, c, c
    begins = np.searchsorted(doc, doc[c], "left")
    ends = np.searchsorted(doc, doc[c], "right") - 1
    # the nearest smaller token at a distance of t or more is a node too; a nearer one ends the run of windows
    key, at, of = packed[c].tolist(), c.tolist(), doc[c].tolist()
    left, right, stack = begins.tolist(), ends.tolist(), []
    for q in range(len(at)):
        while stack and (of[stack[-1]] != of[q] or key[stack[-1]] > key[q]):
            top = stack.pop()
            if of[top] == of[q]:
                right[top] = at[q] - 1
        if stack:
            left[q] = at[stack[-1]] + 1
        stack.append(q)
    l = np.where(first > c - t + 1, first, np.array(left))  # noqa: E741
    r = np.where(last < c, last + t - 1, np.array(right))
    return value, c, l, r


def _pack(c: np.ndarray, first: np.ndarray, last: np.ndarray, j: np.ndarray | int = 0) -> np.ndarray:
    """A shared token, the first and last start of the passages of t tokens around it (up to WIDE before it), and the
    hash function, in 63 bits."""
    return (c << 32) | (np.minimum(c - first, WIDE) << 18) | (np.minimum(c - last, WIDE) << 4) | j


def _unpack(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    c = span >> 32
    return c, c - (span >> 18 & WIDE), c - (span >> 4 & WIDE), span & 15


def _piece(texts: list[tuple[int, bytes]], params: Params) -> list[pa.Array]:
    """Columns value, text, span, around, sure of the ranges of some texts. around: a hash of all tokens of the passages that the
    span stands for; sure: two other texts before it hold the value."""
    tok, sizes = tokens_of([x for _, x in texts], params.shingle)
    long = sizes >= params.t
    if not long.any():
        return [pa.array([], pa.int64()) for _ in range(4)] + [pa.array([], pa.bool_())]
    tok, names, sizes = tok[np.repeat(long, sizes)], np.array([k for k, _ in texts], np.int64)[long], sizes[long]
    doc, before = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([[0], np.cumsum(sizes)])[:-1]
    # sums of tokens times powers of an odd number; divided by the power at its first token, a difference names a run
    power, back = _powers(len(tok))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tok * power[:len(tok)])])
    parts = []
    for j in range(params.hashes):
        _, c, first, last, value = passages(tok, doc, params.t, params.seed + j)
        base = before[doc[c]]
        run = (total[last + params.t] - total[first]) * back[first]
        around = mix64(run ^ mix64(((c - first) << 32 | (last - first)).astype(np.uint64)))
        parts.append((value.view(np.int64), names[doc[c]], _pack(c - base, first - base, last - base, j), around.view(np.int64)))
    value, text, span, around = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((text, value))
    new_value = np.concatenate([[True], value[order][1:] != value[order][:-1]])
    nth = np.cumsum(new_value | np.concatenate([[True], text[order][1:] != text[order][:-1]]))
    sure = np.empty(len(value), bool)
    sure[order] = nth - nth[np.maximum.accumulate(np.where(new_value, np.arange(len(nth)), 0))] >= 2
    return [pa.array(x) for x in (value, text, span, around, sure)]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


CELL, REPEAT, ASKED, SIDE, PAIR, PART, PLACES, TOKENS, TEXT = KINDS = ("cell", "repeat", "asked", "side", "pair", "part", "places", "tokens", "text")
BLOBS = ", ".join(["bucket bigint", "name bigint", *(f"{k} binary" for k in KINDS)])
_FIELDS = pa.schema([(n, pa.int64()) for n in ("bucket", "name")] + [(k, pa.binary()) for k in KINDS])


def _mixed(*columns: np.ndarray) -> np.ndarray:
    """A hash of each row of some integer columns."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = mix64(out * GOLDEN + c.view(np.uint64))
    return out.view(np.int64)


def _rows(columns: list[np.ndarray]) -> np.ndarray:
    return np.stack([c.astype(np.int64, copy=False) for c in columns], 1)


Dealt = tuple[str, np.ndarray, np.ndarray]


def _buckets(spark: SparkSession) -> int:
    """As many for each partition."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return parts * -(-128 // parts)


def _blobs(made: Iterator[Dealt | pa.RecordBatch], buckets: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Of (kind, by, rows of integers): those of a bucket (``by`` modulo ``buckets``) as one row of bytes, all kinds in it, so that a
    shuffle moves arrays; with rows of differing length (PART) their places and tokens follow. A task gathers about ``most`` integers
    first, whatever it was given at once, so there are no more of these rows than tasks times buckets, or than so many integers need."""
    held, size = {}, 0

    def flush() -> Iterator[pa.RecordBatch]:
        made_of = {}
        for kind, several in held.items():
            by, rows, *more = (np.concatenate(c) for c in zip(*several))
            where = np.mod(by, buckets)
            order = np.argsort(where, kind="stable")
            where, rows = where[order], np.ascontiguousarray(rows[order])
            at = np.append(np.flatnonzero(_starts(where)), len(where))
            columns = [[rows[i:j].tobytes() for i, j in zip(at.tolist(), at[1:].tolist())]]
            if more:
                n = rows[:, -1]
                ends = np.concatenate([[0], np.cumsum(n)])
                was = np.empty(len(n), np.int64)
                was[order] = n
                first = (np.cumsum(was) - was)[order]
                pick = np.repeat(first - ends[:-1], n) + np.arange(ends[-1])
                cut = ends[at].tolist()
                columns += [[c[i:j].tobytes() for i, j in zip(cut, cut[1:])] for c in (m[pick] for m in more)]
            made_of |= {k: dict(zip(where[at[:-1]].tolist(), c)) for k, c in zip((kind, PLACES, TOKENS), columns)}
        some = sorted(set().union(*made_of.values()))
        if some:
            blobs = [pa.array([made_of[k].get(b) for b in some], pa.binary()) if k in made_of else pa.nulls(len(some), pa.binary()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.nulls(len(some), pa.int64()), *blobs], schema=_FIELDS)

    for x in made:
        if isinstance(x, pa.RecordBatch):
            yield x
        elif len(x[1]):
            held.setdefault(x[0], []).append(x[1:])
            size += sum(c.size for c in x[1:])
            if size > most:
                yield from flush()
                held.clear()
                size = 0
    yield from flush()
    release()


def _gathered(blobs: DataFrame, work, schema: str = BLOBS) -> DataFrame:
    """The result of ``work`` on blobs, those of a bucket one after another."""
    spark = blobs.sparkSession
    parts, buckets = int(spark.conf.get("spark.sql.shuffle.partitions")), _buckets(spark)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _blobs(work(batches), buckets)

    return blobs.repartitionById(parts, F.col("bucket").cast("int")).sortWithinPartitions("bucket").mapInArrow(whole, schema)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """For every bucket its blobs."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        bucket = b.column(0).to_numpy()
        at = np.append(np.flatnonzero(_starts(bucket)), b.num_rows)
        for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
            if last is not None and bucket[i] != last:
                yield held
                held = []
            last = bucket[i]
            held.append(b.slice(i, j - i))
    if held:
        yield held


def _bytes(held: list[pa.RecordBatch], kind: str) -> bytes:
    return b"".join(x.as_buffer() for b in held for x in b.column(kind).drop_null())


def _matrix(held: list[pa.RecordBatch], kind: str, width: int) -> np.ndarray:
    return np.frombuffer(_bytes(held, kind), np.int64).reshape(-1, width)


def _only(blobs: DataFrame, kind: str) -> DataFrame:
    """The blobs of one kind."""
    return blobs.where(F.col(kind).isNotNull()).select("bucket", "name", *[F.col(k) if k == kind else F.lit(None).cast("binary").alias(k) for k in KINDS])


def _ranges(df: DataFrame, params: Params) -> DataFrame:
    """df: (key, text). Rows value, text, span, around, sure, dealt by value; what is known to be shared goes anywhere, so
    that no task gets all rows of a hot value."""
    buckets = _buckets(df.sparkSession)

    def dealt(piece: list[tuple[int, bytes]]) -> Dealt:
        value, text, span, around, sure = (c.to_numpy(zero_copy_only=False) for c in _piece(piece, params))
        return CELL, np.where(sure, _mixed(text, span), value), _rows([value, text, span, around, sure])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[Dealt]:
        seen = set()
        for b in batches:
            piece, size = [], 0
            for p in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                for k, t in zip(p.column(0).to_pylist(), p.column(1).cast(pa.large_binary()).to_pylist()):
                    if k in seen:
                        continue
                    seen.add(k)
                    piece.append((k, t))
                    size += len(t) // 6 + 1
                    if size >= params.words_at_once:
                        yield dealt(piece)
                        piece, size = [], 0
            if piece:
                yield dealt(piece)

    return df.mapInArrow(lambda batches: _blobs(work(batches), buckets), BLOBS)


def _shared(ranges: DataFrame, params: Params) -> DataFrame:
    """(text, span, value, around) of the values that two texts or more hold, dealt by text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[Dealt]:
        for held in _by_bucket(batches):
            rows = _matrix(held, CELL, 5)
            order = np.argsort(rows[:, 0])
            value, text, sure = rows[order, 0], rows[order, 1], rows[order, 4]
            at = np.flatnonzero(_starts(value))
            several = (np.maximum.reduceat(text, at) != np.minimum.reduceat(text, at)) | (np.maximum.reduceat(sure, at) > 0)
            rows = rows[order[np.repeat(several, np.diff(np.append(at, len(value))))]]
            if len(rows):
                yield CELL, rows[:, 1], rows[:, [1, 2, 0, 3]]

    return _gathered(ranges, work)


def cells(text: np.ndarray, span: np.ndarray, value: np.ndarray, around: np.ndarray, hashes: int) -> list[np.ndarray]:
    """Columns key, class, text, span: where ranges of two functions hold a passage of t tokens in common. The rows given
    are sorted by text and span; of one function the passages of a text's ranges are disjoint and ascend."""
    c, first, last, j = _unpack(span)
    base = (np.cumsum(_starts(text)) - 1) << 32
    rows = [np.flatnonzero(j == k) for k in range(hashes)]
    parts = [[np.empty(0, np.int64)] * 4]
    for k in range(hashes):
        for m in range(k + 1, hashes):
            x, y = rows[k], rows[m]
            lo = np.searchsorted(base[y] + last[y], base[x] + first[x], "left")
            n = np.maximum(0, np.searchsorted(base[y] + first[y], base[x] + last[x], "right") - lo)
            x, y = np.repeat(x, n), y[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            key = mix64(mix64(value[x].view(np.uint64) + np.uint64(16 * k + m)) * GOLDEN + value[y].view(np.uint64))
            kind = mix64(around[x].view(np.uint64) * GOLDEN + around[y].view(np.uint64) + mix64((c[y] - c[x]).view(np.uint64)))
            parts.append([key.view(np.int64), kind.view(np.int64), text[x], _pack(c[x], np.maximum(first[x], first[y]), np.minimum(last[x], last[y]))])
    return [np.concatenate(p) for p in zip(*parts)]


def _cells(shared: DataFrame, params: Params) -> DataFrame:
    """Rows key, class, text, span, dealt by key."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[Dealt]:
        for held in _by_bucket(batches):
            rows = _matrix(held, CELL, 4)
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            rows = rows[_starts(rows[:, 0], rows[:, 1])]  # once, however many tasks met a copy
            made = _rows(cells(*rows.T, params.hashes))
            if len(made):
                yield CELL, made[:, 0], made

    return _gathered(shared, work)


def _groups(made: DataFrame, params: Params) -> DataFrame:
    """Of the cells of each key held by several texts: what members of a class repeat of its first one (REPEAT: a, b, first and
    last start, shift), the pairs of a key of ``few`` classes at most (SIDE), and the classes of all
    other keys, whose surroundings are to be read (ASKED: text, key, span, number of classes).

    A class goes by its first member. Where two classes of a key have the same text as first, each goes by its next text too, so
    that all texts of the one can meet all of the other."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[Dealt]:
        for held in _by_bucket(batches):
            rows = _matrix(held, CELL, 4)
            rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
            at = np.flatnonzero(_starts(rows[:, 0]))
            several = np.maximum.reduceat(rows[:, 2], at) != np.minimum.reduceat(rows[:, 2], at)
            rows = rows[np.repeat(several, np.diff(np.append(at, len(rows))))]
            if not len(rows):
                continue
            key, kind, text, span = rows.T
            at = np.flatnonzero(_starts(key, kind))
            size = np.diff(np.append(at, len(rows)))
            first = np.repeat(at, size)
            other = np.flatnonzero(text != text[first])
            if len(other):
                c, lo, hi, _ = _unpack(span[other])
                out = _rows([text[other], text[first[other]], lo, hi, c - (span[first[other]] >> 32)])
                yield REPEAT, _mixed(out[:, 0], out[:, 1]), out
            k_at = np.flatnonzero(_starts(key[at]))
            n = np.diff(np.append(k_at, len(at)))
            same = np.zeros(len(at), bool)  # the first text of another class of the key, too
            by_text = np.lexsort((text[at], key[at]))
            twin = ~_starts(key[at][by_text], text[at][by_text])
            same[by_text] = twin | np.append(twin[1:], False)
            few = (n <= params.few) & ~np.maximum.reduceat(same, k_at)
            for k in range(2, params.few + 1):
                lead = k_at[few & (n == k)]
                x, y = (np.concatenate([at[lead + i] for i in c] or [lead]) for c in zip(*itertools.combinations(range(k), 2)))
                if len(x):
                    yield from _paired(text, span, x, y)
            wanted = np.repeat(~few & (n > 1), n)
            nxt = np.full(len(at), -1)
            nxt[np.searchsorted(at, first[other[::-1]])] = other[::-1]
            alt = wanted & same & (nxt >= 0)
            i, cls = np.concatenate([at[wanted], nxt[alt]]), np.concatenate([np.flatnonzero(wanted), np.flatnonzero(alt)])
            if len(i):
                yield ASKED, text[i], _rows([text[i], key[i], span[i], np.repeat(n, n)[cls]])

    return _gathered(made, work)


def _paired(text: np.ndarray, span: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[Dealt]:
    """What the check of pairs of rows asks of their two texts (SIDE: text, the other, side, place of the shared token in each); side 0 is
    the text of greater hash."""
    a, b = np.where(text[x] > text[y], x, y), np.where(text[x] > text[y], y, x)
    for side, (me, other) in enumerate(((a, b), (b, a))):
        yield SIDE, text[me], _rows([text[me], text[other], np.full(len(me), side), span[me] >> 32, span[other] >> 32])


def _with_texts(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """Blobs dealt by text, and the texts (key, text) themselves, of copies one from each task."""
    b = _buckets(texts.sparkSession)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            new = []
            for i, k in enumerate(batch.column(1).to_pylist()):
                if k not in seen:
                    seen.add(k)
                    new.append(i)
            yield batch if len(new) == batch.num_rows else batch.take(pa.array(new, pa.int64()))

    as_blobs = texts.select(F.pmod("key", F.lit(b).cast("bigint")).alias("bucket"), F.col("key").alias("name"), F.col("text").cast("binary").alias("text"))
    return asked.unionByName(as_blobs.mapInArrow(once, "bucket bigint, name bigint, text binary"), allowMissingColumns=True)


def _read(held: list[pa.RecordBatch], kind: str, width: int, params: Params) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The rows asked of the texts of a bucket, sorted, each once, in pieces of some texts: rows, the index of each row's text, the tokens of these texts
    on end, where each begins and how many it has."""
    asked = _matrix(held, kind, width)
    asked = asked[np.lexsort(asked.T[::-1])]
    asked = asked[_starts(*asked.T)]
    left, piece, size = set(np.unique(asked[:, 0]).tolist()), [], 0

    def taken() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        piece.sort(key=lambda p: p[0])
        names = np.array([k for k, _ in piece], np.int64)
        tok, sizes = tokens_of([t for _, t in piece], params.shingle)
        of = np.minimum(np.searchsorted(names, asked[:, 0]), len(names) - 1)
        mine = names[of] == asked[:, 0]
        return asked[mine], of[mine], tok, np.cumsum(sizes) - sizes, sizes

    for b in held if left else []:
        for i, k in enumerate(b.column("name").to_pylist()):
            if k in left:
                left.remove(k)
                piece.append((k, b.column(TEXT)[i].as_py()))
                size += len(piece[-1][1]) // 6 + 1
                if size >= params.words_at_once:
                    yield taken()
                    piece, size = [], 0
    if piece:
        yield taken()


def _near(asked: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    """The classes asked for with 32 bits of each token of all passages that hold the shared one, by its place beside it. A key of many
    classes is dealt into blocks of about ``block``; a task gets two blocks of it at a time."""
    t = params.t

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[Dealt]:
        reach = np.arange(1 - t, t + 1)
        for held in _by_bucket(batches):
            for rows, of, tok, base, sizes in _read(held, ASKED, 4, params):
                for k in range(0, len(rows), 5000):
                    text, key, span, n = rows[k:k + 5000].T
                    at = (span >> 32)[:, None] + reach
                    within = (at >= 0) & (at < sizes[of[k:k + 5000], None])
                    place = np.clip(base[of[k:k + 5000], None] + at, 0, len(tok) - 1)
                    near = np.where(within, (tok[place] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), 0).astype("<u4")
                    made = np.concatenate([_rows([key, key, key, text, span]), near.view(np.int64)], 1)
                    blocks = -(-n // params.block)
                    own = np.mod(_mixed(text, key), blocks)
                    i = np.repeat(np.arange(len(made)), blocks)
                    other = np.arange(len(i)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    made = made[i]
                    made[:, 1], made[:, 2] = np.minimum(own[i], other), np.maximum(own[i], other)
                    yield CELL, _mixed(made[:, 0], made[:, 1], made[:, 2]), made

    return _gathered(_with_texts(asked, texts), work)


def _class(tokens_: np.ndarray) -> np.ndarray:
    return tokens_ * np.uint32(0x9E3779B1) >> np.uint32(21)


def _many(held: np.ndarray, t: int, need: int) -> np.ndarray:
    """Whether any ``t`` places of a row in a run hold ``need`` or more."""
    return (_windows(held, t, 0) >= need).any(1)


def _windows(held: np.ndarray, t: int, d: int = 0) -> np.ndarray:
    """For each start, how many of the places ``held`` lie in its ``t`` places together with the place d behind them."""
    total = np.zeros((held.shape[0], held.shape[1] + 1), np.uint8 if held.shape[1] < 256 else np.int32)
    np.cumsum(held, axis=1, out=total[:, 1:], dtype=total.dtype)
    n = held.shape[1] - t + 1
    lo, hi = max(0, -d), min(t, t - d)
    return total[:, hi:hi + n] - total[:, lo:lo + n]


def _many(held: np.ndarray, t: int, need: int) -> np.ndarray:
    """Whether any ``t`` places of a row in a run hold ``need`` or more."""
    out = held.sum(1) >= need
    out[out] = (_windows(held[out], t) >= need).any(1)
    return out


def _whole(a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
    """The starts whose passage lies in both texts."""
    return (a[:, :t] != 0) & (a[:, t - 1:] != 0) & (b[:, :t] != 0) & (b[:, t - 1:] != 0)


def alike(near: np.ndarray, x: np.ndarray, y: np.ndarray, need: int) -> np.ndarray:
    """For pairs of rows of tokens around a shared one (0: none): whether a passage of x that holds it and the one at the same
    place of y hold ``need`` tokens in common."""
    t = (near.shape[1] + 1) // 2
    exact, left = np.zeros(len(x), bool), []
    for k in range(0, len(x), 1000):
        a, b = near[x[k:k + 1000]], near[y[k:k + 1000]]
        same = (a == b) & (a != 0)
        i = np.flatnonzero(_many(same, t, need))
        i = i[((_windows(same[i], t) >= need) & _whole(a[i], b[i], t)).any(1)]
        exact[k + i] = True
        i = np.flatnonzero(~exact[k:k + 1000])
        a, b = a[i], b[i]
        some = np.zeros((len(i), 2048), bool)  # classes of tokens that y holds: a token of x in none of them has no partner
        each = np.arange(len(i))[:, None]
        some[each, b * np.uint32(0x9E3779B1) >> np.uint32(21)] = True
        left.append(k + i[_many(some[each, a * np.uint32(0x9E3779B1) >> np.uint32(21)] & (a != 0), t, need)])
    left = np.concatenate(left) if left else np.empty(0, np.int64)
    distances = sorted(range(1 - t, t), key=lambda d: (abs(d), d))  # the nearest partner first
    for i in (left[k:k + 2000] for k in range(0, len(left), 2000)):
        a, b = near[x[i]], near[y[i]]
        total, free = np.zeros((len(i), t), np.int16), a != 0
        for d in distances:
            lo, hi = max(0, -d), min(2 * t - 1, 2 * t - 1 - d)
            m = a[:, lo:hi] == b[:, lo + d:hi + d]
            m &= free[:, lo:hi]
            r = np.flatnonzero(m.any(1))
            if len(r):
                free[:, lo:hi] &= ~m
                held = np.zeros((len(r), 2 * t - 1), bool)
                held[:, lo:hi] = m[r]
                total[r] += _windows(held, t, d)
        exact[i] = ((total >= need) & _whole(a, b, t)).any(1)
    return exact


def meet(group: np.ndarray, text: np.ndarray, near: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y), text[x] > text[y], of rows of one group that are near each other, fewer than rows: they join all rows of a
    group that any near pairs of it join.

    Rows are sorted by group and text. All meet the first of their group, then the first row that holds one of their rarer
    tokens; two rows that are not joined so far are compared if they share one of these. Of x's tokens, ordered by their number
    of rows, all but need - 1 must hold a shared one, so nothing is lost, and a line that all rows hold leads to no pairs."""
    need = math.ceil(2 * params.t * params.similarity / (1 + params.similarity) - 1e-9)
    m = len(near)
    parent, keep = list(range(m)), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def labels() -> np.ndarray:
        return np.array([root(i) for i in range(m)])

    # a passage of x must hold as many tokens of other rows of its group; counted by hash, so never too few
    size_ = 1 << (8 * near.size).bit_length()
    slot = (near.astype(np.uint64) * GOLDEN + group.astype(np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - size_.bit_length() + 1)
    slot = slot.astype(np.int64)
    times = np.bincount(slot[near != 0], minlength=size_)
    able = _many((near != 0) & (times[slot] > 1), params.t, need)
    if not able.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)

    def compare(x: np.ndarray, y: np.ndarray) -> None:
        x, y = np.where(text[x] > text[y], x, y), np.where(text[x] > text[y], y, x)
        x, y = x[able[x]], y[able[x]]
        exact = alike(near, x, y, need)
        for i, j in zip(x[exact].tolist(), y[exact].tolist()):
            u, v = root(i), root(j)
            if u != v:
                parent[u] = v
                keep.append((i, j))

    at = np.flatnonzero(_starts(group))
    hub = np.repeat(at, np.diff(np.append(at, m)))
    x = np.flatnonzero(text != text[hub])
    compare(x, hub[x])

    label = labels()
    # from here on only tokens count that rows of several labels hold
    seen, mixed = np.empty(size_, np.int64), np.zeros(size_, bool)
    of_token = np.broadcast_to(label[:, None], near.shape)
    seen[slot] = of_token
    mixed[slot[seen[slot] != of_token]] = True
    several = (near != 0) & mixed[slot]
    able &= _many(several, params.t, need)
    several &= np.repeat(np.maximum.reduceat(able, at), np.diff(np.append(at, m)))[:, None]
    row, at = np.nonzero(several)
    if not len(row):
        return tuple(np.array(keep, np.int64).reshape(-1, 2).T)
    code = near[row, at].astype(np.int64) | (group[row] << 32)
    order = np.argsort(code, kind="stable")
    token = np.empty(len(row), np.int64)
    token[order] = np.cumsum(_starts(code[order])) - 1
    entries = token[order] * m + row[order]
    entries = entries[_starts(entries)]
    times = np.bincount(entries // m)
    order = np.argsort((row * (m + 1) + times[token]) * len(times) + token)
    count, sizes = several.sum(1), (near != 0).sum(1)  # row is ascending; the tokens of no other row come first
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + (sizes - count)[row]
    probes = np.unique((token * m + row)[order][(place <= sizes[row] - need) & (times[token[order]] > 1) & able[row]])
    begin = np.searchsorted(entries, np.arange(len(times)) * m)
    end = begin + times

    x, y = probes % m, entries[begin[probes // m]] % m
    code = np.unique((x * m + y)[(text[x] != text[y]) & (label[x] != label[y])])
    compare(code // m, code % m)
    tried = np.unique(code)

    label = labels()
    held = label[entries % m]
    order = np.lexsort((held, entries // m))  # those of a token by label: a row is led to the ones of other labels only
    entries, held = entries[order], held[order]
    block = np.flatnonzero(_starts(entries // m, held))
    ends = np.append(block[1:], len(entries))
    mine = np.searchsorted((entries // m * m + held)[block], probes // m * m + label[probes % m])
    before, behind = block[mine] - begin[probes // m], end[probes // m] - ends[mine]
    some = np.flatnonzero(before + behind)
    some = some[np.argsort(probes[some] % m, kind="stable")]  # the pairs of a row come together
    probes, mine, before, count = probes[some], mine[some], before[some], (before + behind)[some]
    total, i = np.cumsum(count), 0
    while i < len(probes):
        stop = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + 1_000_000)))
        n = count[i:stop]
        of = np.repeat(np.arange(i, stop), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        at = np.where(nth < before[of], begin[probes[of] // m] + nth, ends[mine[of]] + nth - before[of])
        x, y = probes[of] % m, entries[at] % m
        good = (text[x] > text[y]) & (label[x] != label[y])
        code = np.setdiff1d(x[good] * m + y[good], tried)
        while len(code):  # what is joined by some need not be compared
            compare(code[:2000] // m, code[:2000] % m)
            label, code = labels(), code[2000:]
            code = code[label[code // m] != label[code % m]]
        i = stop
    return tuple(np.unique(np.array(keep, np.int64).reshape(-1, 2), axis=0).T)


def _crossing(near: DataFrame, params: Params) -> DataFrame:
    """The pairs (SIDE) of classes of one key that join all that are near each other by what is around their shared token."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[Dealt]:
        for held in _by_bucket(batches):
            rows = _matrix(held, CELL, 5 + params.t)
            rows = rows[np.lexsort((rows[:, 4], rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
            ends = np.append(np.flatnonzero(_starts(*rows[:, :3].T))[1:], len(rows))
            lo = 0
            while lo < len(rows):
                hi = int(ends[min(len(ends) - 1, np.searchsorted(ends, lo + params.block))])
                part = rows[lo:hi]
                around = np.ascontiguousarray(part[:, 5:]).view("<u4")[:, :2 * params.t - 1]
                x, y = meet(np.cumsum(_starts(*part[:, :3].T)) - 1, part[:, 3], around, params)
                if len(x):
                    yield from _paired(part[:, 3], part[:, 4], x, y)
                lo = hi

    return _gathered(near, work)


def covered(run: np.ndarray, at: np.ndarray, before: np.ndarray | int, after: np.ndarray | int, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, place) of all places of a run from ``before`` before to ``after`` behind any of its places ``at``, within bounds
    of the run, once and in order. Rows are sorted by run and place; all other values are those of the run."""
    low, high = np.maximum(at - before, least), np.minimum(at + after, most)
    same = ~_starts(run)
    low[same] = np.maximum(low[same], high[np.flatnonzero(same) - 1] + 1)
    n = np.maximum(high - low + 1, 0)
    return np.repeat(run, n), np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _parts(asked: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    """What the check of a pair reads of its texts (PART: a, b, side, tokens of the text, number given; PLACES: their places;
    TOKENS: the tokens) with its anchors (PAIR: a, b, place in each). Every text is tokenised once for all its pairs."""
    t = params.t

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[Dealt]:
        for held in _by_bucket(batches):
            for rows, of, tok, base, sizes in _read(held, SIDE, 5, params):
                me, other, side, at, their = rows.T
                a, b = np.where(side == 0, me, other), np.where(side == 0, other, me)
                first = side == 0
                yield PAIR, _mixed(a, b)[first], _rows([a, b, at, their])[first]
                order = np.lexsort((at, side, b, a))
                a, b, side, at, of = (c[order] for c in (a, b, side, at, of))
                new = _starts(a, b, side)
                cuts = np.append(np.flatnonzero(new), len(at))
                lo = 0
                while lo < len(cuts) - 1:  # some thousand anchors at a time
                    hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + 5000)) - 1)
                    s = slice(cuts[lo], cuts[hi])
                    reach = np.where(side[s] == 0, t, 2 * t)
                    run, place = covered(np.cumsum(new[s]) - 1, at[s], reach, reach, np.zeros(len(reach), np.int64), sizes[of[s]] - 1)
                    head = np.flatnonzero(new[s]) + cuts[lo]
                    count = np.bincount(run, minlength=len(head))
                    heads = _rows([a[head], b[head], side[head], sizes[of[head]], count])
                    token = tok[base[of[head]][run] + place].astype("<u8")
                    place = place.astype("<i4")
                    yield PART, _mixed(a[head], b[head]), heads, place, token
                    lo = hi

    return _gathered(_with_texts(asked, texts), work)


def spans(heads: np.ndarray, places: np.ndarray, toks: np.ndarray, anchors: np.ndarray, params: Params) -> list[np.ndarray]:
    """Columns a, b, start, words, start in b, best similarity of the passages of a with a near duplicate in b along the anchors,
    those of each distance of the two places by themselves, so that the place in b is right for all of a row.

    heads: rows a, b, side, number of the text's tokens, number given; places and toks: these tokens, in order, those of a (side 0)
    up to t from an anchor, those of b up to 2 t, as a token has its partner less than t from its own place; anchors: rows a, b, place
    in a, place in b."""
    t, wide = params.t, 1 << 32
    need = math.ceil(2 * t * params.similarity / (1 + params.similarity) - 1e-9)
    nothing = [np.empty(0, np.int64)] * 5 + [np.empty(0)]
    names, pair = np.unique(_mixed(heads[:, 0], heads[:, 1]), return_inverse=True)
    side, of = heads[:, 2], np.repeat(pair, heads[:, 4])
    in_a = np.repeat(side == 0, heads[:, 4])
    a_of, b_of, lengths = np.empty(len(names), np.int64), np.empty(len(names), np.int64), np.zeros((2, len(names)), np.int64)
    a_of[pair], b_of[pair], lengths[side, pair] = heads[:, 0], heads[:, 1], heads[:, 3]
    places = places.astype(np.int64)
    mark = mix64(toks ^ mix64(of.astype(np.uint64) + np.uint64(1)))  # a token of a pair
    order = np.lexsort((places[~in_a], mark[~in_a]))
    sorted_b, place_b = mark[~in_a][order], places[~in_a][order]
    new = _starts(sorted_b)
    values, key = sorted_b[new], (np.cumsum(new) - 1) << 32 | place_b
    if not len(values):
        return nothing
    order = np.lexsort((places[in_a], of[in_a]))
    mine, p_all, m_all = of[in_a][order], places[in_a][order], mark[in_a][order]
    rank = np.searchsorted(values, m_all)
    known = values[np.minimum(rank, len(values) - 1)] == m_all
    held, rank = (mine * wide + p_all)[known], rank[known]
    # only anchors near a passage of a with as many tokens of b, at any place, as the threshold needs
    if len(held) < need:
        return nothing
    dense = np.flatnonzero(held[need - 1:] - held[:len(held) - need + 1] < t)
    if not len(dense):
        return nothing
    from_, to = held[dense + need - 1] - t + 1, held[dense] + t - 1
    q = np.searchsorted(names, _mixed(anchors[:, 0], anchors[:, 1]))
    x, shift = anchors[:, 2], anchors[:, 2] - anchors[:, 3]
    i = np.searchsorted(to, q * wide + x)
    good = (i < len(to)) & (from_[np.minimum(i, len(to) - 1)] <= q * wide + x)
    order = np.lexsort((x[good], shift[good], q[good]))
    q, x, shift = q[good][order], x[good][order], shift[good][order]
    if not len(q):
        return nothing
    # a line is a pair and a shift; starts in a whose passage holds an anchor and lies in both texts
    line = np.cumsum(_starts(q, shift)) - 1
    low, high = np.maximum(0, shift), np.minimum(lengths[0][q], lengths[1][q] + shift) - t
    line, start = covered(line, x, t - 1, 0, low, high)
    head = np.flatnonzero(_starts(q, shift))
    l_pair, l_shift = q[head], shift[head]
    if not len(line):
        return nothing
    at = np.flatnonzero(_starts(line))
    used = line[at]  # lines with starts
    l_pair, l_shift = l_pair[used], l_shift[used]
    line = np.cumsum(_starts(line)) - 1
    base, last = start[at], start[np.append(at[1:], len(start)) - 1]
    lo, hi = np.searchsorted(held, l_pair * wide + base), np.searchsorted(held, l_pair * wide + last + t)
    n = hi - lo
    of_line = np.repeat(np.arange(len(n)), n)
    pick = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    p, r = held[pick] % wide, rank[pick]
    target = p - l_shift[of_line]
    i = np.searchsorted(key, r << 32 | np.maximum(target, 0))
    best, far = np.full(len(p), -1), np.full(len(p), 1 << 60)
    for k in (i - 1, i):
        kk = key[np.clip(k, 0, len(key) - 1)]
        other = kk & (wide - 1)
        distance = np.where((k >= 0) & (k < len(key)) & (kk >> 32 == r), np.abs(other - target), 1 << 60)
        best, far = np.where(distance < far, other, best), np.minimum(distance, far)
    near = far < t
    p, of_line = p[near], of_line[near]
    partner = best[near] + l_shift[of_line]
    # a start counts a token if the token and its partner lie in its passage
    size = last - base + 1
    offset = np.cumsum(size + 1) - (size + 1)
    begins = np.clip(np.maximum(p, partner) - t + 1 - base[of_line], 0, size[of_line]) + offset[of_line]
    ends = np.clip(np.minimum(p, partner) + 1 - base[of_line], 0, size[of_line]) + offset[of_line]
    cells_ = int((size + 1).sum())
    ends = np.maximum(begins, ends)
    shared = np.cumsum(np.bincount(begins, minlength=cells_) - np.bincount(ends, minlength=cells_))[start - base[line] + offset[line]]
    similarity = shared / (2 * t - shared)
    good = similarity >= params.similarity
    line, start, similarity = line[good], start[good], similarity[good]
    if not len(line):
        return nothing
    new = _starts(line)
    new[1:] |= np.diff(start) > t
    at = np.flatnonzero(new)
    end = start[np.append(at[1:], len(start)) - 1] + params.words
    begin, l = start[at], line[at]  # noqa: E741
    return [a_of[l_pair[l]], b_of[l_pair[l]], begin, end - begin, begin - l_shift[l], np.maximum.reduceat(similarity, at)]


def _repeats(rows: np.ndarray, params: Params) -> list[np.ndarray]:
    """What members of a class repeat of its first one, word by word: columns like those of spans."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 4], rows[:, 1], rows[:, 0]))]
    a, b, first, last, shift = rows.T
    line = np.cumsum(_starts(a, b, shift))
    top = np.maximum.accumulate(last + (line << 32))  # the last start so far of its pair and diagonal
    new = _starts(line)
    new[1:] |= first[1:] + (line[1:] << 32) > top[:-1] + 1
    at = np.flatnonzero(new)
    end = (top & 0xFFFFFFFF)[np.append(at[1:], len(a)) - 1]
    return [a[at], b[at], first[at], end - first[at] + params.words, first[at] - shift[at], np.ones(len(at))]


def _found(blobs: DataFrame, params: Params) -> DataFrame:
    """The passages that repeat or verified pairs share, of REPEAT, PART and PAIR."""
    names = ["a", "b", "start", "n_words", "of_start", "similarity"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_bucket(batches):
            made = []
            repeats, anchors = _matrix(held, REPEAT, 5), _matrix(held, PAIR, 4)
            if len(repeats):
                made.append(_repeats(repeats, params))
            if len(anchors):
                made.append(spans(_matrix(held, PART, 5), np.frombuffer(_bytes(held, PLACES), "<i4"), np.frombuffer(_bytes(held, TOKENS), "<u8"), anchors, params))
            for columns in made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return _gathered(blobs, work, SPANS)


def _nodes(found: DataFrame) -> DataFrame:
    """(link, side, node): the stretch of each text that the two sides of a found passage lie in; what overlaps in a
    text is one stretch."""
    buckets = _buckets(found.sparkSession)

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[Dealt]:
        for batch in batches:
            a, b, start, n, of_start, link = (batch.column(k).to_numpy() for k in range(6))
            if len(a):
                yield CELL, a, _rows([a, start, start + n, link, np.zeros(len(a))])
                yield CELL, b, _rows([b, of_start, of_start + n, link, np.ones(len(a))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_bucket(batches):
            rows = _matrix(held, CELL, 5)
            rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
            text, start, end, link, side = rows.T
            nth = np.cumsum(_starts(text))
            top = np.maximum.accumulate((nth << 40) + end)
            new = _starts(text)
            new[1:] |= (nth[1:] << 40) + start[1:] > top[:-1]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (link, side, _mixed(text[first], start[first]))], names=["link", "side", "node"])

    rows = found.select("a", "b", "start", "n_words", "of_start", "link").mapInArrow(lambda batches: _blobs(sides(batches), buckets), BLOBS)
    return _gathered(rows, work, "link bigint, side bigint, node bigint")


def _counted(rows: DataFrame) -> DataFrame:
    """(doc_id, key, n) of rows (doc_id, key, text): n words."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(t.as_buffer().to_pybytes().split()) for t in batch.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "key", "n"])
        release()

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key bigint, n bigint")


def find_passages(docs: DataFrame, params: Params = Params(), text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per repeated passage of a document: doc_id, start (word), n_words, the original it is most similar to
    (of_doc_id, of_start, similarity), the ids of all originals it was found in (of_doc_ids) and their own places
    (originals: of_doc_id, start, n_words, of_start, similarity), and class_id: the same for all passages that near duplicates
    join, directly or through others. Passages that overlap are one."""
    tables = Tables(docs.sparkSession, "substring")

    def put(make: Callable[[], DataFrame]) -> DataFrame:
        """A stored table; files of the shuffles before it go with the objects that stand for them."""
        out = tables.put(make())
        for _ in range(2):  # the driver's Python lets go first, a moment later Spark's cleaner sees it
            gc.collect()
            docs.sparkSession._jvm.System.gc()
            time.sleep(0.5)
        return out

    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(docs[id_column].alias("doc_id"), F.xxhash64(t).alias("key"), t.alias("text"))
    texts = rows.select("key", "text")
    groups = put(lambda: _groups(_cells(_shared(_ranges(texts, params), params), params), params))
    crossing = put(lambda: _crossing(_near(_only(groups, ASKED), texts, params), params))
    parts = lambda: _parts(_only(groups, SIDE).unionByName(crossing), texts, params)
    found = put(lambda: _found(_only(groups, REPEAT).unionByName(parts()), params).withColumn("link", F.xxhash64("a", "b", "start", "n_words", "of_start")))
    tables.drop(groups, crossing)
    node = lambda side: F.max(F.when(F.col("side") == side, F.col("node")))
    links = tables.put(_nodes(found).groupBy("link").agg(node(0).alias("a"), node(1).alias("b")))
    labels = components(links, tables)
    found = found.join(links.select("link", F.col("a").alias("node")), "link").join(labels.withColumnRenamed("label", "class_id"), "node", "left")
    found = found.withColumn("class_id", F.coalesce("class_id", "node"))

    long = F.octet_length("text") >= 2 * params.words - 1  # shorter ones cannot have so many words
    ids = _counted(rows.where(long)).where(F.col("n") >= params.words)
    ids = tables.put(ids)
    # stored, so that both sides of the joins with it are plain exchanges, of which a hot original's rows can be dealt anew
    first = tables.put(ids.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    copies = ids.join(first.where("copies > 1"), "key").where(~F.col("doc_id").eqNullSafe(F.col("least")))
    copies = copies.select("doc_id", F.lit(0).cast("bigint").alias("start"), F.col("n").alias("n_words"), F.col("least").alias("of_doc_id"), F.lit(0).cast("bigint").alias("of_start"), F.lit(1.0).alias("similarity"), F.array("least").alias("of_doc_ids"),
                           F.array(F.struct(F.col("least").alias("of_doc_id"), F.lit(0).cast("bigint").alias("start"), F.col("n").alias("n_words"), F.lit(0).cast("bigint").alias("of_start"), F.lit(1.0).alias("similarity"))).alias("originals"), F.col("key").alias("class_id"))
    named = found.join(first.select(F.col("key").alias("b"), F.col("least").alias("of_doc_id")), "b")
    before = Window.partitionBy("a").orderBy("start", "n_words").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("start") > F.max(F.col("start") + F.col("n_words")).over(before), F.lit(True))
    island = F.sum(F.col("fresh").cast("int")).over(Window.partitionBy("a").orderBy("start", "n_words").rowsBetween(Window.unboundedPreceding, 0))
    marked = named.withColumn("fresh", fresh).withColumn("island", island)
    best = F.max(F.struct("similarity", (-F.col("of_doc_id")).alias("back"), "of_doc_id", "of_start")).alias("best")
    merged = marked.groupBy("a", "island").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n_words")).alias("end"), best, F.array_sort(F.collect_set("of_doc_id")).alias("of_doc_ids"), F.array_sort(F.collect_list(F.struct("of_doc_id", "start", "n_words", "of_start", "similarity"))).alias("originals"), F.min("class_id").alias("class_id"))
    merged = merged.select("a", "start", (F.col("end") - F.col("start")).alias("n_words"), "best.of_doc_id", "best.of_start", "best.similarity", "of_doc_ids", "originals", "class_id")
    spread = merged.join(ids.select(F.col("key").alias("a"), "doc_id"), "a").drop("a")
    return spread.select(*copies.columns).unionByName(copies)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
SQL: dict[str, str] = {}
