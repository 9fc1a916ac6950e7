"""Language ID (4): a linear-chain conditional random field labels every word; a document gets its likeliest label.

A word (a run of anything but ASCII white space, lower-cased) has hashed features: prefixes and suffixes of one to four
letters, character bigrams and trigrams with its ends marked, and membership in a lexicon of each language. Transition
weights between the labels of neighbouring words are learned with them. Forward-backward gives each word's posterior over
labels, exactly and over the whole text; the mean over words with a letter is the document's, so code-switched text is
labelled word by word before it is summed up.

Training takes a bounded sample of labelled documents: of every label about ``per_label`` distinct texts, chosen by hash (a
text once, however many copies it has), and of each a run of ``piece`` words at a hashed place. More than ``most_labels``
labels are refused, never left out; weights and emissions take 4 bytes per label and bucket or word. Half of it makes the
lexicons (words in two or more documents), half the sequences: runs from different documents are strung together, so that
transitions between languages are seen. The driver fits the weights by gradient steps on the conditional likelihood.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every text when nothing could be
learned; repeated rows get equal results; an empty table has no rows. Only the text is an input of a prediction.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, table, words

UNKNOWN = "und"


@dataclass(frozen=True)
class Params:
    most_labels: int = 2000
    per_label: int = 240
    piece: int = 120
    buckets: int = 1 << 15
    lexicon: int = 5000
    sequences: int = 2000
    length: int = 64
    epochs: int = 4
    rate: float = 0.1
    ridge: float = 1e-5
    seed: int = 11
    types_kept: int = 150_000
    words_at_once: int = 300_000


def features(ws: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, bucket) of every hashed feature of lower-cased words, in word order per kind; and which have a letter."""
    marked = ["\x02" + w + "\x03" for w in ws]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(ws))
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    word = np.repeat(np.arange(len(ws)), sizes)
    seen, back = np.unique(codes, return_inverse=True)
    is_letter = np.fromiter((chr(int(c)).isalpha() for c in seen), bool, len(seen))[back] if len(codes) else np.empty(0, bool)
    letters = np.bincount(word[is_letter], minlength=len(ws)) > 0
    who, what = [], []

    def put(kind: int, at: np.ndarray, n: int, index: np.ndarray) -> None:
        h = np.full(len(at), kind, np.uint64)
        for k in range(n):
            h = mix64(h * np.uint64(0x100000001B3) + codes[at + k])
        who.append(index)
        what.append((h & np.uint64(buckets - 1)).astype(np.int64))

    for n in (2, 3):
        at = np.flatnonzero(word[: max(0, len(word) - n + 1)] == word[n - 1:])
        put(n, at, n, word[at])
    for n in (1, 2, 3, 4):
        long = np.flatnonzero(sizes - 2 >= n)
        put(10 + n, starts[long] + 1, n, long)
        put(20 + n, starts[long] + sizes[long] - 1 - n, n, long)
    return np.concatenate(who), np.concatenate(what), letters


def forward_backward(emission: np.ndarray, transition: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Posteriors (words x labels) of sequences that lie one after the other; ends: their bounds, from 0."""
    return messages(emission, transition, ends)[0]


def messages(emission: np.ndarray, transition: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posteriors, forward messages, backward messages times local weights).

    All sequences advance together, longest first, so each step is one small matrix product. Rows are rescaled as they
    go; only ratios matter.
    """
    labels = emission.shape[1]
    lengths = np.diff(ends)
    order = np.argsort(-lengths, kind="stable")
    first, lengths = ends[:-1][order], lengths[order]
    local = np.exp(emission - emission.max(1, keepdims=True)) if len(emission) else emission
    step = np.exp(transition - transition.max())
    forward = np.empty_like(local)
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # sequences longer than t
    state = None
    for t in range(longest):
        at = first[: active[t]] + t
        state = local[at] if t == 0 else (state[: active[t]] @ step) * local[at]
        state = state / state.sum(1, keepdims=True)
        forward[at] = state
    out, inward = np.empty_like(local), np.empty_like(local)
    state = np.empty((0, labels), local.dtype)
    for t in range(longest - 1, -1, -1):
        n = int(active[t])
        here = np.ones((n, labels), local.dtype)
        if len(state):
            at = first[: len(state)] + t + 1
            here[: len(state)] = (state * local[at]) @ step.T
        here /= here.sum(1, keepdims=True)
        at = first[:n] + t
        both = forward[at] * here
        out[at] = both / both.sum(1, keepdims=True)
        inward[at] = here * local[at]
        state = here
    return out, forward, inward


class Model:
    def __init__(self, labels: list[str], lexicons: dict[str, int], params: Params):
        self.labels, self.lexicons, self.params = labels, lexicons, params
        k = len(labels)
        self.weights = np.zeros((params.buckets + k, k), np.float32)  # the last k rows: lexicon membership
        self.transition = np.zeros((k, k), np.float32)

    def rows(self, ws: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, feature) with lexicon features, grouped by word, and which words have a letter."""
        who, what, letters = features(ws, self.params.buckets)
        known = [(i, self.params.buckets + b) for i, m in enumerate(map(self.lexicons.get, ws)) if m for b in range(len(self.labels)) if m >> b & 1]
        if known:
            extra = np.array(known)
            who, what = np.concatenate([who, extra[:, 0]]), np.concatenate([what, extra[:, 1]])
        use = letters[who]  # words without a letter say nothing
        return who[use], what[use], letters

    def emission(self, ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
        who, what, letters = self.rows(ws)
        out = np.stack([np.bincount(who, self.weights[what, k], len(ws)) for k in range(len(self.labels))], 1) if self.labels else np.zeros((len(ws), 0))
        return out.astype(np.float32), letters

    def fit(self, sequences: list[tuple[list[str], np.ndarray]], seed: int) -> Model:
        """Adaptive gradient steps on the conditional log-likelihood, a batch of sequences at a time."""
        p, k, rng = self.params, len(self.labels), np.random.default_rng(seed)
        types: dict[str, int] = {}
        coded = [(np.fromiter((types.setdefault(w, len(types)) for w in ws), np.int64, len(ws)), y) for ws, y in sequences]
        who, what, _ = self.rows(list(types))
        order = np.argsort(who, kind="stable")
        what = what[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(types)))])
        sum_w, sum_t = np.full_like(self.weights, 1e-6), np.full_like(self.transition, 1e-6)
        for _ in range(p.epochs):
            shuffled = rng.permutation(len(coded))
            for at in range(0, len(coded), 50):
                batch = [coded[i] for i in shuffled[at:at + 50]]
                ids, y = np.concatenate([b[0] for b in batch]), np.concatenate([b[1] for b in batch])
                bounds = np.concatenate([[0], np.cumsum([len(b[0]) for b in batch])])
                many = ends[ids + 1] - ends[ids]
                feats = what[np.repeat(ends[ids] - np.concatenate([[0], np.cumsum(many)])[:-1], many) + np.arange(int(many.sum()))]
                word = np.repeat(np.arange(len(ids)), many)
                e = np.stack([np.bincount(word, self.weights[feats, j], len(ids)) for j in range(k)], 1)
                post, forward, inward = messages(e, self.transition.astype(np.float64), bounds)
                error = post.copy()
                error[np.arange(len(y)), y] -= 1
                used, back = np.unique(feats, return_inverse=True)
                grad = np.stack([np.bincount(back, error[word, j], len(used)) for j in range(k)], 1) / len(batch) + p.ridge * self.weights[used]
                sum_w[used] += grad**2
                self.weights[used] -= (p.rate * grad / np.sqrt(sum_w[used])).astype(np.float32)
                inner = np.flatnonzero(~np.isin(np.arange(len(ids)), bounds[1:] - 1))
                joint = forward[inner][:, :, None] * np.exp(self.transition - self.transition.max()) * inward[inner + 1][:, None, :]
                expected = (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                np.subtract.at(expected, (y[inner], y[inner + 1]), 1)
                grad = expected / len(batch) + p.ridge * self.transition
                sum_t += grad**2
                self.transition -= (p.rate * grad / np.sqrt(sum_t)).astype(np.float32)
        return self


def _train(pieces: list[tuple[str, list[str]]], labels: list[str], params: Params) -> Model:
    rng = np.random.default_rng(params.seed)
    index = {x: i for i, x in enumerate(labels)}
    by = [[ws for x, ws in pieces if index[x] == k] for k in range(len(labels))]
    lexicons: dict[str, int] = {}
    for k, docs in enumerate(by):
        met = Counter(w for ws in docs[::2] for w in set(ws))
        for w, n in sorted(met.items(), key=lambda x: (-x[1], x[0]))[: params.lexicon]:
            if n > 1:
                lexicons[w] = lexicons.get(w, 0) | 1 << k
    pool = [[ws for ws in (docs[1::2] or docs) if ws] for docs in by]
    some = [k for k, docs in enumerate(pool) if docs]
    sequences = []
    for _ in range(params.sequences if some else 0):
        ws, y, switches = [], [], rng.random() < 0.5
        k = some[rng.integers(len(some))]
        while len(ws) < params.length:
            doc = pool[k][rng.integers(len(pool[k]))]
            n = int(rng.integers(4, 25)) if switches else params.length
            at = int(rng.integers(0, max(1, len(doc) - n + 1)))
            part = doc[at:at + n]
            ws += part
            y += [k] * len(part)
            k = some[rng.integers(len(some))] if switches else k
        sequences.append((ws, np.array(y)))
    return Model(labels, lexicons, params).fit(sequences, params.seed)


def train(labelled: DataFrame, params: Params = Params(), text: str = "text", lang: str = "lang") -> Model:
    """Fits the model; the driver gets at most 2 * per_label runs of ``piece`` words per label."""
    rows = labelled.select(labelled[text].cast("string").alias("t"), labelled[lang].cast("string").alias("y")).where("t is not null and y is not null")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).limit(params.most_labels + 1).collect()}
    if len(counts) > params.most_labels:
        raise ValueError(f"more than {params.most_labels} labels")
    labels = sorted(counts)
    if not labels:
        return Model([], {}, params)
    h = F.xxhash64(F.lit(params.seed), F.substring("t", 1, 200), F.length("t"))
    rate = F.lit(0.0)
    for y, n in counts.items():
        rate = F.when(F.col("y") == y, F.lit(min(1.0, params.per_label / n))).otherwise(rate)
    chosen = rows.withColumn("h", h).where(F.pmod("h", F.lit(1_000_000)) < rate * 1_000_000)
    place = F.pmod(F.shiftrightunsigned("h", 20), F.greatest(F.lit(1), F.size("ws") - params.piece + 1)).cast("int") + 1
    cut = chosen.select("y", "h", words(F.lower("t")).alias("ws")).select("y", "h", F.slice("ws", place, F.lit(params.piece)).alias("ws"))
    most = 4 * params.per_label * len(labels)  # far above what the rates let through of distinct texts
    pieces = cut.dropDuplicates(["h", "y"]).orderBy("h", "y").limit(most).collect()
    return _train([(r["y"], r["ws"]) for r in sorted(pieces, key=lambda r: (r["h"], r["y"], r["ws"]))], labels, params)


class Tagger:
    """A model with the emissions of word types met so far."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.emission, self.letters = np.empty((0, len(self.model.labels)), np.float32), np.empty(0, bool)

    def learn(self, ws: list[bytes]) -> np.ndarray:
        new = list(set(ws).difference(self.ids))
        if new:
            e, letters = self.model.emission([w.decode().lower() for w in new])
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new))))
            self.emission, self.letters = np.concatenate([self.emission, e]), np.concatenate([self.letters, letters])
        return np.fromiter(map(self.ids.__getitem__, ws), np.int64, len(ws))

    def posteriors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words x labels, which words have a letter, bounds of texts)."""
        if len(self.ids) > self.model.params.types_kept:
            self.clear()
        split = [t.split() for t in texts]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
        ids = self.learn([w for s in split for w in s])
        return forward_backward(self.emission[ids], self.model.transition, ends), self.letters[ids], ends

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        if not self.model.labels:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        post, letters, ends = self.posteriors(texts)
        total = np.concatenate([np.zeros((1, post.shape[1])), np.cumsum(post * letters[:, None], axis=0, dtype=np.float64)])
        n = np.concatenate([[0], np.cumsum(letters)])
        count = n[ends[1:]] - n[ends[:-1]]
        mean = (total[ends[1:]] - total[ends[:-1]]) / np.maximum(count, 1)[:, None]
        best = mean.argmax(1)
        label = [self.model.labels[k] if c else UNKNOWN for k, c in zip(best, count)]
        return label, np.where(count > 0, np.clip(mean.max(1), 0, 1), 0.0)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score; one pass, no shuffle."""
    from pyspark.sql import types as T

    out = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by Params: weights, transitions, lexicons
    at_once = max(20_000, 4 * model.params.words_at_once // max(4, len(model.labels)))  # words times labels are bounded

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for b in batches:
            label, score, piece, size = [], [], [], 0
            raw = b.column(0).cast(pa.large_binary()).to_pylist()
            for i, t in enumerate(raw):
                piece.append(t or b"")
                size += len(t or b"") // 6 + 1
                if size >= at_once or i == len(raw) - 1:
                    x, s = tagger.predict(piece)
                    label += x
                    score.append(s)
                    piece, size = [], 0
            if label:
                yield pa.RecordBatch.from_arrays([*(b.column(1 + i) for i in range(len(keep))), pa.array(label), pa.array(np.concatenate(score))], names=[f.name for f in out])

    return docs.select(docs[text].cast("string").alias("_text"), *(docs[c].alias(f"_{i}") for i, c in enumerate(keep))).mapInArrow(work, out)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = train(docs.where(~held_out).select("text", "lang"))
    return predict(docs.select("text", "doc_id", held_out.alias("held_out")), model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
SQL: dict[str, str] = {}
