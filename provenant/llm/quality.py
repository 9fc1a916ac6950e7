"""Quality rules (10): tokeniser fertility beside surface counts, in one pass of the text through Arrow.

Public vocabularies encode each word (a run of anything but ASCII white space) as it stands at the start of a word: a
sentencepiece one with byte fallback, and a byte-level one for many languages. Per text that gives characters per token of
both, and of the first the share of byte-fallback tokens and the entropy of the token distribution. Word types are encoded once
and remembered, in a table of bounded size that is emptied when it is full, so results do not depend on it. A text goes to
Python once, in batches of bounded bytes, and is measured in pieces, so a task's memory follows these and its longest text.

Bands are measured: over all texts that pass the surface rules, equal ones counted once, each language and each script has
for every doubling of length the quantiles 0.05, 0.5 and 0.95 of each figure. A text is rejected when a figure lies further from
the median than ``reach`` spreads of that side (a spread is the quantile's distance in units of a normal deviate, and at
least ``floors``). So short texts, whose figures scatter, have wider bands. The band of the language decides, then that of
the script, and where neither has ``enough`` texts of that length a fixed wide one of the script.

Defined results: a null text counts as an empty one; a null language has its script's band; rows that repeat are judged
alike; columns of other names, clashing ones included, are left as they are; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import GOLDEN, Tables, let_go, mix64, release, small_batches, table

SYMBOLS = b"#*$%&|<>"
FAMILIES = ("latin", "greek", "cyrillic", "arabic", "indic", "cjk", "other", "none")


@dataclass(frozen=True)
class Band:
    """Characters per token between low and high; at most ``byte_share`` byte tokens; at least ``entropy`` bits."""

    low: float
    high: float
    byte_share: float
    entropy: float


@dataclass(frozen=True)
class Rules:
    """``by_script`` holds wide bands for prose under a vocabulary of about 32,000 pieces, where the table has too little to
    measure."""

    vocabulary: str = "piece_bpe_32k.model"
    byte_vocabulary: str = "byte_bpe_multi_50k.tiktoken"
    path: str | None = None
    byte_path: str | None = None
    least_words: int = 10
    most_repeat_percent: int = 20
    reach: float = 5.0
    enough: int = 40
    floors: dict = field(default_factory=lambda: {"chars_per_token": 0.08, "chars_per_byte_token": 0.08, "byte_share": 0.02, "token_entropy": 0.1})
    by_script: dict = field(default_factory=lambda: {
        "latin": Band(1.4, 9.0, 0.25, 3.0), "greek": Band(0.8, 6.0, 0.4, 3.0), "cyrillic": Band(1.2, 8.0, 0.3, 3.0),
        "arabic": Band(0.7, 6.0, 0.5, 3.0), "indic": Band(0.4, 6.0, 0.9, 3.0), "cjk": Band(0.25, 4.0, 0.95, 3.0),
        "other": Band(0.25, 9.0, 0.95, 2.5), "none": Band(0.8, 6.0, 0.25, 2.5),
    })
    #: Bands are counted; up to so many rows of them are sent to all tasks, so that texts are not dealt by their language.
    broadcast_rows: int = 200_000
    types_kept: int = 100_000
    words_at_once: int = 100_000
    batch_bytes: int = 8_000_000

    def models(self) -> tuple[str, str]:
        import public_tokenizers

        return self.path or public_tokenizers.path(self.vocabulary), self.byte_path or public_tokenizers.path(self.byte_vocabulary)


#: The figures that have bands, and the sides on which a text can leave them.
SIDES = {"chars_per_token": "both", "chars_per_byte_token": "both", "byte_share": "high", "token_entropy": "low"}
METRICS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("n_tokens", pa.int64()), ("chars_per_token", pa.float64()),
    ("chars_per_byte_token", pa.float64()), ("byte_share", pa.float64()), ("token_entropy", pa.float64()), ("script", pa.string()),
]
SPARK_TYPES = {pa.int64(): T.LongType(), pa.bool_(): T.BooleanType(), pa.float64(): T.DoubleType(), pa.string(): T.StringType()}


def family(word: str) -> int:
    """The script family of a word's first letter."""
    for c in word:
        if c.isalpha():
            o = ord(c)
            if o < 0x250 or 0x1E00 <= o < 0x1F00:
                return 0
            if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
                return 1
            if 0x400 <= o < 0x530:
                return 2
            if 0x600 <= o < 0x780:
                return 3
            if 0x900 <= o < 0xE00:
                return 4
            if 0x2E80 <= o < 0xA000 or 0xAC00 <= o < 0xD7B0 or 0x20000 <= o < 0x32000:
                return 5
            return 6
    return 7


class Types:
    """Word types met so far: code points, tokens, byte tokens, tokens of the byte-level vocabulary and script of each."""

    def __init__(self, rules: Rules):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        pieces, ranks = rules.models()
        self.encoder = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(ranks, "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.byte_encoder = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self.is_byte = np.array([self.encoder.is_byte(i) for i in range(self.encoder.vocab_size())])
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.points, self.script = np.empty(0, np.int64), np.empty(0, np.int8)
        self.tokens, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.byte_tokens = np.empty(0, np.int64)

    def learn(self, words: list[bytes]) -> np.ndarray:
        """The ids of words, after the new ones among them are encoded."""
        new = list(set(words).difference(self.ids))
        if new:
            text = [w.decode() for w in new]
            coded = self.encoder.encode(text)
            first = len(self.ids)
            self.ids.update(zip(new, range(first, first + len(new))))
            self.points = np.concatenate([self.points, np.fromiter(map(len, text), np.int64, len(new))])
            self.script = np.concatenate([self.script, np.fromiter(map(family, text), np.int8, len(new))])
            more = self.byte_encoder.encode_ordinary
            self.byte_tokens = np.concatenate([self.byte_tokens, np.fromiter((len(more(" " + w)) for w in text), np.int64, len(new))])
            sizes = np.fromiter(map(len, coded), np.int64, len(new))
            self.tokens = np.concatenate([self.tokens, np.fromiter((i for ids in coded for i in ids), np.int32, int(sizes.sum()))])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive ends."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends[1:]] - total[ends[:-1]]


def _repeats(ids: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """For each word, whether it lies in a window of ``size`` words found twice or more in its document."""
    n = len(ids) - size + 1
    covered = np.zeros(len(ids), bool)
    if n < 1:
        return covered
    base = mix64(ids.astype(np.uint64) + np.uint64(1))
    key = np.zeros(n, np.uint64)
    for k in range(size):
        key = mix64(key * GOLDEN + base[k:k + n])
    key ^= mix64(doc[:n].astype(np.uint64) * GOLDEN + np.uint64(7))
    whole = np.flatnonzero(doc[:n] == doc[size - 1:])
    ordered = np.sort(key[whole])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        at = np.minimum(np.searchsorted(twice, key[whole]), len(twice) - 1)
        hit = whole[twice[at] == key[whole]]
        for k in range(size):
            covered[hit + k] = True
    return covered


def measure(texts: list[bytes], types: Types, rules: Rules) -> dict[str, np.ndarray | list]:
    split = [t.split() for t in texts]
    n_words = np.fromiter(map(len, split), np.int64, len(texts))
    ends = np.concatenate([[0], np.cumsum(n_words)])
    if len(types.ids) > rules.types_kept:
        types.clear()
    ids = types.learn([w for ws in split for w in ws])
    doc = np.repeat(np.arange(len(texts)), n_words)
    points = _sums(types.points[ids], ends)
    per_word = np.diff(types.ends)[ids]
    n_tokens = _sums(per_word, ends)
    at = np.repeat(types.ends[:-1][ids] - np.concatenate([[0], np.cumsum(per_word)])[:-1], per_word) + np.arange(int(per_word.sum()))
    tokens = types.tokens[at]
    token_ends = np.concatenate([[0], np.cumsum(n_tokens)])
    n_bytes = _sums(types.is_byte[tokens].astype(np.int64), token_ends)
    pair = np.sort(np.repeat(np.arange(len(texts)), n_tokens) << 32 | tokens)
    starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.empty(0, np.int64)
    counts = np.diff(np.concatenate([starts, [len(pair)]]))
    spread = np.bincount(pair[starts] >> 32, counts * np.log2(np.maximum(counts, 1)), len(texts)) if len(pair) else np.zeros(len(texts))
    some = np.maximum(n_tokens, 1)
    entropy = np.maximum(0, np.log2(some) - spread / some)
    votes = np.stack([_sums((types.script[ids] == f).astype(np.int64), ends) for f in range(len(FAMILIES) - 1)])
    script = np.where(votes.sum(0) > 0, votes.argmax(0), len(FAMILIES) - 1)
    repeat = _sums(_repeats(ids, doc, 5).astype(np.int64), ends)
    dup = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip()] if b"\n" in t else ()
        dup.append(len(lines) - len(set(lines)))
    failed = (n_words < rules.least_words) | (100 * repeat > rules.most_repeat_percent * n_words)
    return {
        "n_words": n_words, "word_chars": points, "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for t in texts], "n_dup_lines": dup,
        "n_repeat_words": repeat, "base_failed": failed, "n_tokens": n_tokens, "chars_per_token": points / some,
        "chars_per_byte_token": points / np.maximum(_sums(types.byte_tokens[ids], ends), 1), "byte_share": n_bytes / some,
        "token_entropy": entropy, "script": [FAMILIES[s] for s in script],
    }


def _metrics(texts: pa.Array, types: Types, rules: Rules) -> pa.StructArray:
    """In pieces of about ``words_at_once`` words, so memory follows the largest text and not the batch."""
    found, piece, size = [], [], 0

    def flush() -> None:
        nonlocal piece, size
        if piece:
            m = measure(piece, types, rules)
            found.append(pa.StructArray.from_arrays([pa.array(m[n], t) for n, t in METRICS], [n for n, _ in METRICS]))
        piece, size = [], 0

    for k in range(0, len(texts), 500):
        for t in texts.slice(k, 500).cast(pa.large_binary()).to_pylist():
            piece.append(t or b"")
            size += len(t or b"") // 6 + 1
            if size >= rules.words_at_once:
                flush()
    flush()
    empty = pa.array([], pa.struct([pa.field(n, t) for n, t in METRICS]))
    return pa.concat_arrays(found) if found else empty


def _sent(df: DataFrame, text: str, lang: str | None, keep: list[str]) -> tuple[DataFrame, int]:
    """What goes to Python, and the place of the text in it: a hash of the text, the language, the kept columns as _2, _3, ..., and
    the text only if it is none of these, as texts are most of the bytes."""
    inner = [F.xxhash64(df[text].cast("string")).alias("_hash"), (df[lang].cast("string") if lang else F.lit(None).cast("string")).alias("_lang")]
    inner += [df[c].alias(f"_{i + 2}") for i, c in enumerate(keep)]  # positions and not names, so that none can clash
    if text in keep and df.schema[text].dataType == T.StringType():
        return df.select(*inner), 2 + keep.index(text)
    return df.select(*inner, df[text].cast("string").alias("_0")), len(inner)


def _measured(df: DataFrame, rules: Rules, text: str, lang: str | None, keep: list[str]) -> DataFrame:
    """Stored rows: the kept columns as _2, _3, ..., a hash of the text, the language, and the METRICS."""
    narrow, at = _sent(df, text, lang, keep)
    n = len(keep) + 2
    out = T.StructType([*narrow.schema.fields[:n], *(T.StructField(n, SPARK_TYPES[t]) for n, t in METRICS)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        types = None
        for b in batches:
            if not b.num_rows:
                continue
            types = types or Types(rules)
            m = _metrics(b.column(at), types, rules)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *(m.field(n) for n, _ in METRICS)], names=[f.name for f in out])
        release()

    with small_batches(df.sparkSession, rules.batch_bytes):
        return Tables(df.sparkSession, "quality").put(narrow.mapInArrow(work, out))


def _length() -> Column:
    """The doubling of length that a text falls in."""
    return F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int")


def measured_bands(measured: DataFrame, rules: Rules) -> DataFrame:
    """(of, length, low and high of each figure): a row per language or script and doubling of length with enough texts."""
    good = measured.where("not base_failed").select("_hash", "_lang", "script", _length().alias("length"), *SIDES).dropDuplicates(["_hash"])
    of = F.explode(F.array(F.concat(F.lit("language "), F.col("_lang")), F.concat(F.lit("script "), F.col("script"))))
    quantiles = [F.percentile_approx(m, [0.05, 0.5, 0.95], 2000).alias(m) for m in SIDES]
    rows = good.select(of.alias("of"), "length", *SIDES).where("of is not null").groupBy("of", "length").agg(F.count("*").alias("n"), *quantiles).where(F.col("n") >= rules.enough)
    limits = []
    for m in SIDES:
        q = [F.get(F.col(m), F.lit(i)) for i in range(3)]
        spread = lambda d, m=m: F.greatest(d / 1.6448536269514722, F.lit(rules.floors[m])) * rules.reach
        limits += [(q[1] - spread(q[1] - q[0])).alias(f"low_{m}"), (q[1] + spread(q[2] - q[1])).alias(f"high_{m}")]
    return rows.select("of", "length", *limits)


def _judged(measured: DataFrame, rules: Rules) -> DataFrame:
    """The measured rows with ``kept``."""
    bands = Tables(measured.sparkSession, "bands").put(measured_bands(measured, rules))
    names = [c for c in bands.columns if c not in ("of", "length")]
    rows = measured.withColumn("_length", _length())
    for kind, value in (("language ", "_lang"), ("script ", "script")):
        side = bands.select(F.col("of").alias(f"_of_{value}"), F.col("length").alias(f"_length_{value}"), F.struct(*names).alias(f"_band_{value}"))
        side = F.broadcast(side) if bands.rows <= rules.broadcast_rows else side
        rows = rows.join(side, (F.concat(F.lit(kind), F.col(value)) == F.col(f"_of_{value}")) & (F.col("_length") == F.col(f"_length_{value}")), "left")
    band = F.coalesce("_band__lang", "_band_script")
    inside = F.lit(True)
    for m, side in SIDES.items():
        if side != "high":
            inside = inside & (F.col(m) >= band[f"low_{m}"])
        if side != "low":
            inside = inside & (F.col(m) <= band[f"high_{m}"])
    wide = F.lit(True)
    for name, b in rules.by_script.items():
        own = F.col("chars_per_token").between(b.low, b.high) & (F.col("byte_share") <= b.byte_share) & (F.col("token_entropy") >= F.least(F.lit(b.entropy), F.log2(F.greatest("n_tokens", F.lit(1))) * 0.6))
        wide = F.when(F.col("script") == name, own).otherwise(wide)
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, wide))


def judge(df: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str | None = "lang", id_column: str = "doc_id") -> DataFrame:
    """One row per document: its id, the METRICS and the verdict ``kept``."""
    rows = _judged(_measured(df, rules, text, lang, [id_column]), rules)
    return rows.select(F.col("_2").alias(id_column), *[n for n, _ in METRICS], "kept")


def keep_good(df: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str | None = "lang") -> DataFrame:
    """The documents that the rules keep, with their columns. Texts are read once; rows are stored beside their figures, and
    only the bands, a few rows, meet them."""
    rows = _judged(_measured(df, rules, text, lang, df.columns), rules).where("kept")
    return rows.select(*[F.col(f"_{i + 2}").alias(c) for i, c in enumerate(df.columns)])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES = {"op10_quality_rules": op10_quality_rules}
SQL: dict[str, str] = {}
