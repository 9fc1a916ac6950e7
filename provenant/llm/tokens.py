"""Token-ID / binary output (2): shards of token ids with Elias-Fano document boundaries.

Texts are encoded with a public tokenizer file, an end id follows each, and documents in ascending id order (null first)
are dealt to shards by range. A shard is one file:

    magic "PTOK0001" | header (8 little-endian u64: documents, null ids, tokens, id width, least id, bytes of three parts)
    | ends: Elias-Fano of the running token counts | ids: Elias-Fano of doc_id - least id | the token ids, 2 or 4 bytes each

Elias-Fano keeps n increasing values below u in about n * (2 + log2(u / n)) bits: low bits packed, high bits in unary,
and the position of every 256th one in 32 bits, so ``select`` reads a few words and no table of 64-bit offsets exists; the reader selects the
boundaries of a batch of documents at a time.

Words between ASCII white space are encoded apart from one another, once per word form, and remembered up to a bound:
this tokenizer's normaliser and pre-tokeniser never reach across white space, nor from a letter of ASCII or Latin-1 into the marks
that end a word, so the ids are those of the whole text (tested against it).

A task writes its shard under a name of its own and renames it, with the same bytes whenever it runs again, so a lost
executor costs a rerun and leaves no half file behind. Files go to the shared folder through pyarrow's file systems.

Defined results: null, empty and blank texts have just the end id; rows that repeat an id stay apart, ordered by a hash of
their text;
special-token strings within a text are encoded as the tokenizer file says; an empty table has no shards and no rows.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, new_folder, release, rests, small_batches, table

MAGIC = b"PTOK0001"
HEADER = struct.Struct("<8Q")


@dataclass(frozen=True)
class Params:
    vocabulary: str = "word_bpe_49k.json"
    path: str | None = None
    end_id: int = 2
    shards: int | None = None
    types_kept: int = 700_000
    rest_s: float = 5.0
    chars_at_once: int = 2_500_000
    batch_bytes: int = 8_000_000
    width: int = 2

    def file(self) -> str:
        if self.path:
            return self.path
        import public_tokenizers

        return public_tokenizers.path(self.vocabulary)


class EliasFano:
    """Non-decreasing values of at least 0."""

    STEP = 256

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        low_bits = max(0, (most // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") if low_bits else np.empty(0, np.uint8)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[:: cls.STEP].astype("<u4"))

    def select(self, i: int) -> int:
        """Value i, from one sample, a few bytes of high bits and its own low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // self.STEP]), i % self.STEP
        byte, seen = at >> 3, 0
        current = int(self.high[byte]) & (0xFF << (at & 7)) & 0xFF
        while True:
            here = current.bit_count()
            if seen + here > left:
                break
            seen, byte = seen + here, byte + 1
            current = int(self.high[byte])
        for _ in range(left - seen):
            current &= current - 1
        position = (byte << 3) + (current & -current).bit_length() - 1
        low = 0
        first = i * self.low_bits
        for k in range(self.low_bits):
            low |= (int(self.low[(first + k) >> 3]) >> ((first + k) & 7) & 1) << k
        return ((position - i) << self.low_bits) | low

    def select_range(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1, from the sample before a and the bits up to the sample after b: what select does, for a batch."""
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b))
        if a == b:
            return np.empty(0, np.uint64)
        start, after = int(self.samples[a // self.STEP]), -(-b // self.STEP)
        stop = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[start // 8:stop], bitorder="little")) + start // 8 * 8
        ones = ones[ones >= start][a % self.STEP:][: b - a].astype(np.uint64)
        values = (ones - np.arange(a, b, dtype=np.uint64)) << np.uint64(self.low_bits)
        if self.low_bits:
            first = a * self.low_bits
            bits = np.unpackbits(self.low[first // 8:-(-b * self.low_bits // 8)], bitorder="little")[first % 8:][: (b - a) * self.low_bits]
            values |= (bits.reshape(b - a, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return values

    def dump(self) -> bytes:
        return struct.pack("<4Q", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def load(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b = struct.unpack_from("<4Q", data)
        raw = np.frombuffer(data, np.uint8, offset=32)
        return cls(n, low_bits, raw[:a], raw[a:a + b], np.frombuffer(data, "<u4", offset=32 + a + b))


#: ASCII marks that end a word: after an ASCII letter or digit the pre-tokeniser cuts before a run of them.
_MARKS = b'.,!?;:"%*$&#()[]{}-+=/@~^_`'
_BEFORE = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
#: UTF-8 of words of a-z and the small letters of Latin-1: lower case, composed, letters all.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_SMALL = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"


def _spelled(words: list[bytes]) -> list[str]:
    """Such words in the letters that stand for their bytes in a byte-level vocabulary: Latin-1's, but for three bytes."""
    return b" ".join(words).decode("latin-1").replace("\x9f", "\u0141").replace("\xa0", "\u0142").replace("\xad", "\u0143").split(" ")


class Encoder:
    """Words (bytes) to their ids (little-endian bytes of the file's width).

    Words met before are remembered in two generations of at most ``types_kept`` each: when the younger is full it becomes
    the older, and what is used again moves back, so frequent words stay and memory is bounded."""

    def __init__(self, params: Params):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.params = Tokenizer.from_file(params.file()), params
        self.model = Tokenizer(self.tokenizer.model)
        size = self.tokenizer.get_vocab_size()
        suffix = self.tokenizer.model.end_of_word_suffix
        if not suffix:
            raise ValueError("the vocabulary does not mark the ends of words")
        self.ends_word = np.fromiter(((self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)), bool, size)
        small = [_SMALL, *(a + b for a, b in zip(_SMALL, _SMALL[::-1]))]
        coded = self.model.encode(_spelled([w.encode() for w in small]), is_pretokenized=True, add_special_tokens=False).ids
        same = coded == [i for w in small for i in self.tokenizer.encode(w, add_special_tokens=False).ids]
        self.letters = _LETTERS.fullmatch if same else bytes.isalpha  # another vocabulary may not be byte-level
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.kind = f"<u{params.width}"
        self.end = np.array([params.end_id], self.kind).tobytes()
        if max(self.tokenizer.get_vocab_size(), params.end_id + 1) > 256**params.width:
            raise ValueError("the vocabulary needs a greater id width")

    def _plain(self, words: list[bytes]) -> Iterator[bytes]:
        """Ids of words of letters alone: already normalised and one pre-token each, so the model gets them as they are, many
        to a call, without offsets. Each word's last id, and no other, has the end-of-word suffix."""
        for at in range(0, len(words), 5000):
            spelled = _spelled(words[at:at + 5000])
            ids = np.array(self.model.encode_batch_fast([spelled], is_pretokenized=True, add_special_tokens=False)[0].ids, self.kind)
            raw, start = ids.tobytes(), 0
            for end in ((np.flatnonzero(self.ends_word[ids]) + 1) * self.params.width).tolist():
                yield raw[start:end]
                start = end

    def _other(self, words: list[bytes]) -> Iterator[bytes]:
        for at in range(0, len(words), 5000):
            for e in self.tokenizer.encode_batch_fast([w.decode() for w in words[at:at + 5000]], add_special_tokens=False):
                yield np.array(e.ids, self.kind).tobytes()

    def _learn(self, new: set[bytes]) -> None:
        """Makes the younger generation hold these words, which it lacks.

        A word is a core and the marks after it, in the lower case that the normaliser gives ASCII letters; the ids of the
        two together are those of the word. What might hold a special token stays as it is."""
        young, old = self.young, self.old
        if old:
            back = {w: old[w] for w in new if w in old}
            young.update(back)
            new.difference_update(back)
        if not new:
            return
        fresh = list(new)
        joined = b" ".join(fresh)
        if b"<|" in joined:
            low = [w.lower() if b"<|" not in w else w for w in fresh]
        else:
            low = joined.lower().split(b" ")
        cores = [x if x.isalpha() else self._core(x) for x in low]
        marks = [x[len(c):] for x, c in zip(low, cores)]
        wanted = set(cores)
        wanted.update(marks)
        wanted.discard(b"")
        known = {b"": b""}
        for c in wanted.difference(new):  # what is new is in neither generation
            ids = young.get(c) or old.get(c)
            if ids:
                known[c] = ids
        wanted.difference_update(known)
        plain = [c for c in wanted if self.letters(c)]
        other = list(wanted.difference(plain))
        known.update(zip(plain, self._plain(plain)))
        known.update(zip(other, self._other(other)))
        young.update((w, known[c] + known[m]) for w, c, m in zip(fresh, cores, marks))

    def _core(self, word: bytes) -> bytes:
        """The word without the marks after it, if they are cut off there for certain."""
        if b"<|" in word:
            return word
        core = word.rstrip(_MARKS)
        return core if core and (core[-1] in _BEFORE or self.letters(core)) else word

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text and the end id."""
        if len(self.young) > self.params.types_kept:
            self.young, self.old = {}, self.young
        split = [t.split() for t in texts]
        words = split[0] if len(split) == 1 else list(chain.from_iterable(split))
        found = list(map(self.young.get, words))
        if holes := [i for i, ids in enumerate(found) if ids is None]:
            self._learn({words[i] for i in holes})
            for i in holes:
                found[i] = self.young[words[i]]
        ends = [0, *accumulate(map(len, split))]
        return [b"".join(found[a:b]) + self.end for a, b in pairwise(ends)]

    def encode(self, text: bytes) -> bytes:
        return self.encode_many([text])[0]


def encoder_of(params: Params) -> Encoder:
    """The process's encoder: a worker's later tasks know the words of its earlier ones."""
    return kept(params, lambda: Encoder(params))


def _open(path: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _pieces(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    """Rows (id, text) in lists of about ``size`` bytes of text; a longer text is a list of its own."""
    piece, held = [], 0
    for doc_id, text in rows:
        piece.append((doc_id, text or b""))
        held += len(piece[-1][1])
        if held >= size:
            yield piece
            piece, held = [], 0
    if piece:
        yield piece


def _write_shard(rows: Iterator[tuple], path: str, params: Params, encoder: Encoder) -> tuple[int, int]:
    """Streams ids to a side file first, as the boundaries stand before them; returns (documents, tokens)."""
    fs, where = _open(path)
    fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
    mark = uuid.uuid4().hex[:8]
    body, whole = f"{where}.{mark}.ids", f"{where}.{mark}.tmp"
    doc_ids, ends, total, nulls = array("q"), array("Q"), 0, 0
    with fs.open_output_stream(body) as out:
        for piece in _pieces(rows, params.chars_at_once):
            coded = encoder.encode_many([text for _, text in piece])
            out.write(b"".join(coded))
            for (doc_id, _), ids in zip(piece, coded):
                total += len(ids) // params.width
                ends.append(total)
                if doc_id is None:
                    nulls += 1
                else:
                    doc_ids.append(doc_id)
    least = doc_ids[0] if doc_ids else 0
    end_part = EliasFano.encode(np.frombuffer(ends, np.uint64)).dump()
    id_part = EliasFano.encode((np.frombuffer(doc_ids, np.int64) - np.int64(least)).astype(np.uint64)).dump()
    with fs.open_output_stream(whole) as out, fs.open_input_stream(body) as source:
        out.write(MAGIC + HEADER.pack(len(ends), nulls, total, params.width, least % 2**64, len(end_part), len(id_part), total * params.width))
        out.write(end_part)
        out.write(id_part)
        while piece := source.read(1 << 22):
            out.write(piece)
    fs.delete_file(body)
    fs.move(whole, where)
    return len(ends), total


def write_shards(docs: DataFrame, folder: str, params: Params = Params(), text: str = "text", id_column: str = "doc_id") -> list[tuple[str, int, int]]:
    """Writes the shards; a row (path, documents, tokens) per shard, in document order, comes to the driver."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        rows = ((i, t) for b in batches for p in (b.slice(k, 1000) for k in range(0, b.num_rows, 1000)) for i, t in zip(p.column(0).to_pylist(), p.column(1).cast(pa.large_binary()).to_pylist()))
        first = next(rows, None)
        if first is None:
            return
        path = f"{folder}/shard-{shard:06d}.tok"
        n, tokens = _write_shard((r for part in ([first], rows) for r in part), path, params, encoder_of(params))
        rests(params.rest_s)
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([path]), pa.array([n]), pa.array([tokens])], names=["shard", "path", "documents", "tokens"])
        release()

    # the range keys are two numbers: a sample of them goes to the driver, and texts must not
    text_of = docs[text].cast("string")
    rows = docs.select(docs[id_column].cast("bigint").alias("_id"), text_of.alias("_text"), F.xxhash64(text_of).alias("_hash"))
    dealt = rows.repartitionByRange(params.shards, "_id", "_hash") if params.shards else rows.repartitionByRange("_id", "_hash")
    ordered = dealt.sortWithinPartitions("_id", "_hash", "_text").select("_id", "_text")
    with small_batches(docs.sparkSession, params.batch_bytes):
        made = ordered.mapInArrow(work, "shard bigint, path string, documents bigint, tokens bigint").collect()
    return [(r["path"], r["documents"], r["tokens"]) for r in sorted(made, key=lambda r: r["shard"])]


class Shard:
    """A shard open for reading: ``ids(i)`` are the ids of document i, found by select."""

    def __init__(self, path: str):
        fs, where = _open(path)
        self.file = fs.open_input_file(where)
        if self.file.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no token shard")
        self.documents, self.nulls, self.tokens, self.width, least, a, b, size = HEADER.unpack(self.file.read(HEADER.size))
        self.least = least - 2**64 if least >= 2**63 else least
        self.ends = EliasFano.load(self.file.read(a))
        self._ids = EliasFano.load(self.file.read(b))
        self.body = len(MAGIC) + HEADER.size + a + b
        if size != self.tokens * self.width:
            raise ValueError(f"{path} is cut short")

    def offset(self, i: int) -> int:
        return self.ends.select(i - 1) if i else 0

    def doc_ids(self, a: int, b: int) -> list[int | None]:
        """Of documents a to b - 1; null ids come first."""
        known = self._ids.select_range(max(a - self.nulls, 0), max(b - self.nulls, 0)).astype(np.int64) + np.int64(self.least)
        return [None] * (min(b, self.nulls) - min(a, self.nulls)) + known.tolist()

    def bounds(self, a: int, b: int) -> np.ndarray:
        """Where documents a to b - 1 start, and where the last of them ends."""
        return np.concatenate([[self.offset(a)], self.ends.select_range(a, b).astype(np.int64)])

    def read(self, start: int, end: int) -> np.ndarray:
        self.file.seek(self.body + start * self.width)
        return np.frombuffer(self.file.read((end - start) * self.width), f"<u{self.width}")

    def ids(self, i: int) -> np.ndarray:
        return self.read(self.offset(i), self.ends.select(i))


def read_shards(spark: SparkSession, shards: list[tuple[str, int, int]]) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    out = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not shards:
        return spark.createDataFrame([], out)
    base, rows = 0, []
    for i, (path, _, tokens) in enumerate(shards):
        rows.append((i, path, base))
        base += tokens

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, before in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                s = Shard(path)
                for k in range(0, s.documents, 2000):
                    last = min(k + 2000, s.documents)
                    at = s.bounds(k, last)
                    crc = [zlib.crc32(s.read(x, y).astype("<u4").tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids(k, last), pa.int64()), pa.array(at[:-1] + before), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
        release()

    names = spark.createDataFrame(rows, "shard int, path string, base bigint")
    return names.repartitionByRange(len(rows), "shard").mapInArrow(work, out)


def encode_table(docs: DataFrame, params: Params = Params(), text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Writes the shards of documents in the shared folder and reads them back."""
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, new_folder(spark, "tokens"), params, text, id_column))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op2_token_ids": op2_token_ids}
SQL: dict[str, str] = {}
