import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provenant.llm import common, tokens
from provenant.llm.common import new_folder

from .cases import DOCS, documents, frame, odd_columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=700))
def test_elias_fano_round_trip(values):
    values.sort()
    e = tokens.EliasFano.load(tokens.EliasFano.encode(np.array(values, np.uint64)).dump())
    n = len(values)
    assert e.select_range(0, n).tolist() == values
    assert all(e.select_range(a, b).tolist() == values[a:b] for a in range(0, n + 1, max(1, n // 9)) for b in range(a, n + 1, max(1, n // 7)))
    assert [e.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        e.select(len(values))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 100_000))
    bits = 8 * len(tokens.EliasFano.encode(values).dump()) / len(values)
    assert bits < 2 + np.log2(values[-1] / len(values)) + 1


def whole(text):
    from tokenizers import Tokenizer

    t = whole.tokenizer = getattr(whole, "tokenizer", None) or Tokenizer.from_file(tokens.Params().file())
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


ODD = ["a\u0301b c\u0301", "x \u0301y", "it's we're I'll", "é\x0bÉ\x0cß", "1 23\t456", "a\x1cb\u2003c\x85d", "<|endoftext|> x<|startoftext|>y", "ΣΑΣ σας", "日本語 текст", "\ud7ff🙂👍🏽 ok", "İstanbul ǅ", "  lead", "trail  ", "a\u00a0b"]


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_words_one_by_one_give_the_ids_of_the_whole(text):
    e = tokens.Encoder(tokens.Params())
    data = text.encode("utf-8", "ignore")
    assert np.frombuffer(e.encode(data), "<u2").tolist() == whole(data.decode())


def test_odd_texts():
    e = tokens.Encoder(tokens.Params())
    for t in ODD:
        assert np.frombuffer(e.encode(t.encode()), "<u2").tolist() == whole(t), t


def expected(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())
    out, start = [], 0
    for r in sorted(rows, key=key):
        ids = whole(r[1])
        out.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shards", [1, 5, None])
def test_round_trip(spark, shards):
    rows = [*documents(), (5000, ODD[0], "en", "s", 1), (-7, "negative id", "en", "s", 1)]
    got = tokens.encode_table(odd_columns(frame(spark, rows)), tokens.Params(shards=shards)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(rows)


def test_random_access_and_width(spark):
    rows = documents(n=20)
    folder = new_folder(spark, "t")
    for width in (2, 4):
        made = tokens.write_shards(frame(spark, rows), f"{folder}/{width}", tokens.Params(shards=1, width=width))
        s = tokens.Shard(made[0][0])
        assert s.documents == len(rows) and s.doc_ids(0, s.documents)[0] is None
        key = lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())
        for i, r in enumerate(sorted(rows, key=key)):
            assert s.ids(i).tolist() == whole(r[1])


def test_damage_is_seen(spark):
    folder = new_folder(spark, "t")
    path = tokens.write_shards(frame(spark, documents(n=5)), folder, tokens.Params(shards=1))[0][0].removeprefix("file://")
    data = open(path, "rb").read()
    open(path, "wb").write(b"XXXX" + data[4:])
    with pytest.raises(ValueError):
        tokens.Shard(path)


def test_empty(spark):
    assert tokens.encode_table(spark.createDataFrame([], DOCS)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abzA\u00c9\u00dc\u00df\u00e0\u00e9\u00ed\u00f1\u00f6\u00f7\u00d7\u00ff\u0301'.,&<|9", min_size=1, max_size=8), max_size=12))
def test_small_letters_of_latin_1_give_the_ids_of_the_whole(words):
    text = " ".join(words)
    e = tokens.Encoder(tokens.Params(types_kept=3))
    for _ in range(2):
        assert np.frombuffer(e.encode(text.encode()), "<u2").tolist() == whole(text)


def test_words_of_letters_go_to_the_model_itself():
    e, other = tokens.Encoder(tokens.Params()), []
    e._other = lambda words, own=e._other: (other.extend(words), own(words))[1]
    words = ["garçon", "für", "straße", "mañana,", "à", "él.", "aquí", "ÿ", "Plain", "x÷y", "œuf", "e\u0301t"]
    assert np.frombuffer(e.encode(" ".join(words).encode()), "<u2").tolist() == whole(" ".join(words))
    assert sorted(w.decode() for w in other) == sorted([",", ".", "x÷y", "œuf", "e\u0301t"])


def test_an_encoder_goes_when_the_worker_turns_to_something_else():
    params = tokens.Params()
    e = tokens.encoder_of(params)
    assert tokens.encoder_of(params) is e
    common.rests(3600)
    common.let_go()
    assert not common._KEPT and not common._IDLE
    assert tokens.encoder_of(params) is not e
    assert common.kept("other", dict) == {} and list(common._KEPT) == ["other"]
    common.let_go()


def test_texts_reach_python_in_batches_of_bounded_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    df = spark.range(0, 600, 1, 1).selectExpr("repeat('x', 1000) as t")
    before = spark.conf.get(common.BATCH_BYTES)
    with common.small_batches(spark, 100_000):
        rows = [r.n for r in df.mapInArrow(sizes, "n bigint").collect()]
    assert sum(rows) == 600 and max(rows) <= 110
    assert spark.conf.get(common.BATCH_BYTES) == before
    with common.small_batches(spark, 2**40):
        assert spark.conf.get(common.BATCH_BYTES) == before
