import re

import pytest

from provenant.llm import quality

from .cases import DOCS, documents, frame, odd_columns

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(ws) - 4):
        windows.setdefault(tuple(ws[i:i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_base_counts_match_brute_force(spark):
    rows = documents()
    rows += [(900, "a b c d e f\n" * 5 + "é ñ ü\n\n \n é ñ ü", "fr", "s", 1), (901, "x\x1cy z w v u " * 3, "fr", "s", 1)]
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(frame(spark, rows)).collect()}
    assert got == {(r[0], *brute(r[1])) for r in rows}


def test_verdicts(spark):
    rows = {r.doc_id: r for r in quality.judge(frame(spark, documents())).collect()}
    assert not rows[80].kept and rows[80].base_failed  # null
    assert not rows[83].kept  # one word
    assert all(r.kept <= (not r.base_failed) for r in rows.values())


def test_fertility_rejects_noise_and_keeps_prose(spark):
    import random

    rng = random.Random(1)
    noise = " ".join("".join(chr(rng.randrange(0x1F300, 0x1F5FF)) for _ in range(6)) for _ in range(60))
    prose = "The river ran past the old mill and the children went down to the water to look for fish in the evening light " * 1 + "while their mother read a long letter from her brother who had moved to the city and worked in a large library there every day."
    prose += " He wrote that the streets were loud and that he missed the quiet hills and the smell of wet grass after rain in spring."
    out = {r.doc_id: r for r in quality.judge(frame(spark, [(1, noise, "en", "s", 1), (2, prose, "en", "s", 1)])).collect()}
    assert out[1].byte_share > 0.5 and not out[1].kept
    assert out[2].kept and 3 < out[2].chars_per_token < 6


def test_filter_keeps_columns_and_agrees_with_verdicts(spark):
    df = odd_columns(frame(spark, documents()))
    kept = quality.keep_good(df)
    assert kept.dtypes == df.dtypes
    want = sorted((r.doc_id or -1) for r in quality.judge(frame(spark, documents())).collect() if r.kept)
    assert sorted((r.doc_id or -1) for r in kept.collect()) == want


@pytest.mark.parametrize("n", [0, 1])
def test_empty(spark, n):
    df = spark.createDataFrame([], DOCS)
    assert (quality.judge(df) if n else quality.keep_good(df)).count() == 0


def test_types_may_be_forgotten(spark):
    df = frame(spark, documents())
    small = quality.Rules(types_kept=10, words_at_once=300)
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_words)
    assert sorted(quality.judge(df, small).collect(), key=key) == sorted(quality.judge(df).collect(), key=key)


def figures(text):
    """Characters per token of both vocabularies, byte share and entropy, word by word."""
    import base64
    import math
    from collections import Counter

    import public_tokenizers as P
    import sentencepiece
    import tiktoken

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    tk = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ws = WORD.findall(text or "")
    ids, more, chars = [i for w in ws for i in sp.encode(w)], sum(len(tk.encode_ordinary(" " + w)) for w in ws), sum(map(len, ws))
    n, counts = len(ids), Counter(ids)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
    return n, chars / max(n, 1), chars / max(more, 1), sum(map(sp.is_byte, ids)) / max(n, 1), entropy


def test_fertility_matches_brute_force(spark):
    rows = [r for r in documents(n=25) if r[1] is None or len(r[1]) < 5000]
    rows += [(900, "smör 😀😀 naïve 漢字 слово abc", "fr", "s", 1), (901, "\u0300x y", "fr", "s", 1)]
    want = {r[0]: figures(r[1]) for r in rows}
    for r in quality.judge(frame(spark, rows)).collect():
        got = (r.n_tokens, r.chars_per_token, r.chars_per_byte_token, r.byte_share, r.token_entropy)
        assert got == pytest.approx(want[r.doc_id], abs=1e-9), r.doc_id


def test_bands_are_those_of_the_quantiles(spark):
    import numpy as np

    rules = quality.Rules(enough=5)
    measured = quality._measured(frame(spark, documents(n=60)), rules, "text", "lang", ["doc_id"])
    rows, seen = [], set()
    for r in measured.where("not base_failed").collect():
        if r["_hash"] not in seen:
            seen.add(r["_hash"])
            rows.append(r)
    bands = {(b["of"], b.length): b for b in quality.measured_bands(measured, rules).collect()}
    assert bands
    for (of, length), b in bands.items():
        kind, value = of.split()
        own = [r for r in rows if (r["_lang"] if kind == "language" else r.script) == value and int(np.log2(r.n_tokens)) == length]
        assert len(own) >= 5
        for m in quality.SIDES:
            x = sorted(r[m] for r in own)
            q = [x[max(0, int(np.ceil(p * len(x))) - 1)] for p in (0.05, 0.5, 0.95)]
            low = q[1] - rules.reach * max((q[1] - q[0]) / 1.6448536269514722, rules.floors[m])
            high = q[1] + rules.reach * max((q[2] - q[1]) / 1.6448536269514722, rules.floors[m])
            assert (b[f"low_{m}"], b[f"high_{m}"]) == pytest.approx((low, high), abs=1e-9)


def test_fertility_decides_on_a_whole_table(spark):
    """At sf0.1 the bands reject words strung with symbols, in three languages, and next to nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = quality.judge(docs).where("not base_failed and not kept").select("doc_id").join(docs, "doc_id").collect()
    soup = [r for r in out if all(x in r.text for x in ("###", "$$$", "&&&"))]
    assert 20 <= len(soup) and len(out) - len(soup) <= 5


def test_memory_follows_the_piece_and_not_the_batch():
    import tracemalloc

    import pyarrow as pa

    rules, peaks = quality.Rules(words_at_once=20_000), []
    types = quality.Types(rules)
    for n in (2_000, 20_000):
        texts = pa.array([f"{i % 7} some words of a text that is repeated " * 50 for i in range(n)])
        tracemalloc.start()
        assert len(quality._metrics(texts, types, rules)) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


def test_a_text_goes_to_python_once(spark):
    df = frame(spark, documents(n=5))
    sent, at = quality._sent(df, "text", "lang", df.columns)
    assert len(sent.columns) == len(df.columns) + 2 and sent.columns[at] == f"_{2 + df.columns.index('text')}"
    sent, at = quality._sent(df, "text", "lang", ["doc_id"])
    assert sent.columns == ["_hash", "_lang", "_2", "_0"] and at == 3
    sent, at = quality._sent(df.withColumn("text", df.text.cast("binary")), "text", None, df.columns)
    assert sent.columns[at] == "_0" and dict(sent.dtypes)["_0"] == "string"
