import random

import numpy as np
import pyarrow as pa
import pytest

from provenant.llm import substring as S

from .cases import DOCS, documents, frame, odd_columns, prose


def brute_windows(tok, doc, t, seed):
    value = S.mix64(tok ^ S.mix64(np.array([seed], np.uint64))[0])
    key = [((int(v) >> 32) << 32) | i for i, v in enumerate(value)]
    out = set()
    for c in range(len(tok)):
        a = b = c
        while a and doc[a - 1] == doc[c] and key[a - 1] > key[c]:
            a -= 1
        while b < len(tok) - 1 and doc[b + 1] == doc[c] and key[b + 1] > key[c]:
            b += 1
        if b - a + 1 >= t:
            out.add((c, a, b))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_compact_windows(seed):
    rng = np.random.default_rng(seed)
    n, t = int(rng.integers(0, 90)), int(rng.integers(2, 12))
    tok, doc = rng.integers(0, 25 if seed % 2 else 10**9, n).astype(np.uint64), np.sort(rng.integers(0, 3, n))
    _, c, l, r = S.compact_windows(tok, doc, t, seed)  # noqa: E741
    assert set(zip(c.tolist(), l.tolist(), r.tolist())) == brute_windows(tok, doc, t, seed)
    # every passage of t tokens lies in the range of its least token
    for i in range(n - t + 1):
        if doc[i] == doc[i + t - 1]:
            assert sum(a <= i <= x <= i + t - 1 <= b for x, a, b in zip(c, l, r)) == 1


def near(a, b, p):
    """Passages of a with a near duplicate in b, by comparing all pairs of passages of t tokens as sets."""
    w = {}
    x, y = (S.tokens(t.encode(), p.shingle).tolist() for t in (a, b))
    del w
    sx = [set(x[i:i + p.t]) for i in range(len(x) - p.t + 1)]
    sy = [set(y[i:i + p.t]) for i in range(len(y) - p.t + 1)]
    covered = set()
    for i, s in enumerate(sx):
        if any(len(s & u) >= p.similarity * len(s | u) for u in sy):
            covered.update(range(i, i + p.words))
    return covered


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(8)
    p = S.Params()
    rows, planted = [], set()
    passages = [prose(rng, 60 + 10 * k, 10**6).split() for k in range(6)]
    for i in range(120):
        body = prose(rng, rng.randrange(60, 250), 10**6).split()
        if i % 4 == 0:
            q = list(passages[(i // 4) % 6])
            if i % 8 == 0:
                q[len(q) // 2] = f"y{i}"  # a near copy
            body[20:20] = q
            planted.add(i)
        rows.append((i, " ".join(body), "en", "s", 1))
    out = S.find_passages(odd_columns(frame(spark, rows))).collect()
    named = {r.doc_id for r in out} | {i for r in out for i in r.of_doc_ids}
    assert all(r.of_doc_id in r.of_doc_ids for r in out)
    assert named == planted
    text = {r[0]: r[1] for r in rows}
    for r in out:
        assert near(text[r.doc_id], text[r.of_doc_id], p) & set(range(r.start, r.start + r.n_words))
        assert r.n_words >= p.words and r.similarity >= p.similarity
    # recall of documents against brute force over the planted ones: all but the originals
    assert len({r.doc_id for r in out}) == len(planted) - 6


def test_copies_and_odd_rows(spark):
    rows = documents(n=40)
    out = S.find_passages(frame(spark, rows)).collect()
    text = {}
    for r in rows:
        text.setdefault(r[0], r[1])
    assert any(r.doc_id == 65 and r.of_doc_id == 5 and r.similarity == 1.0 for r in out) or len(text[5].split()) < 50
    assert not {60, 61, 62, 63, 64} & {r.doc_id for r in out}
    assert {50, 51, 52, 53} <= {r.doc_id for r in out} | {r.of_doc_id for r in out}


def test_empty(spark):
    assert S.find_passages(spark.createDataFrame([], DOCS)).count() == 0
    assert S.find_passages(frame(spark, [(1, "too short", "en", "s", 1)])).count() == 0


def family(rng, line=""):
    """A passage and copies of it with one word changed at different places: near the passage, not near one another."""
    base = (prose(rng, 25, 10**6) + " " + line + " " + prose(rng, 25, 10**6)).split()
    out = [base]
    for at in rng.sample([k for k in range(5, len(base) - 5) if not 20 <= k < 30 + len(line.split())], 8):
        q = list(base)
        q[at] = f"z{rng.randrange(10**9)}"
        out.append(q)
    return out


@pytest.mark.parametrize("line", ["", "all rights reserved by the owners of this fine page"])
def test_variants_and_a_frequent_line(spark, line):
    rng = random.Random(5)
    p, texts = S.Params(), []
    for _ in range(10):
        texts += [" ".join([prose(rng, 60, 10**6), *q, prose(rng, 60, 10**6)]) for q in family(rng, line)]
    texts += [f"{prose(rng, 70, 10**6)} {line} {prose(rng, 70, 10**6)}" for _ in range(200)]
    near_docs = {i for f in range(10) for i in range(9 * f, 9 * f + 9) if any(near(texts[i], texts[k], p) for k in range(9 * f, 9 * f + 9) if k != i)}
    out = S.find_passages(frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()
    named = {r.doc_id for r in out} | {i for r in out for i in r.of_doc_ids}
    assert named <= near_docs
    assert len(near_docs - named) <= 0.02 * len(near_docs)


def test_results_do_not_depend_on_pieces_or_partitions(spark):
    rng = random.Random(12)
    line, rows = "all rights reserved by the owners of this fine page", []
    for k in range(12):
        q = f"{prose(rng, 30, 10**6)} {line} {prose(rng, 30, 10**6)}"
        rows += [(k + 100 * n, f"{prose(rng, 40, 10**6)} {q} {prose(rng, 40, 10**6)}", "en", "s", 1) for n in range(2)]
    df = frame(spark, rows + documents(n=40))
    key = lambda r: (str(r.doc_id), r.start, r.n_words, str(r.of_doc_id), r.of_start, round(r.similarity, 9), tuple(map(str, r.of_doc_ids)), str(r.originals))
    a, b, c = (sorted(map(key, S.find_passages(x, p).collect())) for x, p in ((df.coalesce(1), S.Params()), (df.coalesce(1), S.Params(words_at_once=100)), (df.repartition(211), S.Params())))
    assert a == b == c


def named_by(spark, texts, partitions=4):
    out = S.find_passages(frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]).repartition(partitions)).collect()
    return out, {r.doc_id for r in out} | {i for r in out for i in r.of_doc_ids}


def test_exact_passages_of_mostly_common_words(spark):
    """80 pairs share a passage of 55 words, 40 of which stand in 60 other texts too."""
    rng = random.Random(3)
    common = prose(rng, 40, 10**6)
    texts = [f"{prose(rng, 60, 10**6)} {common} {prose(rng, 60, 10**6)}" for _ in range(60)]
    for _ in range(80):
        passage = f"{prose(rng, 8, 10**6)} {common} {prose(rng, 7, 10**6)}"
        texts += [f"{prose(rng, 60, 10**6)} {passage} {prose(rng, 60, 10**6)}" for _ in range(2)]
    _, named = named_by(spark, texts)
    assert named == set(range(60, 220))


def test_every_variant_of_a_passage_is_named(spark):
    """60 families of a base passage and five variants with one other word, each near the base alone."""
    rng = random.Random(4)
    p, texts = S.Params(), []
    for _ in range(60):
        base = prose(rng, 60, 10**6).split()
        for k in range(6):
            q = list(base)
            if k:
                q[5 + 9 * k] = f"v{rng.randrange(10**9)}"
            texts.append(" ".join([prose(rng, 50, 10**6), *q, prose(rng, 50, 10**6)]))
    near_docs = {i for f in range(60) for i in range(6 * f, 6 * f + 6) if any(near(texts[i], texts[k], p) for k in range(6 * f, 6 * f + 6) if k != i)}
    out, named = named_by(spark, texts)
    assert named <= near_docs and len(named) >= 0.95 * len(near_docs)
    from provenant.llm.common import smallest_in_component

    links = np.array([(r.doc_id, i) for r in out for i in r.of_doc_ids])
    of = dict(zip(*(x.tolist() for x in smallest_in_component(links[:, 0], links[:, 1]))))
    pairs = [(a, 6 * f) for f in range(60) for a in range(6 * f + 1, 6 * f + 6) if near(texts[a], texts[6 * f], p)]
    joined = [a for a, b in pairs if a in of and of[a] == of.get(b)]
    assert len(joined) >= 0.95 * len(pairs), (len(joined), len(pairs))


def test_cells_match_brute_force():
    rng = np.random.default_rng(1)
    p = S.Params(words=12, shingle=3, hashes=3)
    texts = [(k, prose(random.Random(k), int(rng.integers(5, 80)), 30).encode()) for k in range(12)]
    value, text, span, around, _ = (c.to_numpy(zero_copy_only=False) for c in S._piece(texts, p))
    order = np.lexsort((span, text))
    key, kind, of, cell = S.cells(text[order], span[order], value[order], around[order], p.hashes)
    got = {}
    for k, t, s in zip(key.tolist(), of.tolist(), cell.tolist()):
        c, first, last, _ = S._unpack(np.int64(s))
        for at in range(first, last + 1):
            got.setdefault((t, at), set()).add(k)
    for k, t in texts:
        tok = S.tokens(t, p.shingle)
        for at in range(len(tok) - p.t + 1):
            assert len(got[(k, at)]) == 3  # every passage lies in one cell of each two functions
    same = {}
    for q, t, s in zip(kind.tolist(), of.tolist(), cell.tolist()):
        c, first, last, _ = S._unpack(np.int64(s))
        same.setdefault(q, set()).add(tuple(S.tokens(dict(texts)[t], p.shingle)[first:last + p.t].tolist()))
    assert all(len(v) == 1 for v in same.values())  # a class has the same tokens


def test_a_passage_near_two_families_links_both(spark):
    """60 passages with one word changed in four texts, another word in three, and unchanged in one: that one is near both kinds,
    which are not near each other, and both have links of their own without it."""
    from provenant.llm.common import smallest_in_component

    rng = random.Random(21)
    p, texts = S.Params(), []
    for _ in range(60):
        base = prose(rng, 54, 10**6).split()
        q, r = list(base), list(base)
        q[18], r[36] = f"q{rng.randrange(10**9)}", f"r{rng.randrange(10**9)}"
        assert near(" ".join(base), " ".join(q), p) and near(" ".join(base), " ".join(r), p) and not near(" ".join(q), " ".join(r), p)
        texts += [" ".join([prose(rng, 50, 10**6), *x, prose(rng, 50, 10**6)]) for x in [q] * 4 + [r] * 3 + [base]]
    out, _ = named_by(spark, texts)
    links = np.array([(r.doc_id, i) for r in out for i in r.of_doc_ids])
    of = dict(zip(*(x.tolist() for x in smallest_in_component(links[:, 0], links[:, 1]))))
    joined = sum(of.get(8 * f + 7) == of[8 * f] == of[8 * f + 4] for f in range(60))
    assert joined >= 59, joined


def test_classes_hold_all_near_documents_together(spark):
    rng = random.Random(22)
    p, texts = S.Params(), []
    line = prose(rng, 30, 10**6)  # shared by all, too short to repeat
    for _ in range(12):
        base = f"{prose(rng, 40, 10**6)} {line} {prose(rng, 30, 10**6)}".split()
        for k in range(7):
            q = list(base)
            if k:
                q[3 + 5 * k] = f"v{rng.randrange(10**9)}"
            texts.append(" ".join([prose(rng, 30, 10**6), *q, prose(rng, 30, 10**6)]))
    out, named = named_by(spark, texts)
    classes = {}
    for r in out:
        for i in (r.doc_id, *r.of_doc_ids):
            classes.setdefault(i, set()).add(r.class_id)
    pairs = [(i, k) for i in range(len(texts)) for k in range(i) if i // 7 == k // 7 and near(texts[i], texts[k], p)]
    assert sum(bool(classes.get(i, set()) & classes.get(k, set())) for i, k in pairs) >= 0.98 * len(pairs)
    assert all(len({i // 7 for i, c in classes.items() if k in c}) == 1 for k in {r.class_id for r in out})


def test_pairs_of_a_large_group_are_fewer_than_its_rows():
    """A word repeated with others between: all rows of a group of 400 are near one another."""
    rng = np.random.default_rng(3)
    p = S.Params()
    near_ = rng.integers(1, 2**32, 2 * p.t - 1).astype("<u4")[None, :].repeat(400, 0)
    near_[np.arange(400), rng.integers(0, 2 * p.t - 1, 400)] = rng.integers(1, 2**32, 400)
    alone = rng.integers(1, 2**32, (50, 2 * p.t - 1)).astype("<u4")
    alone[:, 30:60] = near_[0, 30:60]  # a common line
    rows = np.concatenate([near_, alone])
    x, y = S.meet(np.zeros(450, np.int64), np.arange(450), rows, p)
    assert len(x) == 399 and x.max() < 400 and (x > y).all()


def test_keys_dealt_into_blocks_join_the_same(spark):
    rng = random.Random(23)
    texts = []
    for _ in range(4):
        base = prose(rng, 70, 10**6).split()
        for k in range(24):
            q = list(base)
            q[k % 12] = f"v{rng.randrange(10**9)}"
            texts.append(" ".join([prose(rng, 30, 10**6), *q, prose(rng, 30, 10**6)]))
    df = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    made = []
    for block in (8192, 7):
        classes = {}
        for r in S.find_passages(df, S.Params(block=block)).collect():
            classes.setdefault(r.class_id, set()).update((r.doc_id, *r.of_doc_ids))
        made.append(sorted(map(sorted, classes.values())))
    assert made[0] == made[1] == [list(range(24 * f, 24 * f + 24)) for f in range(4)]


def test_a_task_makes_one_row_of_a_bucket():
    """All kinds of a bucket are one row, so that rows between the steps are tasks times buckets at most; nothing of it is lost."""
    rng = np.random.default_rng(5)
    by = lambda n: rng.integers(-2**62, 2**62, n)
    made = [(kind, by(n), rng.integers(0, 2**40, (n, width))) for kind, n, width in ((S.REPEAT, 3000, 5), (S.PAIR, 2000, 4), (S.ASKED, 7, 4), (S.PAIR, 100, 4))]
    heads = rng.integers(0, 2**40, (300, 5))
    heads[:, 4] = rng.integers(0, 20, 300)
    total = int(heads[:, 4].sum())
    places, toks = rng.integers(0, 9999, total).astype("<i4"), rng.integers(0, 2**63, total).astype("<u8")
    made.append((S.PART, by(300), heads, places, toks))
    batches = list(S._blobs(iter(made), 16))
    assert sum(b.num_rows for b in batches) == 16
    got = {b: held for b, held in zip(range(16), S._by_bucket(iter(batches)))}
    for kind, width in ((S.REPEAT, 5), (S.PAIR, 4), (S.ASKED, 4)):
        where, rows = (np.concatenate(c) for c in zip(*[m[1:] for m in made if m[0] == kind]))
        for b, held in got.items():
            assert sorted(S._matrix(held, kind, width).tolist()) == sorted(rows[np.mod(where, 16) == b].tolist())
    ends = np.cumsum(heads[:, 4])
    for b, held in got.items():
        mine = np.flatnonzero(np.mod(made[-1][1], 16) == b)
        pick = np.concatenate([np.arange(ends[i] - heads[i, 4], ends[i]) for i in mine]) if len(mine) else np.empty(0, int)
        assert np.array_equal(S._matrix(held, S.PART, 5), heads[mine])
        assert S._bytes(held, S.PLACES) == places[pick].tobytes() and S._bytes(held, S.TOKENS) == toks[pick].tobytes()


def test_rows_between_steps_do_not_follow_the_size_of_a_group(spark):
    """Near copies of one passage, 40 and 160 of them: a step makes a row for each task and bucket at most."""
    from pyspark.sql import functions as F

    rng, p = random.Random(31), S.Params(few=1)
    base = prose(rng, 70, 10**6).split()
    for n in (40, 160):
        texts = []
        for k in range(n):
            q = list(base)
            q[k % 60] = f"v{k}"
            texts.append((k, " ".join([prose(rng, 20, 10**6), *q]).encode()))
        df = spark.createDataFrame(texts, "key long, text binary").repartition(4)
        made = {}
        made["shared"] = S._shared(S._ranges(df, p), p)
        made["cells"] = S._cells(made["shared"], p)
        made["groups"] = S._groups(made["cells"], p).persist()
        made["crossing"] = S._crossing(S._near(S._only(made["groups"], S.ASKED), df, p), p)
        for step, blobs in made.items():
            rows = blobs.groupBy(F.spark_partition_id(), "bucket").count().collect()
            assert rows and max(r["count"] for r in rows) == 1, step
        made["groups"].unpersist()


def test_buckets_are_dealt_evenly(spark):
    from pyspark.sql import functions as F

    n = S._buckets(spark)
    blobs = next(S._blobs(iter([(S.CELL, np.arange(n), np.arange(n)[:, None])]), n))
    df = spark.createDataFrame(blobs.to_pandas().replace({np.nan: None}), S.BLOBS)

    def work(batches):
        for held in S._by_bucket(batches):
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[0].as_py() for b in held], pa.int64())], names=["bucket"])

    found = S._gathered(df, work, "bucket long").groupBy(F.spark_partition_id()).count().collect()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(found) == parts and {r["count"] for r in found} == {n // parts}


def test_a_task_sends_a_text_once(spark):
    """500 copies of a text in four pieces are four rows beside the others."""
    texts = spark.createDataFrame([(7 if k % 2 else k + 100, "a b c" if k % 2 else f"t{k}") for k in range(1000)], "key long, text string").repartition(4)
    asked = spark.createDataFrame([], S.BLOBS)
    rows = S._with_texts(asked, texts).select("name", "text").collect()
    assert len(rows) <= 504 and len({r.name for r in rows}) == 501
    assert all(bytes(r.text) == (b"a b c" if r.name == 7 else b"t%d" % (r.name - 100)) for r in rows)
