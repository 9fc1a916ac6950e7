import random
import re

import pytest

from provenant.llm import neardup

from .cases import DOCS, documents, frame, odd_columns, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return s.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute(rows, size):
    sets = []
    for r in rows:
        ws = WORD.findall(lower(r[1] or ""))
        sets.append({tuple(ws[i:i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
    big = 1 << 62
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), big), big if r[0] is None else r[0])
    out = set()
    for i, r in enumerate(rows):
        c = least[root(i)]
        c = None if c == big else c
        c = c if sets[i] else r[0]
        out.add((r[0], len(sets[i]), c, r[0] == c))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_groups_match_brute_force(spark, size):
    rows = documents()
    got = {tuple(r) for r in neardup.find_groups(frame(spark, rows), neardup.Params(shingle=size)).collect()}
    assert got == brute(rows, size)


def test_families_below_the_threshold_are_settled(spark):
    """Variants of one text, many of them linked only through a few others: buckets stay open after the first round."""
    rng = random.Random(5)
    base, rows = prose(rng, 150, 5000).split(), []
    for k in range(150):
        other = list(base)
        for _ in range(rng.randrange(3, 16)):
            other[rng.randrange(len(other))] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - k, " ".join(other), "en", "s", 1))
    params = neardup.Params(shingle=2, block=16)
    got = {tuple(r) for r in neardup.find_groups(frame(spark, rows), params).collect()}
    assert got == brute(rows, 2)


def test_least_matches_bounds():
    assert neardup.least_matches(48, 0.8, 1e-5) < 0.8 * 48
    assert neardup.least_matches(240, 0.8, 1e-5) > 0.6 * 240
    assert neardup.least_matches(240, 0.8, 1e-5) < neardup.least_matches(240, 0.8, 1e-2)


def test_signatures_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    p = neardup.Params(bands=100, rows=10)
    errors = []
    for _ in range(30):
        x = rng.integers(0, 2**63, 600, dtype=np.uint64)
        a, b = np.unique(x[:500]), np.unique(x[50:550])
        sa, sb = (np.frombuffer(neardup.signature(s, p), "<u4") for s in (a, b))
        errors.append((sa == sb).mean() - 450 / 550)
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.03


def test_keep_one(spark):
    df = odd_columns(frame(spark, documents()))
    kept = neardup.keep_one(df)
    assert kept.dtypes == df.dtypes
    want = sorted(r[0] if r[0] is not None else -1 for r in brute(documents(), 5) if r[3])
    assert sorted({r.doc_id if r.doc_id is not None else -1 for r in kept.collect()}) == sorted(set(want))


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert neardup.find_groups(df).count() == 0 and neardup.keep_one(df).count() == 0


def test_components(spark):
    from provenant.llm.common import Tables, components

    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long"), Tables(spark, "t")).collect()}
    label = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in range(300):
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_components_by_shuffles_and_in_one_task_agree(spark):
    from provenant.llm.common import Tables, components, joined_components

    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(k, k + 1) for k in range(1000, 1040)] + [(7, 7)]
    more = [(rng.randrange(400), rng.randrange(400)) for _ in range(60)]
    tables, made = Tables(spark, "t"), {}
    for few in (0, 10**6):
        labels = components(spark.createDataFrame(links, "a long, b long"), tables, few)
        both = joined_components(labels, tables.put(spark.createDataFrame(more, "a long, b long")), tables, few)
        made[few] = [sorted(map(tuple, x.collect())) for x in (labels, both)]
    assert made[0] == made[10**6]
    whole = components(spark.createDataFrame(links + more, "a long, b long"), tables)
    assert sorted(map(tuple, whole.collect())) == made[0][1]
