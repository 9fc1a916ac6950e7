import random
from collections import Counter

from provenant.llm import decontaminate as D

from .cases import DOCS, documents, frame, odd_columns, prose

ITEMS = "item_id long, text string"


def brute(docs, items, params=D.Params()):
    """All windows aligned with an item at a shared shingle, without fingerprints."""
    out = {}
    for doc_id, text in docs:
        ws = (text or "").lower().split()
        for item_id, item in items:
            iw = (item or "").lower().split()
            if not iw:
                continue
            k = min(params.shingle, len(iw))
            run = lambda w: [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]  # noqa: E731, B023
            place = {}
            for q, s in enumerate(run(iw)):
                place.setdefault(s, []).append(q)
            for p, s in enumerate(run(ws)):
                for q in place.get(s, ()):
                    start = max(0, min(p - q, len(ws) - len(iw)))
                    a, b = Counter(run(ws[start:start + len(iw)])), Counter(run(iw))
                    similarity = sum((a & b).values()) / sum((a | b).values())
                    if similarity >= params.similarity:
                        best = out.get((doc_id, text, item_id))
                        if best is None or (-similarity, start) < best:
                            out[doc_id, text, item_id] = (-similarity, start)
    return {(d, i, s, round(-v, 9)) for (d, _, i), (v, s) in out.items()}


def cases():
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randrange(10, 50), 3000)) for i in range(30)] + [(100, None), (101, ""), (102, "rare pair"), (103, items_repeat(rng))]
    docs = [(r[0], r[1]) for r in documents()]
    for n, (i, t) in enumerate(items[:30]):
        w = t.split()
        w = w if n % 3 == 0 else w[:-1] if n % 3 == 1 else [*w[: len(w) - 1], "changed"]
        docs.append((1000 + i, f"{prose(rng, 40)} {' '.join(w).upper() if n % 2 else ' '.join(w)} {prose(rng, 25)}"))
    docs += [(2000, "rare pair"), (2001, items[0][1]), (2002, items[0][1] + " " + items[0][1]), (2002, items[0][1]), (None, items[1][1])]
    return docs, items


def items_repeat(rng):
    return "a b c d e f " * 4


def test_hits_match_brute_force(spark):
    docs, items = cases()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.start, round(r.similarity, 9)) for r in D.find_contamination(df, spark.createDataFrame(items, ITEMS)).collect()}
    assert got == brute(docs, items)
    assert len(got) > 25


def test_index_finds_every_fingerprint_within_the_radius(spark):
    """With similarity 0 the pairs are those of equal size within the radius, of all windows cut."""
    docs, items = cases()
    p = D.Params(similarity=0.0)
    texts = spark.createDataFrame(docs, "doc_id long, text string").where("text is not null").selectExpr("sha2(text, 256) tk", "text").dropDuplicates(["tk"])
    index = D.Index(spark.createDataFrame(items, ITEMS), p)
    w = index.windows(texts).withColumn("wfp", D.simhash("window"))
    every = w.join(index.items, "n").selectExpr("tk", "start", "n", "item_id", "bit_count(wfp ^ ifp) d").where(f"d <= {p.radius}")
    key = lambda r: (r.tk, r.start, r.n, r.item_id)
    assert {key(r) for r in index.pairs(texts).collect()} == {key(r) for r in every.collect()}


def test_large_benchmarks_are_shuffled(spark):
    docs, items = cases()
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    few = D.find_contamination(df, it, D.Params(broadcast_rows=0, bloom_bits=1024))
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in D.find_contamination(df, it).collect()}


def test_drop(spark):
    docs, items = cases()
    df = odd_columns(frame(spark, [(a, b, "en", "s", 1) for a, b in docs]))
    kept = D.drop_contaminated(df, spark.createDataFrame(items, ITEMS))
    bad = {(r.doc_id, r.text) for r in df.collect()} - {(r.doc_id, r.text) for r in kept.collect()}
    assert kept.dtypes == df.dtypes
    texts = {(d, t) for d, t in docs if brute([(d, t)], items)}
    assert bad == texts


def test_empty(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b c d e f g")], ITEMS)
    docs = frame(spark, documents())
    assert D.find_contamination(none, items).count() == 0 and D.drop_contaminated(none, items).count() == 0
    nothing = spark.createDataFrame([], ITEMS)
    assert D.find_contamination(docs, nothing).count() == 0 and D.drop_contaminated(docs, nothing).count() == docs.count()


def test_no_python_in_the_plan(spark):
    docs, items = cases()
    df = D.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
