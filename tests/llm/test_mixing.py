from provenant.llm import mixing

from .cases import DOCS, documents, frame, odd_columns


def water(sizes, weights=(5, 2, 1), cap=3):
    """Targets by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        left, among = total - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if left * w[s] > cap * sizes[s] * among]
        if not over:
            return fixed | {s: left * w[s] / among for s in free}
        fixed |= {s: float(cap * sizes[s]) for s in over}


def check(rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    want = water({s: sum(r.size for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert {round(r.target, 6) for r in rs} == {round(want[s], 6)}
        assert all(r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in rs)
        times = {r.taken // r.size for r in rs if r.size}
        assert not times or max(times) - min(times) <= 1
        largest = max(r.size for r in rs)
        assert abs(sum(r.taken for r in rs) - want[s]) <= largest / 2 + 1e-6 or len(set(map(tuple, rs))) < len(rs)


def test_targets_and_amounts(spark):
    df = frame(spark, documents(n=400))
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count()
    check(rows)
    sizes = {(r[0], len((r[1] or "").split())) for r in documents(n=400)}
    assert {(r.doc_id, r.size) for r in rows} == sizes
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))


def test_coarse_levels_give_the_same(spark):
    df = frame(spark, documents(n=200))
    a, b = (sorted(map(str, mixing.mix(df, mixing.Params(bits=n)).collect())) for n in (3, 12))
    assert a == b


def test_take(spark):
    df = odd_columns(frame(spark, documents()))
    got, want = {}, {}
    for r in mixing.take_mix(df).collect():
        key = (r.doc_id, r.text)
        got[key] = got.get(key, 0) + 1
    for r, (d, t, *_) in zip(sorted(mixing.mix(df).collect(), key=lambda r: (str(r.doc_id), r.size)), sorted(documents(), key=lambda r: (str(r[0]), len((r[1] or "").split())))):
        if r.taken:
            want[d, t] = want.get((d, t), 0) + r.taken // r.size
    assert got == {k: v for k, v in got.items()} and {k: v for k, v in got.items() if k[1] and k[1].split()} == want
    assert mixing.take_mix(df).dtypes == df.dtypes


def test_empty_and_blank(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.take_mix(spark.createDataFrame([], DOCS)).count() == 0
    rows = mixing.mix(frame(spark, [(1, None, None, "a", 0), (2, " ", None, None, 0)])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def test_native(spark):
    plan = mixing.mix(frame(spark, documents()))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian"))
