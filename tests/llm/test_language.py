import itertools
import random

import numpy as np

from provenant.llm import language as L

DOCS = "doc_id long, text string, lang string"
SYLLABLES = {"aa": ["tha", "ing", "er", "on", "st", "ly"], "bb": ["ung", "sch", "ein", "keit", "ü", "zu"], "cc": ["ción", "ar", "os", "ñ", "que", "lla"]}


def word(rng, lang):
    return "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5)))


def corpus(seed=0, n=150):
    rng = random.Random(seed)
    rows = [(i, " ".join(word(rng, lang) for _ in range(rng.randrange(5, 150))), lang) for i, lang in zip(range(n), itertools.cycle(SYLLABLES))]
    return rows + [(n, None, "aa"), (n + 1, "", "bb"), (n + 2, "12 34 !!", "cc"), (n + 3, "unlabelled text", None), (None, rows[0][1], "aa")]


def small():
    return L.Params(per_label=40, piece=60, sequences=300, length=40, epochs=3, buckets=1 << 12)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    e, tr, ends = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), np.array([0, 4, 4, 9])
    got = L.forward_backward(e, tr, ends)
    for a, b in zip(ends, ends[1:]):
        want, z = np.zeros((b - a, 3)), 0
        for y in itertools.product(range(3), repeat=b - a):
            s = np.exp(sum(e[a + i, y[i]] for i in range(b - a)) + sum(tr[y[i], y[i + 1]] for i in range(b - a - 1)))
            z += s
            for i in range(b - a):
                want[i, y[i]] += s
        assert np.allclose(got[a:b], want / z if b > a else want)


def test_long_sequences_do_not_underflow():
    e = np.tile(np.array([[40.0, -40.0]]), (30000, 1)).astype(np.float32)
    p = L.forward_backward(e, np.zeros((2, 2), np.float32), np.array([0, 30000]))
    assert np.isfinite(p).all() and p[:, 0].min() > 0.999


def test_held_out_accuracy_and_edge_cases(spark):
    model = L.train(spark.createDataFrame(corpus(), DOCS), small())
    assert model.labels == ["aa", "bb", "cc"]
    test = corpus(seed=9)
    out = {r.doc_id: r for r in L.predict(spark.createDataFrame(test, DOCS), model).collect()}
    good = [out[i].lang_pred == lang for i, t, lang in test[:150]]
    assert np.mean(good) > 0.97
    assert [(out[150 + k].lang_pred, out[150 + k].score) for k in range(3)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in out.values()) and len(out) == len(test)


def test_switches_are_labelled_word_by_word(spark):
    model = L.train(spark.createDataFrame(corpus(), DOCS), small())
    rng = random.Random(4)
    ws = [word(rng, "aa") for _ in range(30)] + [word(rng, "bb") for _ in range(30)]
    post, _, _ = L.Tagger(model).posteriors([" ".join(ws).encode()])
    labels = post.argmax(1)
    assert (labels[:28] == 0).mean() > 0.9 and (labels[32:] == 1).mean() > 0.9
    assert model.transition.diagonal().min() > model.transition[~np.eye(3, dtype=bool)].max()


def test_batches_do_not_matter(spark):
    model = L.train(spark.createDataFrame(corpus(), DOCS), small())
    texts = [(t or "").encode() for _, t, _ in corpus()]
    a, b = L.Tagger(model).predict(texts), [L.Tagger(model).predict([t]) for t in texts]
    assert a[0] == [x[0][0] for x in b] and np.allclose(a[1], [x[1][0] for x in b], atol=1e-5)


def test_nothing_to_learn_from(spark):
    model = L.train(spark.createDataFrame([], DOCS), small())
    assert [r.lang_pred for r in L.predict(spark.createDataFrame([(1, "text", None)], DOCS), model).collect()] == ["und"]
    assert L.predict(spark.createDataFrame([], DOCS), model).count() == 0
