import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from provenant.llm import pii

DOCS = "doc_id long, text string"
TEST = pii.Params("a key of the tests")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c)
        v = v * 2 if i % 2 else v
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def card(rng, n=16):
    body = "4" + "".join(str(rng.randrange(10)) for _ in range(n - 2))
    return next(body + str(k) for k in range(10) if luhn(body + str(k)))


def run(spark, texts, params=TEST):
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), DOCS), params).collect()
    return {r.doc_id: r for r in rows}


def test_values_keep_their_format_and_stay_linked(spark):
    rng = random.Random(1)
    c = card(rng)
    spaced = " ".join(c[i:i + 4] for i in range(0, 16, 4))
    texts = [f"pay {c} now", f"{c}", f"again {spaced}.", "call +1 (988) 555-2485 or 988-555-2485", "ssn 123-45-6789", "at 42.144.35.254, ok", "on 2024-02-29 and 29.2.2024 and 2/29/2024 and 2024/02/29", "mail Bob.42@mail8.example.com!", "mail Bob.42@other.example.com"]
    out = run(spark, texts)
    a = re.search(r"\d{16}", out[0].text)[0]
    assert a != c and a[0] == "4" and luhn(a) and a == out[1].text and " ".join(a[i:i + 4] for i in range(0, 16, 4)) in out[2].text
    p = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4})", out[3].text)
    assert p and p.groups()[:3] == p.groups()[3:] != ("988", "555", "2485") and min(int(p[1]), int(p[2])) >= 200
    s = re.fullmatch(r"ssn (\d{3})-(\d\d)-(\d{4})", out[4].text)
    assert s and out[4].text != texts[4] and 0 < int(s[1]) < 900 and int(s[1]) != 666 and int(s[2]) and int(s[3])
    ip = re.fullmatch(r"at (\d+)\.(\d+)\.(\d+)\.(\d+), ok", out[5].text)
    assert ip and out[5].text != texts[5] and all(int(x) < 256 for x in ip.groups())
    d = re.fullmatch(r"on (\d{4}-\d\d-\d\d) and (\d+)\.(\d+)\.(\d{4}) and (\d+)/(\d+)/(\d{4}) and (\d{4}/\d\d/\d\d)", out[6].text)
    day = date.fromisoformat(d[1])
    assert day != date(2024, 2, 29) and date(int(d[4]), int(d[3]), int(d[2])) == day == date(int(d[7]), int(d[5]), int(d[6])) and d[8] == d[1].replace("-", "/")
    assert re.fullmatch(r"mail [A-Z][a-z]{2}\.\d\d@mail8\.example\.com!", out[7].text) and out[7].text != texts[7]
    assert out[7].text[5:11] == out[8].text[5:11]
    assert (out[3].n_phone, out[6].n_date, out[0].n_replaced) == (2, 4, 1)
    assert run(spark, texts, pii.Params(key="other"))[0].text != out[0].text


def test_what_is_not_valid_stays(spark):
    texts = ["4111111111111112 order", "300.1.2.3", "1.2.3.4.5 version", "2023-02-29", "13/13/2024", "666-12-1234 000-12-1234", "100-555-1234", "Apache 2.0. in 2024", "token=0641917ea4e9feb9cda83477b57ac2654884f485", "a@b", "0000000000000000", ""]
    out = run(spark, texts)
    assert {i: r.text for i, r in out.items()} == dict(enumerate(texts))
    assert all(r.n_replaced == 0 for r in out.values())


def test_nulls_long_texts_and_empty_tables(spark):
    long = "word " * 200_000 + "42.144.35.254"
    out = run(spark, [None, "", long, "Füße 42.144.35.254\n\n42.144.35.254"])
    assert out[0].text is None and out[0].n_replaced == 0 and out[1].text == ""
    assert out[2].text.startswith("word " * 200_000) and out[2].n_ipv4 == 1
    x, y = out[3].text.removeprefix("Füße ").split("\n\n")
    assert x == y == out[2].text.split()[-1]
    assert pii.pseudonymise(spark.createDataFrame([], DOCS), TEST).count() == 0


@pytest.mark.parametrize("kind", ["date", "ssn", "ipv4", "phone", "card", "email"])
def test_permutations(spark, kind):
    """Different valid values get different valid values."""
    rng = random.Random(3)
    make = {
        "date": lambda: (date(1700, 1, 1) + timedelta(days=rng.randrange(146097))).isoformat(),
        "ssn": lambda: f"{rng.choice([x for x in range(1, 900) if x != 666]):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}",
        "ipv4": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "phone": lambda: f"({rng.randrange(200, 1000)}) {rng.randrange(200, 1000)}-{rng.randrange(10000):04d}",
        "card": lambda: card(rng, rng.randrange(13, 20)),
        "email": lambda: "".join(rng.choice("abcxyz019._") for _ in range(3)) .replace("..", "a.").strip("._") + f"{rng.randrange(100)}q@mail.example.org",
    }[kind]
    values = sorted({make() for _ in range(1500)})
    out = run(spark, values)
    got = [out[i].text for i in range(len(values))]
    assert len(set(got)) == len(values) and all(r[f"n_{kind}"] == 1 for r in out.values())
    again = run(spark, got)
    assert all(r[f"n_{kind}"] == 1 for r in again.values())  # still valid
    assert [len(a) for a in got] == [len(v) for v in values] or kind == "ipv4"


def test_feistel_is_a_bijection(spark):
    df = spark.range(15).select((F.col("id") % 3).alias("a"), F.floor(F.col("id") / 3).alias("b"))
    mixed = df.select(pii.feistel(F.col("a"), F.col("b"), F.lit(3).cast("bigint"), F.lit(5).cast("bigint"), "t", TEST).alias("x")).select("x.*")
    assert {(r.a, r.b) for r in mixed.collect()} == {(i % 3, i // 3) for i in range(15)}


def test_native(spark):
    plan = pii.pseudonymise(spark.createDataFrame([(1, "x 1.2.3.4")], DOCS), TEST)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))


def test_written_phones_below_200_do_not_stay(spark):
    rng = random.Random(6)
    values = sorted({f"+1 ({rng.randrange(200):03d}) {rng.randrange(1000):03d}-{rng.randrange(10000):04d}" for _ in range(300)} | {f"({rng.randrange(200, 1000)}) {rng.randrange(200):03d}-{rng.randrange(10000):04d}" for _ in range(300)} | {"+1 (017) 555-7713", "+1 (132) 555-1352"})
    out = run(spark, values)
    got = [out[i].text for i in range(len(values))]
    assert all(r.n_phone == 1 for r in out.values()) and len(set(got)) == len(values)
    assert sum(a == b for a, b in zip(got, values)) == 0
    assert [re.sub(r"\d", "0", a) for a in got] == [re.sub(r"\d", "0", v) for v in values]
    assert all(r.n_phone == 1 for r in run(spark, got).values())


def test_the_key_holder_gets_every_value_back(spark):
    """A round trip over all kinds; another key gives other texts; extra columns and repeated rows do not matter."""
    rng = random.Random(9)
    day = lambda: date(1700, 1, 1) + timedelta(days=rng.randrange(146097))
    texts = [None, "", "no value", "4111111111111112 stays"]
    for _ in range(200):
        texts.append(f"card {card(rng, rng.randrange(13, 20))}, mail {rng.choice(['ann', 'Bo.b7', 'x_9', 'q'])}{rng.randrange(1000)}@mail.example.org, at {'.'.join(str(rng.randrange(256)) for _ in range(4))}; "
                     f"born {day().isoformat()} or {day():%d.%m.%Y}, ssn {rng.randrange(1, 600):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}, call +1 ({rng.randrange(1000):03d}) {rng.randrange(1000):03d}-{rng.randrange(10000):04d}")
    texts += texts[4:9]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, kind string, n_card int")
    hidden = pii.pseudonymise(docs, TEST)
    back = {r.doc_id: r for r in pii.restore(hidden, TEST).collect()}
    assert [back[i].text for i in range(len(texts))] == texts
    got = {r.doc_id: r for r in hidden.collect()}
    assert all(got[i].n_replaced == back[i].n_replaced == 7 for i in range(4, len(texts)))
    assert all(got[i].text != texts[i] for i in range(4, len(texts)))
    assert [got[i].text for i in range(4, 9)] == [got[i].text for i in range(len(texts) - 5, len(texts))]
    wrong = {r.doc_id: r.text for r in pii.restore(hidden, pii.Params("another")).collect()}
    assert all(wrong[i] != texts[i] for i in range(4, len(texts)))


def test_a_key_is_needed(spark):
    with pytest.raises(ValueError):
        pii.Params("")
    with pytest.raises(TypeError):
        pii.Params()
