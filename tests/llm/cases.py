"""Small tables with what operators must stand: nulls, empty and long texts, ties, repeated rows, extra columns."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(seed=0, n=60):
    """Prose with copies, near copies, shared passages, and odd rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i, prose(rng, rng.randrange(20, 200)), ["en", "de", None][i % 3], f"s{i % 4}" if i % 5 else None))
    base = rows[3][1].split()
    for k in range(8):
        other = list(base)
        for _ in range(k):
            other[rng.randrange(len(other))] = f"x{rng.randrange(1000)}"
        rows.append((n + k, " ".join(other), "en", "s0"))
    passage = prose(rng, 70, 5000)
    for k in range(4):
        rows.append((n + 10 + k, f"{prose(rng, 30)} {passage} {prose(rng, 30)}", "de", "s1"))
    rows += [(n + 20, None, "en", "s1"), (n + 21, "", None, None), (n + 22, " \t\n ", "de", "s2"), (n + 23, "one", "en", "s0"), (n + 24, "One", "en", "s0"), (None, "no id " * 30, "en", None), (n + 25, rows[5][1], "en", "s3"), (n + 25, rows[5][1], "en", "s3"), (n + 26, prose(rng, 20000), "en", "s0"), (n + 27, "%$#* |<> &", "en", "s2")]
    return [(a, b, c, d, None if b is None else len(b)) for a, b, c, d in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def odd_columns(df):
    """Extra columns with names that operators might use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(1) for c in ("key", "node", "h", "size", "_id", "_row", "n", "k", "words", "_text", "kept", "target")})
