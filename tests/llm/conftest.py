import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with the names that results have, and one with a dot.
EXTRA = ["class_id", "SIZE", "target", "shards", "n_lines", "n_removed", "score", "row", "a.b"]


def sentence(r, words=("alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"), n=None):
    return " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(n or r.randrange(6, 30)))


def text(r, lines=None):
    return "\n".join(sentence(r) for _ in range(lines or r.randrange(1, 8)))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, ties and repeated rows."""
    r = random.Random(4)
    texts = [text(r) for _ in range(60)]
    shared = text(r, 3)
    out = []
    for k in range(150):
        t = r.choice(texts) if r.random() < 0.4 else text(r)
        if r.random() < 0.3:
            words = t.split(" ")
            words[r.randrange(len(words))] = "changed"
            t = " ".join(words)
        if r.random() < 0.3:
            t = t + "\n" + shared
        if r.random() < 0.2:
            t = t.replace("a", "ä", 1)
        out.append((k, t, r.choice(["en", "fr", None]), r.choice(["s1", "s2", "s3", None]), len(t)))
    out += [(150, None, None, None, None), (151, "", "en", "s1", 0), (152, "", "en", "s2", 0), (153, " \n\n ", "fr", "s3", 4), (154, "x", "fr", "s3", 1), (None, texts[0], "en", "s1", 1), (None, "only here " * 20, "en", "s1", 1)]
    out += [(155, texts[1] + "\n" + texts[2], "en", "s1", 1)] * 2
    out += [(156, "\n".join(texts) * 20, "en", "s2", 1), (157, "ab" * 40_000, "en", "s2", 1), (158, "z" * 60, "en", "s3", 1), (159, "z" * 61, "en", "s3", 1)]
    r.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def wide(docs):
    """More columns, with names that results have."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(f"x{k}").alias(n) for k, n in enumerate(EXTRA)])
