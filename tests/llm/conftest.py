from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use themselves
        T.StructField("row", T.LongType()),
        T.StructField("size", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("component", T.StringType()),
    ]
)


def prose(rng: random.Random, n: int, words: list[str]) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


def make_documents() -> list[tuple]:
    """Texts with copies, near copies, odd white space, NULLs in every column and repeated rows."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    out = []
    base = [prose(rng, 60, words) for _ in range(12)]
    for i, text in enumerate(base):
        out.append((10 + i, f"{text}\n{prose(rng, 20, words)}", "en", f"s{i % 3}"))
        edited = text.split(" ")
        edited[i] = "zz"
        out.append((40 + i, " ".join(edited), "de", f"s{i % 2}"))
        out.append((70 + i, text.upper() if i % 2 else text.replace(" ", "  "), "en", "s0"))
    shared = prose(rng, 30, words)
    for i in range(8):
        out.append((100 + i, f"{prose(rng, 15, words)}\n{shared}\n\n{prose(rng, 9, words)}", None if i == 3 else "fr", None))
    out += [
        (200, None, "en", "s1"),
        (201, "", "en", "s1"),
        (202, " \t\n ", "en", None),
        (203, "one", "en", "s1"),
        (204, "One", "en", "s1"),
        (205, "one two", "en", "s1"),
        (206, "\x0bone\x0ctwo\r\n", "en", "s1"),
        (207, "naïve 漢字 🙂 x y", "en", "s2"),
        (208, ("ab " * 30000) + "end", "en", "s2"),
        (209, "x" * 70000, "en", "s2"),
        (None, "no id at all, but some words here", "en", "s2"),
        (10, out[0][1], "en", "s0"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), 1, "x", "y", None, "z") for i, t, lang, s in out]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(make_documents(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)
