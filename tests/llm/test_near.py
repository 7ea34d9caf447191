"""Near-duplicates, near vectors and personal data against plain Python."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upliftlens.llm import minhash, neighbours, pii
from upliftlens.llm.common import Scratch
from upliftlens.llm.components import components, roots
from upliftlens.llm.minhash import minhash_dedup
from upliftlens.llm.neighbours import near_vectors
from upliftlens.llm.pii import KINDS, find_pii, span_text

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def reached(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)]  # a long chain
    links += [(1000, 1000 + i) for i in range(1, 80)]  # a star
    links += [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(70)] + [(7, 7)]
    ids = {x for a, b in links for x in (a, b) if a != b}
    df = spark.createDataFrame(links, "a long, b long")
    found = {r.id: r.component for r in components(df, Scratch(spark)).collect()}
    assert found == reached(ids, [x for x in links if x[0] != x[1]])
    assert components(df.limit(0), Scratch(spark)).count() == 0


def test_roots(spark):
    links = [(i + 1, i) for i in range(40)] + [(100 + i, 100) for i in range(1, 9)] + [(201, 200), (100, 41)]
    found = {r.id: r.component for r in roots(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    ids = {x for link in links for x in link}
    assert found == reached(ids, links)
    assert roots(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_copies(documents, size, percent):
    rows = [r for r in documents.collect()]
    sets = {}
    for r in rows:
        if r.doc_id is not None:
            sets.setdefault(r.doc_id, shingles(r.text, size))
    ids = sorted(sets)
    links = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    want = reached(ids, links)
    found = minhash_dedup(documents, shingle=size, percent=percent).collect()
    assert len(found) == len(rows)
    assert links
    for r in found:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
            assert r.n_shingles == len(sets[r.doc_id])


def test_a_large_group_of_near_copies(spark):
    """Variants of one text, linked in a chain only."""
    rng = random.Random(8)
    text = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    docs = []
    for i in range(150):
        if i % 3 == 0:
            text[rng.randrange(150)] = f"n{i}"
        copy = list(text)
        copy[rng.randrange(150)] = f"v{i}"
        docs.append((i, " ".join(copy)))
    sets = {i: shingles(t, 3) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in minhash_dedup(df, shingle=3, percent=85).collect()}
    assert found == reached(list(sets), links)


def test_sketches_that_differ_in_two_bits():
    """Where classes of different components meet, two bits of a sketch count as two, the highest among them too."""
    names = ["key", "slot", "piece", "role", "id", "component", "n", "inside", *minhash.SKETCH, *minhash.PARTS]
    for bit in range(256):
        sketch = np.zeros(4, np.uint64)
        sketch[bit // 64] = np.uint64(1) << np.uint64(bit % 64) | np.uint64(1) << np.uint64((bit + 1) % 64)
        there = [1, 0, 0, 0, 7, 7, 100, True, *[0] * 4, *[0] * minhash.LONGS]
        here = [1, 0, 0, 1, 9, 9, 101, False, *sketch.view(np.int64).tolist(), *[0] * minhash.LONGS]
        batch = pa.record_batch([pa.array(c) for c in zip(there, here, strict=True)], names=names)
        told = [r for b in minhash._meet(85)([batch]) for r in b.to_pylist()]
        assert told == [{"a": 9, "b": 7, "distance": 0}], bit


def test_far_members_of_large_groups(spark):
    """Copies of a few texts with up to an eighth of the words changed: some have one link, just over the threshold."""
    rng = random.Random(12)
    docs = []
    for _ in range(2):
        text = [f"w{rng.randint(0, 300)}" for _ in range(300)]
        for k in range(260):
            copy = list(text)
            for _ in range(k // 7):
                copy[rng.randrange(300)] = f"v{rng.randint(0, 300)}"
            docs.append((len(docs), " ".join(copy)))
    sets = {i: shingles(t, 3) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in minhash_dedup(df, shingle=3, percent=85).collect()}
    assert found == reached(list(sets), links)


def test_no_documents(no_documents, spark):
    assert minhash_dedup(no_documents).count() == 0
    assert find_pii(no_documents).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_vectors(empty).count() == 0


VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("g", T.StringType()),
    ]
)


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for label in (0, 1):
        centre = rng.normal(size=16)
        for _ in range(150):
            v = centre + 1.5 * rng.normal(size=16)
            rows.append((i, v.tolist(), label, "x"))
            i += 1
            if i % 5 == 0:
                rows.append((i, (v + 0.05 * rng.normal(size=16)).tolist(), label, "x"))
                i += 1
        v = rng.normal(size=16)
        for k in range(60):  # a dense group, some of it equal
            rows.append((i, (v + (0 if k % 4 == 0 else 0.12) * rng.normal(size=16)).tolist(), label, "x"))
            i += 1
    rows += [(i, rows[0][1], 1, None), (i + 1, rows[0][1], None, "x"), (i + 2, None, 0, "x"), (i + 3, [0.0] * 16, 0, "x")]
    rows += [(i + 4, [float("nan")] * 16, 0, "x"), (i + 5, [None] * 16, 0, "x"), (i + 6, [], 0, "x"), (i + 7, [1.0, 2.0], 0, "x")]
    rows += [(i + 8, [2.0, 4.0], 0, "x"), (i + 9, [1e200] * 16, 0, "x"), (None, rows[0][1], 0, "x"), (0, rows[0][1], 0, "x")]
    linked = [r for r in rows[:-2] if r[1] and None not in r[1] and r[2] is not None and np.isfinite(r[1]).all() and any(r[1])]
    links = []
    for x, a in enumerate(linked):
        for b in linked[x + 1 :]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                p, q = np.array(a[1]) / np.max(np.abs(a[1])), np.array(b[1]) / np.max(np.abs(b[1]))
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.98:
                    links.append((a[0], b[0]))
    want = reached([r[0] for r in rows if r[0] is not None], links)
    found = near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(found) == len(rows)
    degree = {}
    for a, b in links:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    twice = {0} | {b if a == 0 else a for a, b in links if 0 in (a, b)}  # vector 0 is there twice
    for r in found:
        if r.vec_id is None:
            assert (r.n_links, r.kept) == (0, True)
        else:
            assert r.component_id == want[r.vec_id]
            assert r.n_links == degree.get(r.vec_id, 0) + (r.vec_id in twice)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checks(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        odd = sum(int(d) for d in digits[::-2])
        even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
        return 14 <= len(digits) <= 19 and (odd + even) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    found = [
        (m.start(), rank, kind, m.end())
        for rank, kind in enumerate(KINDS)
        for m in re.finditer(PATTERNS[kind], text or "")
        if checks(kind, m.group())
    ]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


def test_personal_data(spark):
    rng = random.Random(6)
    pieces = ["a@b.co", "x.y+z@mail-1.example.org", "@", "a@b", "a@b.", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111"]
    pieces += ["4111-1111-1111-1112", "+1 (386) 555-9807", "+1", "+12345678901234567890", "é🙂", " ", "\n", "00001.2.3.255", "5", "-", "a%b@c.d@e.f"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    texts += ["", None, "1 " * 20000, "a" * 50000, "a." * 20000 + "@", "x@" + "a." * 5000 + "b", "9" * 30000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = find_pii(df).select("doc_id", span_text("base").alias("base"), span_text("spans").alias("spans")).collect()
    assert len(found) == len(texts)
    for r in found:
        want = base(texts[r.doc_id])
        assert r.base == ",".join(want), texts[r.doc_id]
        assert set(want) <= set(r.spans.split(",")) | {""}


@pytest.mark.parametrize("run", [256, 3])
def test_places_of_matches(spark, monkeypatch, run):
    monkeypatch.setattr(pii, "RUN", run)
    rng = random.Random(8)
    texts = ["".join(rng.choice(["ab1", "é", "🙂", " ", "x", "12"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "id long, text string")
    for r in df.select("id", pii.located(F.col("text"), "[0-9]+").alias("s")).collect():
        text = texts[r.id] if r.id < 99 else ""
        want = [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", text)]
        assert [(x.start, x.end, x.value) for x in r.s] == want
        for (start, end, _), x, before, after in zip(want, r.s, [None, *want], [*want[1:], None], strict=False):
            assert x.before == text[before[1] if before else 0 : start][-pii.REACH :]
            assert x.after == text[end : after[0] if after else len(text)][: pii.REACH]


def test_a_text_with_very_many_identifiers(spark):
    """Time grows with the number of matches, not with its square."""
    texts = [" ".join(f"id{i}x9" for i in range(100_000)), "mail me: a@b.co"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = time.monotonic()
    found = {r.doc_id: r for r in find_pii(df).collect()}
    assert time.monotonic() - start < 90
    assert (len(found[0].base), len(found[1].base)) == (0, 1)


def test_identifiers_in_groups_and_in_chains(spark):
    """Digit groups behind words that numbers follow; what they make known makes further contexts known."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    number = lambda: f"({rng.randint(200, 999)}) {rng.randint(100, 999)} {rng.randint(1000, 9999)}"
    plain = lambda: f"+1 {rng.randint(200, 999)} {rng.randint(1000000, 9999999)}"
    texts = [f"{word()} {word()} reach us at {plain()} {word()}" for _ in range(120)]
    shared = [number() for _ in range(12)]
    texts += [f"{word()} reach us at {n} {word()}" for n in shared]  # known after the first round
    texts += [f"{word()} or dial then {n} {word()}" for n in shared]  # a context after the second
    late = number()
    texts += [f"{word()} or dial then {late} {word()}", f"{word()} {word()} 12 34567 {word()}"]
    found = {r.doc_id: r for r in find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, n in enumerate(shared):
        (span,) = found[120 + i].spans
        assert (span.kind, texts[120 + i][span.start : span.end]) == ("phone", span.value)
    (span,) = found[144].spans
    assert span.kind == "phone" and span.value in late
    assert not found[145].spans


def test_contexts_find_what_patterns_miss(spark):
    """Addresses in another notation, behind words that addresses usually follow."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [f"{word()} {word()} mail me: {word()}@{word()}.org {word()} {word()}" for _ in range(40)]
    texts += [f"{word()} {word()} mail me: {word()}@{word()}_org {word()}"] * 2 + [f"{word()} {word()}9{word()} {word()}"] * 9
    found = find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = {r.doc_id: r for r in found.collect()}
    for i in (40, 41):
        assert not rows[i].base
        (span,) = rows[i].spans
        assert (span.kind, texts[i][span.start : span.end]) == ("email", span.value)
        assert span.value.endswith("_org")
    assert all(len(rows[i].spans) == 1 for i in range(40))
    assert not any(rows[i].spans for i in range(42, 51))


def test_tight_groups_near_each_other(spark, monkeypatch):
    """More vectors than a list holds at a cosine of 0.999, and 0.985 to those of another such group."""
    monkeypatch.setattr(neighbours, "AUDIT", 0)  # by the lists alone
    monkeypatch.setattr(neighbours, "EVERY", 10**9, raising=False)
    rng = np.random.default_rng(2)
    axes = np.eye(32)
    rows = []
    for label in range(3):
        angle = np.arccos(0.985)
        for centre in (axes[2 * label], np.cos(angle) * axes[2 * label] + np.sin(angle) * axes[2 * label + 1]):
            rows += [(len(rows) + 1 + k, (centre + 0.002 * rng.normal(size=32)).tolist(), label % 2, "x") for k in range(60)]
    found = near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert {(r.component_id, r.n_links) for r in found} == {(1, 119), (121, 119), (241, 119)}


def test_lost_pairs_beside_a_large_group(spark, monkeypatch):
    """The descent finds the large group and none of the pairs, which are few of all links."""
    descend = neighbours._descend
    monkeypatch.setattr(neighbours, "_descend", lambda *a: descend(*a).filter("a <= 400 and b <= 400"))
    rng = np.random.default_rng(3)
    hot = rng.normal(size=32)
    rows = [(i, (hot + 0.05 * rng.normal(size=32)).tolist(), 0, "x") for i in range(1, 401)]
    for _ in range(300):
        v = rng.normal(size=32)
        rows += [(len(rows) + k, (v + 0.01 * k * rng.normal(size=32)).tolist(), 0, "x") for k in (1, 2)]
    found = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    assert all((found[i].component_id, found[i].n_links) == (1, 399) for i in range(1, 401))
    assert all((found[i].component_id, found[i].n_links) == (i - (i + 1) % 2, 1) for i in range(401, 1001))


def brute(rows):
    """Components and numbers of links of (id, vector, label, ...) rows, all compared."""
    links = []
    for label in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == label]
        x = np.array([r[1] for r in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for s in range(0, len(own), 1000):
            i, j = np.nonzero(x[s : s + 1000] @ x.T >= 0.98)
            links += [(own[a + s][0], own[b][0]) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a + s < b]
    degree = {r[0]: 0 for r in rows}
    for a, b in links:
        degree[a], degree[b] = degree[a] + 1, degree[b] + 1
    part = reached(list(degree), links)
    return {i: (part[i], degree[i]) for i in degree}


def test_vectors_near_nothing_stay_out_of_the_descent(spark, monkeypatch):
    """What has no vector within twice the angle of a link leads to none, and costs no round."""
    seen, descend = [], neighbours._descend
    monkeypatch.setattr(neighbours, "_descend", lambda *a: (seen.append(a[1].count()), descend(*a))[1])
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=32).tolist(), i % 2, "x") for i in range(2000)]
    rows += [(2000 + i, (np.array(rows[i][1]) + 0.05 * rng.normal(size=32)).tolist(), i % 2, "x") for i in range(20)]
    found = near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r.vec_id: (r.component_id, r.n_links) for r in found} == brute(rows)
    assert max(seen) <= 40


def test_groups_that_trees_cut(spark, monkeypatch):
    """More vectors than a bucket and a leaf hold, off the origin; by the lists alone."""
    monkeypatch.setattr(neighbours, "AUDIT", 0)
    monkeypatch.setattr(neighbours, "EVERY", 10**9)
    rng = np.random.default_rng(6)
    assert neighbours.BUCKET < 9000 and 1500 > neighbours.LEAF
    shift = 0.8 * rng.normal(size=24)
    rows = [(i, (shift + rng.normal(size=24)).tolist(), int(i >= 9000), "x") for i in range(10_500)]
    rows += [(20_000 + i, (np.array(rows[i][1]) + 0.1 * rng.normal(size=24)).tolist(), rows[i][2], "x") for i in range(0, 10_500, 30)]
    hot = rng.normal(size=24)
    rows += [(30_000 + i, (hot + 0.05 * rng.normal(size=24)).tolist(), 0, "x") for i in range(60)]
    found = near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    want = brute(rows)
    assert sum(n > 0 for _, n in want.values()) > 300
    assert {r.vec_id: (r.component_id, r.n_links) for r in found} == want


def test_equal_vectors_of_single_precision(spark):
    """Zeros of either sign are equal; rows that share an id and differ stay two."""
    rows = [(1, [0.0, 1.0], 0), (2, [-0.0, 1.0], 0), (3, [1.0, 0.0], 0), (3, [0.0, 1.0], 0), (4, [0.0, float("-inf")], 0), (5, [1.0, None], 0)]
    kind = "vec_id long, embedding array<float>, label int"
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, kind)).collect())
    assert found == [(1, 2, 1), (2, 2, 1), (3, 0, 3), (3, 2, 1), (4, 0, 4), (5, 0, 5)]
