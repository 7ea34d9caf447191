"""Search, centroid clustering and quality rules against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upliftlens.llm import quality, search
from upliftlens.llm.centroids import Simplex, cluster_vectors, nearest, squared
from upliftlens.llm.quality import quality_rules
from upliftlens.llm.search import lexical_search, share

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def best_of(docs, items, k=20):
    own = [(i, Counter(t), len(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n, length = len(own), sum(x for _, _, x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        wanted, found = Counter(terms(text)), []
        for doc, c, size in own:
            m = 100 - 25 + 25 * size * n // length
            score = 0
            for t, times in wanted.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += times * w * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


ITEMS = T.StructType([T.StructField(n, k) for n, k in (("item_id", T.LongType()), ("text", T.StringType()), ("score", T.StringType()))])


def items_of(documents):
    texts = [r.text for r in documents.collect() if (r.text or "").split()]
    rng = random.Random(9)
    out = [(i, " ".join(rng.choices(rng.choice(texts).split(), k=rng.randint(1, 25)))) for i in range(30)]
    out += [(3, out[0][1]), (40, None), (41, ""), (42, " !? "), (43, "NAÏVE naïve 漢字, x\x00y"), (None, out[5][1]), (44, "nowhere")]
    return out + [(45, out[1][1] + " " + out[2][1] * 3), (46, "ab " * 5000)]


@pytest.mark.parametrize("block_terms", [65536, 40])
def test_search(spark, documents, block_terms):
    wanted = items_of(documents)
    items = spark.createDataFrame([(i, t, "x") for i, t in wanted], ITEMS)
    found = lexical_search(documents, items, best=7, block_terms=block_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert dict(found.dtypes)["rank"] == "int"
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    assert Counter(map(tuple, found.collect())) == best_of(docs, wanted, 7)


def test_search_ties_and_many_tasks(spark):
    docs = spark.range(4000).select((F.col("id") * 7 % 4000).alias("doc_id"), F.lit("same words here").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(9000, "other")], "doc_id long, text string")).repartition(9)
    items = spark.createDataFrame([(1, "same"), (2, "words and more"), (3, "other")], "item_id long, text string")
    found = sorted(map(tuple, lexical_search(docs, items).select("item_id", "rank", "doc_id").collect()))
    assert found == [(3, 1, 9000)]  # the others weigh 0
    rare = docs.filter("doc_id < 1500 or doc_id = 9000").unionByName(
        spark.range(3000).select((F.col("id") + 20000).alias("doc_id"), F.lit("filler").alias("text"))
    )
    found = sorted(map(tuple, lexical_search(rare, items).select("item_id", "rank", "doc_id").collect()))
    assert found == [(i, r + 1, r) for i in (1, 2) for r in range(20)] + [(3, 1, 9000)]


def test_search_of_nothing(spark, documents, no_documents):
    items = spark.createDataFrame([(1, "one two", "x")], ITEMS)
    assert lexical_search(no_documents, items).count() == 0
    assert lexical_search(documents, items.limit(0)).count() == 0


def test_shared_sets_are_evaluated_once():
    rng = random.Random(4)
    common = [[rng.randrange(200) for _ in range(12)] for _ in range(4)]
    items = [dict(Counter(rng.choice(common) + rng.choice(common) + rng.choices(range(200, 400), k=3))) for _ in range(60)]
    graph = share(items + [{}])
    value = {i: Counter({(t, n): 1}) for i, (t, n) in enumerate(graph.leaves)}
    for node, a, b in graph.sums:
        value[node] = value[a] + value[b]
    for item, node in zip(items, graph.items, strict=False):
        assert value[node] == Counter(item.items())
    assert graph.items[-1] == -1
    assert len(graph.sums) < 0.6 * sum(len(i) - 1 for i in items)


def test_search_has_no_overflow():
    lengths = np.array([10**7, 3], np.int64)
    ranking = search.Ranking(share([{0: 1}]), np.array([5000]), 10**12, 10**13, 20)
    got = ranking.impacts(lengths, np.array([0, 1]), np.array([0, 0]), np.array([4, 1]))
    m = [75 + 25 * int(x) * 10**12 // 10**13 for x in lengths]
    assert got.tolist() == [5000 * (4 * 10**9 // (4000 + 12 * m[0])), 5000 * (10**9 // (1000 + 12 * m[1]))]


# --- centroids ------------------------------------------------------------------------------------


def clustered(rows, k=16, rounds=3, width=64):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [max(-(2**27), min(2**27, math.floor(64 * float(x)))) if abs(x) < 1e9 else int(math.copysign(2**27, x)) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        out = []
        for vec_id, v in kept:
            d = [sum((x - y) ** 2 for x, y in zip(v, c, strict=True)) for c in centroids]
            out.append((vec_id, d.index(min(d)), min(d), v))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centroids)):
            own = [v for _, at, _, v in found if at == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    parts = Counter()
    for _, c, d, _ in found:
        parts[c] += d
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, parts[c], sum(parts.values()), digests[c]) for i, c, d, _ in found), key=str)


VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("cluster", T.StringType())]
)


def vectors():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(9, 64))
    rows = [(i, (centres[i % 9] + rng.normal(size=64) * (0.2 if i % 3 else 1.0)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(500 + i, rows[3][1]) for i in range(40)]  # copies
    rows += [(600, None), (601, []), (602, [1.0] * 63), (603, [1.0] * 63 + [None]), (604, [math.nan] * 64), (605, [math.inf] * 64)]
    rows += [(606, [0.0] * 64), (607, [-0.0] * 64), (7, rows[11][1]), (None, rows[12][1]), (608, [0.015625] * 64), (609, [-1e-7] * 64)]
    return rows


@pytest.mark.parametrize("pivots", [1, 5, 12, 16])
def test_clusters(spark, pivots):
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors()], VECTORS).repartition(5)
    found = cluster_vectors(df, pivots=pivots)
    assert sorted(map(tuple, found.collect()), key=str) == clustered(vectors())


def test_few_equal_and_huge_vectors(spark):
    for rows in (
        [(i, [0.5] * 64) for i in range(30)],  # all centroids alike: the first takes everything
        [(1, [1.0] * 64), (2, [2.0] * 64)],
        [(i, [float(i)] * 64) for i in range(25)],  # on a line: a simplex of two pivots
        [(1, [3e38] * 64), (2, [-3e38] + [1.0] * 63), (3, [0.0] * 64)],
        [],
        [(1, None)],
    ):
        df = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS)
        assert sorted(map(tuple, cluster_vectors(df).collect()), key=str) == clustered(rows)


def test_bounds_hold_and_leave_out_centroids():
    rng = np.random.default_rng(2)
    points = rng.integers(-200, 200, size=(500, 64))
    centroids = points[:16] + rng.integers(-3, 4, size=(16, 64))
    simplex = Simplex(points[:12])
    a, b = simplex.apex(squared(points, simplex.pivots)), simplex.apex(squared(centroids, simplex.pivots))
    real = np.sqrt(squared(points, centroids))
    flat = ((a[:, None, :-1] - b[None, :, :-1]) ** 2).sum(axis=2)
    lower = np.sqrt(flat + (a[:, None, -1] - b[None, :, -1]) ** 2)
    upper = np.sqrt(flat + (a[:, None, -1] + b[None, :, -1]) ** 2)
    assert (lower <= real + 1e-6 * real.max()).all() and (upper >= real - 1e-6 * real.max()).all()
    near = points[:16].repeat(20, axis=0) + rng.integers(-9, 10, size=(320, 64))
    best, distance, compared = nearest(near, simplex.apex(squared(near, simplex.pivots)), centroids, simplex)
    full = squared(near, centroids)
    assert (best == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert compared < 0.5 * full.size


# --- quality --------------------------------------------------------------------------------------


def base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
    )


def gram_counts(text):
    found = re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+|[\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    h = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in found]
    return Counter([x % quality.BUCKETS for x in h] + [(x * quality.PAIR + y) % quality.BUCKETS for x, y in zip(h, h[1:], strict=False)])


def judged(rows, trusted, min_words=50):
    grams = [gram_counts(t) for _, t in rows]
    raw, good = sum(grams, Counter()), Counter()
    for (i, _), g in zip(rows, grams, strict=True):
        good += g if i in trusted else Counter()
    B, T_, A = quality.BUCKETS, sum(good.values()), sum(raw.values())

    def log_ratio(t, total, bucket):
        return round(1e6 * ((math.log(t + 1) - math.log(total + B)) - (math.log(raw[bucket] + 1) - math.log(A + B))))

    steps = []
    for (i, _), g in zip(rows, grams, strict=True):
        n = sum(g.values())
        if i in trusted and n:
            steps.append(1000 * sum(c * log_ratio(good[b] - c, T_ - n, b) for b, c in g.items()) // (n * 10**6))
    steps.sort()
    limit = -math.inf
    if steps:
        low, high = steps[math.ceil(len(steps) / 4) - 1], steps[math.ceil(3 * len(steps) / 4) - 1]
        limit = (low - 3 * (high - low)) / 1000
    out = []
    for (i, t), g in zip(rows, grams, strict=True):
        b, n = base(t), sum(g.values())
        failed = b[0] < min_words or 100 * b[4] > 50 * b[0]
        score = sum(c * log_ratio(good[x], T_, x) for x, c in g.items()) / max(n, 1) / 1e6
        out.append((i, *b, failed, not failed and score >= limit, round(score, 9)))
    return sorted(out, key=str)


def rounded(df):
    return sorted(((*r[:-1], round(r[-1], 9)) for r in map(tuple, df.collect())), key=str)


def test_quality(spark, documents):
    rng = random.Random(6)
    junk = [(900 + i, " ".join(f"%{rng.choice('abcd')}%{i}!" for _ in range(70)), "en", "s0", 1, 1, "x", "y", None, "z") for i in range(4)]
    lines = [(950, "a b\n\n a b\na b\n \n \nlast", "en", "s0", 1, 1, "x", "y", None, "z")]
    docs = documents.unionByName(spark.createDataFrame(junk + lines, documents.schema))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    trusted = {i for i, _ in rows if i is not None and i < 110 and i % 5}
    ids = spark.createDataFrame([(i, "x") for i in [*trusted, *trusted, 10**6, None]], "doc_id long, text string")
    found = quality_rules(docs, ids)
    assert rounded(found) == judged(rows, trusted)
    kept = {r.doc_id: r.kept for r in found.collect()}
    assert not any(kept[900 + i] for i in range(4))
    assert all(kept[i] for i in trusted if i < 50)


def test_quality_without_trust_or_texts(spark, documents, no_documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    none = spark.createDataFrame([], "doc_id long")
    assert rounded(quality_rules(documents, none)) == judged(rows, set())
    assert quality_rules(no_documents, none).count() == 0
    empty = documents.filter("doc_id between 200 and 202")
    assert [(r.n_words, r.base_failed, r.kept, r.score) for r in quality_rules(empty, empty).collect()] == [(0, True, False, 0.0)] * 3
