"""Tokens against the reference library, models against what they have not seen."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from upliftlens.llm import bpe, language, toxicity

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash(ranks):
    table = bpe.PerfectHash(ranks)
    assert sorted(key for key, _ in table.slots) == sorted(ranks)
    assert all(table.get(k) == r for k, r in ranks.items())
    assert table.get(b"qqzzqqzz") == -1
    assert bpe.PerfectHash({}).get(b"a") == -1


def test_short_and_long_merges_agree(monkeypatch):
    rng = random.Random(4)
    ranks = {bytes([b]): b for b in b"abcd"}
    while len(ranks) < 300:
        key = rng.choice(list(ranks)) + rng.choice(list(ranks))
        ranks.setdefault(key[:9], 1000 + len(ranks))
    pieces = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, bpe.SHORT))) for _ in range(500)]
    short = [bpe.merged(p, ranks) for p in pieces]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert short == [bpe.merged(p, ranks) for p in pieces]


def test_ids_equal_the_library(ranks, library):
    rng = random.Random(1)
    letters = list("abcdefgTHE the  \n\t'sre'1234567890.,;:!?éß漢字  　\x85\x1c🙂\r\n")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts += ["", " ", "  ", "a ", " a", "x\n\n  y", "x\n y", "ab" * 9000, "don't  we'll", "<|endoftext|>"]
    codec = bpe.Codec(ranks, P.PATTERN)
    for text, parts in zip(texts, codec.texts(pa.array(texts)), strict=True):
        ids = [i for part in parts for i in part[0]]
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids).decode() == text


def test_round_trip(documents, library):
    rows = {(r.doc_id, r.text or "") for r in documents.collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for doc_id, text in rows:
        ids = library.encode_ordinary(text)
        want.add((doc_id, len(ids), digest(",".join(map(str, ids))), digest(text)))
    assert {tuple(r) for r in bpe.round_trip(documents, PATH, P.PATTERN).collect()} == want
    tokens = bpe.encode(documents, PATH, P.PATTERN)
    assert {(r.doc_id, bytes(r.body).decode()) for r in bpe.decode(tokens, PATH).collect()} == rows


def test_no_rows(no_documents):
    assert bpe.round_trip(no_documents, PATH, P.PATTERN).count() == 0
    model = language.train(no_documents)
    assert model.langs == []
    assert language.identify(no_documents, model).count() == 0
    net = toxicity.train(no_documents, no_documents.select("doc_id", F.lit(1).alias("toxic")))
    assert toxicity.score(no_documents, net).count() == 0


SYLLABLES = {"aa": ["ka", "to", "mi", "ra", "nu"], "bb": ["sch", "ung", "ei", "ber", "ig"], "cc": ["cio", "les", "que", "an", "eau"]}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(7)
    rows = [(i, speech(rng, lang, 40), lang) for i in range(120) for lang in SYLLABLES]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 + 3 !", None), (903, "KATO!", None), (904, "漢字漢字漢字漢字", None)]
    docs = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.train(docs.filter(~language.held_out(F.col("doc_id"))))
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert len(found) == len(rows)
    assert all(found[i].lang_pred == r[2] for i, r in enumerate(rows[:360]))
    assert sum(found[i].rejected for i in range(360)) < 8
    assert all((found[i].lang_pred, found[i].score) == ("und", 0) for i in (360, 361, 362))
    assert (found[363].lang_pred, found[363].rejected) == ("aa", False)
    assert found[364].rejected
    assert all(0 <= r.score <= 1 for r in found.values())
    # every next letter has a probability, and they add up to no more than one
    seen = np.array([[ord(c) for c in w] for w in ("\x02\x02\x02", "\x02\x02k", "ato")], np.uint32)
    letters = np.array([ord(c) for c in "abceghiklmnoqrstu\x03"], np.uint32)
    for context in seen:
        windows = np.concatenate([np.tile(context, (len(letters), 1)), letters[:, None]], axis=1)
        total = np.exp2(-model.bits(windows)).sum(axis=0)
        assert (total > 0.5).all() and (total < 1 + 1e-9).all()


def test_gradients():
    """Against differences of the loss."""
    net = toxicity.Network(3)
    rng = np.random.default_rng(0)
    net.p["words"] += rng.normal(0, 0.3, net.p["words"].shape).astype(np.float32)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    words = ["abc", "d", "efghij", "kk"]
    ids = np.array([[0, 1], [2, 3], [3, 0]])
    mask = np.array([[1, 1], [1, 1], [1, 0]], np.float32)
    labels, weights = np.array([1.0, 0.0]), np.array([0.5, 0.5])

    def loss():
        x, _ = net.word_inputs(words)
        logit = net.window_logits(net.by_word.project(x), ids, mask).astype(float)
        return (weights * (np.log1p(np.exp(logit)) - labels * logit)).sum()

    x, kept = net.word_inputs(words, keep=True)
    grads = net.learn(x, kept, ids, mask, labels, weights)
    for name in net.p:
        flat, g = net.p[name].reshape(-1), grads[name].reshape(-1)
        for i in np.argsort(-np.abs(g))[:3]:
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-2 - g[i]) < 2e-2 * max(1e-2, abs(g[i]))


def test_toxicity(spark):
    rng = random.Random(4)
    bad = ["vilex", "grubo", "nastik"]
    docs, labels = [], []
    for i in range(400):
        text = speech(rng, "aa", rng.randint(5, 90)).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        docs.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic)))
    docs += [(500, None, "x"), (501, "", "x"), (None, "ka to", "x"), (502, "ka " * 40000, "x"), (503, "ka " * 40000 + "vilex grubo nastik vilex", "x")]
    labels += [(None, 1), (500, None), (7, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    how = toxicity.Training(texts_per_class=200, steps=150, batch=16)
    net = toxicity.train(df, marks.filter(~toxicity.held_out(F.col("doc_id"))), how)
    found = {r.doc_id: r.score for r in toxicity.score(df, net).collect()}
    assert len(found) == len(docs)
    unseen = [r[0] for r in df.filter(toxicity.held_out(F.col("doc_id")) & (F.col("doc_id") < 400)).select("doc_id").collect()]
    right = [(found[i] >= 0.5) == (i % 4 == 0) for i in unseen]
    assert sum(right) >= 0.95 * len(right)
    assert abs(found[500] - net.base_rate) < 1e-6 and abs(found[501] - net.base_rate) < 1e-6
    assert found[502] < 0.5 < found[503]


def test_toxic_texts_that_are_all_long(spark):
    """A class whose texts all exceed the preferred length is not lost."""
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(160):
        text = speech(rng, "aa", 900 if i % 4 == 0 else rng.randint(20, 90)).split(" ")
        if i % 4 == 0:
            for _ in range(40):
                text.insert(rng.randrange(len(text)), rng.choice(["vilex", "grubo", "nastik"]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    df = spark.createDataFrame(docs + [(0, "another text under the id")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    how = toxicity.Training(texts_per_class=100, steps=120, batch=16, max_chars=1000, long_chars=3000)
    assert min(len(t) for i, t in docs if i % 4 == 0) > 1000
    nets = [toxicity.train(df.repartition(n), marks, how) for n in (2, 5)]
    assert all((nets[0].p[k] == nets[1].p[k]).all() for k in nets[0].p)
    found = {r.doc_id: r.score for r in toxicity.score(df.filter("text not like 'another%'"), nets[0]).collect()}
    assert sum((found[i] >= 0.5) == (i % 4 == 0) for i in range(160)) >= 150


def test_a_rare_language_beside_a_million_windows(spark):
    """Each window of the common language is there twice, each of the rare one once."""
    rng = np.random.default_rng(1)
    letters = rng.integers(0x4E00, 0x9FA0, (30, 36_000)).astype("<u4")
    common = [row.tobytes().decode("utf-32-le") for row in letters] * 2
    rare = " ".join("".join(random.Random(w).sample("abcdefghij", 6)) for w in range(40))
    docs = spark.createDataFrame([(i, t, "zz") for i, t in enumerate(common)] + [(90, rare, "aa")], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.size > 2_000_000
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert (found[90].lang_pred, found[90].rejected) == ("aa", False)
    assert found[90].score > 0.9 and found[90].bits_per_letter < 3
    # windows seen once or twice tell the discounts: every window of the rare language counts 1
    seen = np.array([[ord(c) for c in f"\x02\x02\x02{rare[0]}"]], np.uint32)
    assert model.bits(seen)[0, 0] < model.bits(seen)[0, 1]


def test_what_a_tokenizer_keeps_goes_with_its_task():
    """A worker lives on through later stages, which need its memory."""
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["one two, three", "vier unbekannte Wörter"])], names=["doc_id", "text"])
    codec = bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)
    tasks = bpe._digests(codec, iter([batch, batch]))
    next(tasks)
    assert codec.recent and codec.pieces
    assert len(list(tasks)) == 1
    assert not (codec.recent or codec.older or codec.pieces or codec.older_pieces)
