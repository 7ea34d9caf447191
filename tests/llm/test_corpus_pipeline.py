"""The stages of the pipeline, each against plain Python on what it was given."""

import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from llm.test_exact import WORD, without_later_lines
from llm.test_near import reached, shingles

from upliftlens.llm import bpe
from upliftlens.llm.common import Scratch
from upliftlens.llm.mixing import mix_sources


@pytest.fixture(scope="module")
def steps(spark, documents, tmp_path_factory):
    """The rows before the first and after each stage."""
    sf_dir = str(tmp_path_factory.mktemp("sf"))
    documents.select(*corpus_pipeline.COLUMNS).write.parquet(f"{sf_dir}/documents.parquet")
    marks = spark.createDataFrame([(i, int(i in (10, 11, 12))) for i in range(10, 30)], "doc_id long, quality int").selectExpr(
        "doc_id", "0 as quality", "quality as toxic"
    )
    marks.write.parquet(f"{sf_dir}/labels.parquet")
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        out.append(docs.collect())
        if name != "bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
    return out


def test_toxic_documents_go(steps):
    before, after = steps[:2]
    assert 0 < len(after) < len(before)
    assert not Counter((r.doc_id, r.text) for r in after) - Counter((r.doc_id, r.text) for r in before)
    assert {r.doc_id for r in after} >= {200, 201, 202}  # nothing to read, so the share of toxic labels decides


def test_repeated_lines_go(steps):
    before, after = steps[1:3]
    want = without_later_lines(before, 80, 1)
    left = Counter()
    for r in before:
        text = r.text if r.text is None else want[r.doc_id or 0, r.text]
        if text == r.text or WORD.search(text):
            left[r.doc_id, text] += 1
    assert Counter((r.doc_id, r.text) for r in after) == left
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)


def test_near_copies_go(steps):
    before, after = steps[2:4]
    sets = {}
    for r in sorted(before, key=lambda r: r.text or ""):
        if r.doc_id is not None:
            sets.setdefault(r.doc_id, shingles(r.text, 5))
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    root = reached(list(sets), links)
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before if r.doc_id is None or root[r.doc_id] == r.doc_id)


def test_sources_are_mixed(steps):
    before, after = steps[3:5]
    rows, copies = Counter((r.doc_id, r.text) for r in before), Counter((r.doc_id, r.text) for r in after)
    assert set(copies) <= set(rows) and all(copies[k] <= 3 * rows[k] for k in copies)
    size = lambda rs: sum(len(WORD.findall(r.text or "")) for r in rs)
    longest = max(len(WORD.findall(r.text or "")) for r in before)
    assert abs(size(after) - size(before)) <= 4 * (longest / 2 + 1)


def test_rows_that_share_an_id_are_mixed_to_the_word(spark):
    """Each takes its part of what the mix takes, not the largest part of any of them."""
    rows = [(7 if i % 2 else None, f"{'ab ' * 5}x{i}", "en", ("a", "b", None)[i % 3], 1) for i in range(60)]
    rows += [(i, f"{'cd ' * (i % 9)}y{i}", "en", "c", 1) for i in range(100, 160)] + [(100, "cd y100", "en", "c", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    size = lambda t: len(WORD.findall(t))
    want = Counter()
    for r in mix_sources(docs).collect():
        want[r.doc_id, r.source, r["size"]] += r.copies
    got = Counter((r.doc_id, r.source, size(r.text)) for r in corpus_pipeline.mixed(spark, docs, "").collect())
    assert got == +want
    taken = Counter((r.doc_id, r.text) for r in corpus_pipeline.mixed(spark, docs, "").collect())
    assert max(taken.values()) <= 3 * 4


def test_the_whole_pipeline(spark, steps, documents, no_documents, tmp_path):
    """`run` gives what the stages give one by one; without documents it gives no rows."""
    for name, docs in (("full", documents), ("empty", no_documents)):
        docs.select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        marks = spark.createDataFrame([(i, 0, int(i in (10, 11, 12))) for i in range(10, 30)], "doc_id long, quality long, toxic long")
        marks.selectExpr("doc_id", "int(quality) quality", "int(toxic) toxic").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    full = corpus_pipeline.run(spark, f"{tmp_path}/full")
    assert Counter(map(tuple, full.collect())) == Counter(map(tuple, steps[-1]))
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_tokens(steps):
    before, after = steps[4:6]
    path = public_tokenizers.path(corpus_pipeline.RANKS)
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={}
    )
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in before:
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(r.text or "")] += 1
    assert Counter(tuple(r) for r in after) == want
