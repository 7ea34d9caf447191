"""Exact duplicates, mixing, lines and licences against plain Python."""

import hashlib
import math
import re
import textwrap
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from upliftlens.llm import license_scan as license_scan_module
from upliftlens.llm import line_dedup as line_dedup_module
from upliftlens.llm.common import Scratch, word_count
from upliftlens.llm.exact_dedup import block_key, exact_dedup
from upliftlens.llm.license_scan import license_scan
from upliftlens.llm.line_dedup import line_dedup
from upliftlens.llm.mixing import mix_sources, source_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def clean(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("block_bytes", [7, 4096])
def test_equal_texts(documents, block_bytes):
    # small blocks make many levels of names, and a block of text starts and ends inside a character
    docs = documents if block_bytes > 100 else documents.filter("length(text) < 2000 or text is null")
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[clean(r.text)].append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    found = exact_dedup(docs, block_bytes=block_bytes).collect()
    assert len(found) == len(rows)
    want = {
        (hashlib.sha256(k.encode()).hexdigest(), min(v)[2], len(v)) for k, v in groups.items()
    }
    assert {(r.text_sha256, r.keep_id, r.group_size) for r in found} == want
    assert sum(r.kept for r in found) == len(groups)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_a_key_that_collides_is_replaced(documents):
    def weak(salt, block):
        return (F.lit(0).cast("long"), F.lit(0).cast("long")) if salt == 0 else block_key(salt, block)

    key = lambda df: sorted((r.text_sha256, r.group_size) for r in df.collect())
    assert key(exact_dedup(documents, key=weak)) == key(exact_dedup(documents))


def test_empty_tables(no_documents, spark):
    assert exact_dedup(no_documents).count() == 0
    assert mix_sources(no_documents).count() == 0
    assert line_dedup(no_documents).count() == 0
    files = spark.createDataFrame([], "path string, text string")
    assert license_scan(files).count() == 0


def targets(sizes):
    """Shares by weight, stopped at three times the size, the excess shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        over = [s for s in free if left * weight[s] / sum(weight[f] for f in free) > 3 * sizes[s]]
        if not over:
            return {**capped, **{s: left * weight[s] / sum(weight[f] for f in free) for s in free}}
        capped.update({s: 3.0 * sizes[s] for s in over})


@pytest.mark.parametrize(
    "sizes",
    [{"a": 100, "b": 1, "c": 3, None: 50}, {"a": 7}, {"a": 0, "b": 10}, {f"s{i:02}": 10 ** (i % 4) for i in range(11)}],
)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = targets(sizes)
    for r in source_targets(df).collect():
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("ranges", [4, 4096])
def test_mix(documents, ranges):
    rows = documents.collect()
    found = mix_sources(documents, ranges=ranges).collect()
    again = mix_sources(documents.repartition(7), ranges=ranges).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert sorted(r.size for r in found) == sorted(len(WORD.findall(r.text or "")) for r in rows)
    sources = defaultdict(list)
    for r in found:
        assert r.copies <= 3 and r.taken == r.copies * r["size"]
        sources[r.source].append(r)
    want = targets({s: sum(r["size"] for r in rs) for s, rs in sources.items()})
    for s, rs in sources.items():
        assert math.isclose(rs[0].target, want[s], rel_tol=1e-9)
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r["size"] for r in rs) / 2 + 1
        assert max(r.copies for r in rs) - min(r.copies for r in rs) <= 1


def test_word_count(spark):
    texts = ["", " ", "a", " a\n\nb\x0bc ", "a b", None, "x" * 200000, "y " * 50000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(word_count(F.col("text"))).collect()] == [len(WORD.findall(t or "")) for t in texts]


def without_later_lines(rows, percent, min_words):
    """Every line against every earlier one."""
    seen, out = [], {}
    ordered = sorted({(r.doc_id is None, r.doc_id or 0, r.text) for r in rows if r.text is not None})
    for _, doc_id, text in ordered:
        kept = []
        for line in text.split("\n"):
            words = set(WORD.findall(line))
            similar = len(words) >= min_words and any(
                100 * len(words & s) >= percent * len(words | s) for s in seen
            )
            if len(words) >= min_words:
                seen.append(words)
            if not similar:
                kept.append(line)
        out[doc_id, text] = "\n".join(kept)
    return out


@pytest.mark.parametrize("percent", [80, 60])
def test_lines(documents, percent):
    rows = documents.collect()
    found = line_dedup(documents.withColumn("before", F.col("text")), percent=percent).collect()
    want = without_later_lines(rows, percent, 1)
    assert len(found) == len(rows)
    assert sum(r.n_removed for r in found) > 8
    for r in found:
        if r.before is None:
            assert r.text is None and r.n_lines == r.n_removed == 0
        else:
            assert r.text == want[r.doc_id or 0, r.before]
            assert r.n_lines == len(r.before.split("\n"))
            assert (r.row, r["size"], r.component) == (1, "x", "z")


def wrapped(text, width, mark=""):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_whole_licences_and_headers(spark):
    """Full texts, notices in comments, sentences over several lines and SPDX lines; prose with single words of them."""
    T = license_scan_module.TEMPLATES
    mit, isc = T["MIT"][1], T["ISC"][0]
    bsd2, bsd3, gpl, apache = T["BSD-2-Clause"][0], T["BSD-3-Clause"][1], T["GPL-3.0"][1], T["Apache-2.0"][1]
    code = "import os\nprint(os.name)\n" * 20
    mit_file = "MIT License\n\nCopyright (c) 2021 Some One\n\n" + wrapped(mit.removeprefix("MIT License Copyright (c) "), 78)
    want = {
        "/mit/LICENSE": (mit_file, "MIT", None),
        "/mit/src/a.py": (code, "MIT", "/mit"),
        "/isc/COPYING": (wrapped("Copyright 2020 Some One. " + isc, 60), "ISC", None),
        "/bsd2/LICENSE.txt": (wrapped("Copyright (c) 2019, Some One. All rights reserved. " + bsd2, 72), "BSD-2-Clause", None),
        "/bsd3/LICENSE.txt": (wrapped("Copyright (c) 2019, Some One. " + bsd3, 72), "BSD-3-Clause", None),
        "/x/gpl.c": ("/*\n" + wrapped(gpl, 66, " * ") + "\n */\n\n" + code, "GPL-3.0", None),
        "/x/apache.sh": ("#!/bin/sh\n\n" + wrapped(apache, 70, "# ") + "\n\n" + code, "Apache-2.0", None),
        "/x/spdx.rs": ("// SPDX-License-Identifier: MPL-2.0\n" + code, "MPL-2.0", None),
        "/x/broken.txt": ("words\nLicensed under the Apache\nLicense, Version 2.0.\nmore words", "Apache-2.0", None),
        "/x/prose.txt": ("A licence to print money, with copyright on every word.\n" * 9, None, None),
        "/x/long.txt": ("plain words without any of it " * 20000 + "\nReleased under the MIT License.", "MIT", None),
        "/y/z/none.py": (code, None, None),
    }
    files = spark.createDataFrame([(p, t, "x") for p, (t, _, _) in want.items()], "path string, text string, license string")
    found = {r.path: (r.license, r.inherited_from) for r in license_scan(files).collect()}
    assert found == {p: (name, up) for p, (_, name, up) in want.items()}


def test_licence_scores_against_plain_python(spark):
    """Cosine of log-weighted term counts, by hand; of equal scores the licence first by name wins."""
    templates = {"B": ("permission alpha beta",), "A": ("permission alpha beta",), "C": ("permission gamma gamma delta",)}
    texts = {"/1": "permission alpha beta", "/2": "Permission gamma delta gamma!", "/3": "permission alpha", "/4": "permission other words"}
    df = spark.createDataFrame(list(texts.items()), "path string, text string")
    found = {r.path: r for r in license_scan(df, templates=templates, min_score=0.1).collect()}
    lines = [re.findall("[a-z]+", t.lower()) for t in texts.values()]
    n = len(lines)
    idf = lambda t: math.log((n + 1) / (sum(t in x for x in lines) + 1)) + 1
    weigh = lambda ws: {t: (1 + math.log(k)) * idf(t) for t, k in Counter(ws).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for path, line in zip(texts, lines, strict=True):
        v, best = weigh(line), []
        for name, (text,) in templates.items():
            for words in (text.split(),):
                u = weigh(words)
                best.append((-round(sum(v[t] * u.get(t, 0) for t in v) / norm(v) / norm(u), 6), name))
        score, name = min(best)
        assert (found[path].license, pytest.approx(found[path].own_score, abs=2e-6)) == (name, -score)


def test_licences(spark):
    files = spark.createDataFrame(
        [
            ("/a/LICENSE", "Released under the MIT License.\n"),
            ("/a/LICENSE.old", "nothing to see"),
            ("/a/b/c/x.txt", "words"),
            ("/a/b/c/x.txt", "words"),
            ("/a/b/y.txt", "text\nLicensed under the  Apache License, Version 2.0."),
            ("/a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
            ("/a/b/c/d/z.txt", None),
            ("/ab/x.txt", "copyright someone else entirely, and more words"),
            ("/e/x.txt", ""),
            (None, "All rights reserved."),
        ],
        "path string, text string",
    )
    found = {(r.path, r.own_license, r.license, r.inherited_from) for r in license_scan(files).collect()}
    assert found == {
        ("/a/LICENSE", "MIT", "MIT", None),
        ("/a/LICENSE.old", None, "MIT", "/a"),
        ("/a/b/c/x.txt", None, "GPL-3.0", "/a/b"),
        ("/a/b/y.txt", "Apache-2.0", "Apache-2.0", None),
        ("/a/b/COPYING", "GPL-3.0", "GPL-3.0", None),
        ("/a/b/c/d/z.txt", None, "GPL-3.0", "/a/b"),
        ("/ab/x.txt", None, None, None),
        ("/e/x.txt", None, None, None),
        (None, "LicenseRef-All-Rights-Reserved", "LicenseRef-All-Rights-Reserved", None),
    }
    assert license_scan(files).count() == 10


def test_terms_of_a_long_licence_file_are_kept_under_a_digest(spark):
    """A block of n terms must not be stored and shuffled n times over."""
    text = "All rights reserved. " + " ".join(f"word{i}" for i in range(3000))
    files = spark.createDataFrame([("/a/LICENSE", text), ("/a/b.py", "x")], "path string, text string")
    scratch = Scratch(spark)
    found = {r.path: r.license for r in license_scan(files, scratch).collect()}
    tf = spark.read.parquet(f"{scratch.root}/tf")
    assert tf.count() > 3000 and tf.filter("octet_length(line) > 32").count() == 0
    assert set(found) == {"/a/LICENSE", "/a/b.py"}


def test_a_part_of_the_line_join_is_stored_before_the_next_begins(spark):
    scratch = Scratch(spark)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    begun = []

    def part_of(part):
        begun.append([spark.read.parquet(f"{scratch.root}/some_{i}").count() for i in range(part)])
        return pairs.filter(line_dedup_module._in_part("a", 3, part))

    whole = line_dedup_module.in_parts(scratch, "some", 3, part_of)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, pairs.collect()))
    assert [len(x) for x in begun] == [0, 1, 2] and all(n > 0 for n in begun[2])


def test_lines_of_a_large_group_meet_few_others(spark, monkeypatch):
    """A line needs one earlier partner, so pairs whose words are compared grow as the lines, not as their square."""
    common = " ".join(f"common{i}" for i in range(40))
    texts = [f"{common} own{i}" for i in range(60)] + [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    compared, compare = [], line_dedup_module.similar_to_earlier

    def counted(pairs, contents, percent):
        compared.append(pairs.count())
        return compare(pairs, contents, percent)

    monkeypatch.setattr(line_dedup_module, "similar_to_earlier", counted)
    found = {r.doc_id: r.n_removed for r in line_dedup(docs).collect()}
    assert found == {i: int(0 < i < 60) for i in range(120)}
    assert sum(compared) <= 4 * len(texts)


def test_words_of_a_line_are_split_at_any_white_space(spark):
    lines = ["a  b", " a\tb ", "a\x0bb\x0c", "\r a \r b", "a b", "ab"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i long, body string")
    found = {r.i: r.w for r in df.select("i", line_dedup_module.line_words(F.col("body")).alias("w")).collect()}
    assert [found[i] for i in range(len(lines))] == [WORD.findall(x) for x in lines]


def test_halves_of_the_sketch_hold_for_sets_on_either_side_of_short(spark):
    """Sets of up to SHORT words have one half of the sketch, longer ones two; similar ones still meet."""
    n = line_dedup_module.SHORT
    texts = [" ".join(f"k{i}" for i in range(n + d)) for d in (6, -4, 3, 0, 1)]
    texts += [" ".join(f"q{i}v{j}" for j in range(n + i)) for i in range(4)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.n_removed for r in line_dedup(docs).collect()}
    assert found == {i: int(0 < i < 5) for i in range(9)}
