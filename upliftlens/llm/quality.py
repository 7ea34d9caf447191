"""Quality rules: base counts of a text, and a likelihood ratio between trusted texts and the raw corpus.

Tokens are runs of letters, digits and other characters, or runs of ASCII marks. Single tokens and pairs are
hashed into a fixed number of buckets, and two multinomials are counted over them: one over all trusted texts, one
over all texts. A text's score is the mean, over its n-grams, of the logarithm of the ratio of the two. Scores are
sums of whole millionths, so they don't depend on the order of addition.

The limit comes from the trusted texts: each is scored with itself taken out of the trusted counts, and the limit
lies as far below their lower quartile as Tukey's outer fence. A text under the limit is unlike all that is trusted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upliftlens.llm.arrays import byte_table, owners, text_bytes, texts_of
from upliftlens.llm.common import Scratch, hashed_members, map_arrow, slices, word_codes

BUCKETS = 1 << 15
PAIR = 1000003
SYMBOLS = r"[#*$%&|<>]"
#: Scores are compared in steps of one thousandth.
STEPS = 1000
#: The outer fence.
FENCE = 3

_SPACES = byte_table(bytes(c for c in range(128) if c != 32 and not 9 <= c <= 13), lower=False)
_WORD = byte_table(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", lower=False) != 32


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Runs of word characters and runs of marks as codes, offsets of the rows, the distinct runs."""
    data, offsets = text_bytes(texts)
    kind = np.where(_WORD[data], 2, np.where(_SPACES[data] != 32, 1, 0)).astype(np.int8)
    change = np.flatnonzero((kind[1:] + kind[:-1] == 3)) + 1  # a run of marks meets a run of word characters
    spaced = np.insert(_SPACES[data], change, 32)
    return word_codes(texts_of(spaced, offsets + np.searchsorted(change, offsets)))


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the texts' single tokens and pairs, and the row that each belongs to."""
    codes, offsets, vocabulary = tokens(texts)
    md5, distinct = hashlib.md5, vocabulary.cast(pa.large_binary()).to_pylist()
    hashed = np.frombuffer(b"".join([md5(t).digest()[:4] for t in distinct]), ">u4").astype(np.int64)
    h = hashed[codes] if len(codes) else hashed
    row = owners(offsets)
    within = row[1:] == row[:-1]
    pairs = (h[:-1] * PAIR + h[1:])[within]
    return np.concatenate([h % BUCKETS, pairs % BUCKETS]), np.concatenate([row, row[:-1][within]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many n-grams of a task's texts fall into each bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in slices(batches):
        total += np.bincount(grams(batch.column("text"))[0], minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])


def counts(texts: DataFrame) -> np.ndarray:
    """The n-grams of all texts by bucket: a fixed number of counts, whatever the size of the table."""
    counted = map_arrow(texts.select("text"), _count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in counted.collect():
        out[r.bucket] = r.n
    return out


def ratios(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """For each bucket the logarithm of the ratio of the smoothed shares, in millionths."""
    low, high = math.log(int(trusted.sum()) + BUCKETS), math.log(int(raw.sum()) + BUCKETS)
    return np.rint(1e6 * ((np.log(trusted + 1.0) - low) - (np.log(raw + 1.0) - high))).astype(np.int64)


def _left_out(trusted: np.ndarray, raw: np.ndarray):
    """The scores of trusted texts, each without its own share of the trusted counts, in steps."""
    total, high = int(trusted.sum()), np.log(raw + 1.0) - math.log(int(raw.sum()) + BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bucket, row = grams(batch.column("text"))
            keys, n = np.unique(row * BUCKETS + bucket, return_counts=True)
            row, bucket = keys // BUCKETS, keys % BUCKETS
            size = np.bincount(row, weights=n, minlength=batch.num_rows).astype(np.int64)
            others = np.log(np.maximum(total - size, 0) + float(BUCKETS))
            each = np.rint(1e6 * ((np.log(np.maximum(trusted[bucket] - n, 0) + 1.0) - others[row]) - high[bucket])).astype(np.int64)
            full = np.zeros(batch.num_rows, np.int64)
            np.add.at(full, row, each * n)
            some = size > 0
            yield pa.record_batch([pa.array(full[some] * STEPS // (size[some] * 1_000_000))], names=["step"])

    return run


def fence(scores: DataFrame) -> float:
    """The limit of scores given in steps; minus infinity without any. Steps are few, so they are counted."""
    counted = sorted(map(tuple, scores.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()))
    if not counted:
        return -math.inf
    total, low, high, seen = sum(n for _, n in counted), None, None, 0
    for step, n in counted:
        seen += n
        low = step if low is None and 4 * seen >= total else low
        high = step if high is None and 4 * seen >= 3 * total else high
    return (low - FENCE * (high - low)) / STEPS


def base_counts(texts: pa.Array) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    texts = pc.fill_null(texts, "")
    rows = len(texts)
    codes, offsets, vocabulary = word_codes(texts)
    n, row = np.diff(offsets), owners(offsets)
    length = pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.zeros(rows, np.int64)
    np.add.at(chars, row, length[codes] if len(codes) else np.zeros(0, np.int64))
    symbols = pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64)

    split = pc.split_pattern(texts, "\n")
    lines = split.flatten().dictionary_encode()
    real = ~pc.match_substring_regex(lines.dictionary, r"^[\x20\x09-\x0D]*$").to_numpy(zero_copy_only=False)
    line = lines.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of = owners(np.asarray(split.offsets, np.int64) - split.offsets[0].as_py())
    of, line = of[real[line]], line[real[line]]
    different = np.unique(of * max(1, len(lines.dictionary)) + line) // max(1, len(lines.dictionary))
    dup = np.bincount(of, minlength=rows) - np.bincount(different, minlength=rows)

    # windows of three words: pairs get numbers, then pairs and the word after them
    repeated = np.zeros(len(codes), bool)
    if len(codes) > 2:
        word = codes.astype(np.int64)
        inside = np.flatnonzero(row[:-2] == row[2:])
        _, pair = np.unique(word[inside] * len(vocabulary) + word[inside + 1], return_inverse=True)
        _, window = np.unique(pair * len(vocabulary) + word[inside + 2], return_inverse=True)
        _, own, times = np.unique(row[inside] * (len(codes) + 1) + window, return_inverse=True, return_counts=True)
        again = inside[times[own] > 1]
        for k in range(3):
            repeated[again + k] = True
    return [n, chars, symbols, dup, np.bincount(row[repeated], minlength=rows)]


def _judge(llr: np.ndarray, limit: float, min_words: int, max_repeat: int):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = base_counts(batch.column("text"))
            failed = (found[0] < min_words) | (100 * found[4] > max_repeat * found[0])
            bucket, row = grams(batch.column("text"))
            size, full = np.bincount(row, minlength=batch.num_rows), np.zeros(batch.num_rows, np.int64)
            np.add.at(full, row, llr[bucket])
            score = full / np.maximum(size, 1) / 1e6
            columns = [pa.array(x.astype(np.int64)) for x in found] + [pa.array(x) for x in (failed, ~failed & (score >= limit), score)]
            yield pa.record_batch([batch.column("doc_id"), *columns], names=["doc_id", *names, "base_failed", "kept", "score"])

    return run


def quality_rules(
    docs: DataFrame, trusted: DataFrame, scratch: Scratch | None = None, min_words: int = 50, max_repeat: int = 50
) -> DataFrame:
    """(doc_id, text) and the doc_ids of trusted texts -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, score, one row per row of `docs`.

    base_failed: fewer than `min_words` words, or more than `max_repeat` percent of them in repeated windows. kept:
    not failed, and the score reaches the limit that the trusted texts set. NULL counts as empty: no words, score
    0, failed. Rows that repeat a doc_id are judged each, and are all trusted if the id is; a NULL id never is.
    Without trusted texts, or without any n-gram, only the base rules decide. Other columns are ignored. Both
    counts and the limit cover all texts; trusted texts move once, to meet their ids.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    ids = scratch.save(trusted.select("doc_id").filter("doc_id is not null").distinct(), "trusted_ids")
    maybe = texts.filter(hashed_members(ids, "doc_id")(F.col("doc_id")) & (F.col("text") != ""))
    # by a shuffle at every size, as the ids grow with the table
    known = scratch.save(maybe.join(ids.hint("merge"), "doc_id", "left_semi").select("text"), "trusted")
    good, raw = counts(known), counts(texts)
    limit = fence(map_arrow(known, _left_out(good, raw), "step long"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, score double"
    )
    return map_arrow(texts, _judge(ratios(good, raw), limit, min_words, max_repeat), schema)
