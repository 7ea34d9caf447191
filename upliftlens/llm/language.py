"""Language identification by character models with interpolated Kneser-Ney smoothing.

A language is a model of the next letter after the last three, inside a word. Counts of four-letter
windows over all training texts are made per slice and summed by Spark; the lower orders, discounts and
context totals are aggregates over the distinct windows. A model keeps all of them, as a file of sorted
hashes that Spark hands to the executors and that tasks map into memory, so it grows with the input. The
language with the lowest cross-entropy per letter wins; a text whose cross-entropy is far above what its
language has on its training texts is marked as rejected.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame

from upliftlens.llm.common import Scratch, map_arrow, mix64, slices, word_codes

ORDER = 4
BEGIN, END = "\x02", "\x03"
#: Rows of a model that the driver holds at a time while it writes the file.
SHARE = 2_000_000
#: Letters that count as independent evidence in a score.
EVIDENCE = 40
#: A text is rejected this many standard errors and bits per letter above its language's mean.
ERRORS, SLACK = 4.0, 0.5
UNKNOWN = "und"


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the distinct words of some texts.

    Returns the words as codes with the offsets of the texts, the characters of all windows (one row
    each), and the offsets of the words among the windows. Only runs of letters count, in lower case.
    """
    codes, offsets, vocabulary = word_codes(texts)
    runs = pc.replace_substring_regex(pc.utf8_lower(vocabulary), r"[^\pL]+", " ")
    runs = pc.utf8_trim(runs, " ").to_pylist()
    lead = BEGIN * (ORDER - 1)
    parts = ["".join([f"{lead}{run}{END}" for run in word.split(" ")]) if word else "" for word in runs]
    chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    real = chars != ord(BEGIN)
    at = np.flatnonzero(real)
    windows = np.stack([chars[at - k] for k in range(ORDER - 1, -1, -1)], axis=1) if len(at) else np.zeros((0, ORDER), np.uint32)
    bounds = np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum(lengths)])]
    return codes, offsets, windows, bounds


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of the columns, read from the last to the first."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns[::-1]:
        h = mix64(h * np.uint64(0x100000001B3) + c.astype(np.uint64) + np.uint64(1))
    return h


def _count(langs: list[str]):
    place = {lang: i for i, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes, offsets, windows, bounds = letters_of(batch.column("text"))
            if not len(windows):
                continue
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()])
            n_words = len(bounds) - 1
            of_word = np.repeat(lang, np.diff(offsets)) * n_words + codes
            times = np.bincount(of_word, minlength=len(langs) * n_words).reshape(len(langs), n_words)
            word = np.repeat(np.arange(n_words), np.diff(bounds))
            keys, first, inverse = np.unique(hashed([*windows.T]), return_index=True, return_inverse=True)
            grams = windows[first]
            joined = grams.ravel().astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            texts = np.array([joined[i : i + ORDER] for i in range(0, len(joined), ORDER)], object)
            for i, name in enumerate(langs):
                count = np.bincount(inverse, times[i][word], len(keys)).astype(np.int64)
                seen = np.flatnonzero(count)
                if len(seen):
                    yield pa.record_batch(
                        [pa.array([name] * len(seen)), pa.array(texts[seen], pa.string()), pa.array(count[seen])],
                        names=["lang", "gram", "n"],
                    )

    return run


def characters(grams: list[str], n: int) -> np.ndarray:
    """Texts of `n` characters as one row of codes each."""
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(grams), n)


def keys_of(chars: np.ndarray, kind: int) -> np.ndarray:
    """The keys of rows of characters: 2n for windows of n letters, 2n + 1 for contexts of such windows."""
    h = hashed([*chars.T]) if chars.shape[1] else np.zeros(len(chars), np.uint64)
    return mix64(h + np.uint64(kind + 1)).view(np.int64)


class Model:
    """Sorted hashes in a file: discounted counts of windows, totals and weights of contexts, of each language."""

    def __init__(self, langs: list[str], letters: int, size: int, file: str | None) -> None:
        self.langs, self.letters, self.size, self.file = langs, letters, size, file
        self.mean, self.spread = np.zeros(len(langs)), np.zeros(len(langs))
        self.table = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "table": None}

    def _values(self, chars: np.ndarray, kind: int, missing: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
        """The two numbers of each row of characters in each language."""
        if self.table is None:
            self.table = _mapped(SparkFiles.get(self.file) if self.file else None, self.size, "r")
        keys, lang, a, b = self.table
        wanted, inverse = np.unique(keys_of(chars, kind), return_inverse=True)
        first = np.searchsorted(keys, wanted)
        count = np.searchsorted(keys, wanted, side="right") - first
        row = np.repeat(np.arange(len(wanted)), count)
        at = np.arange(len(row)) + np.repeat(first - (np.cumsum(count) - count), count)
        out = [np.full((len(wanted), len(self.langs)), m) for m in missing]
        for values, column in zip(out, (a, b), strict=True):
            values[row, lang[at]] = column[at]
        return out[0][inverse], out[1][inverse]

    def bits(self, windows: np.ndarray) -> np.ndarray:
        """Minus log2 of the probability of each window's last letter in each language."""
        p = np.full((len(windows), len(self.langs)), 1.0 / self.letters)
        for n in range(1, ORDER + 1):
            own = windows[:, ORDER - n :]
            count, _ = self._values(own, 2 * n, (0.0, 0.0))
            total, weight = self._values(own[:, :-1], 2 * n + 1, (1.0, 1.0))
            p = count / total + weight * p
        return -np.log2(p)

    def score(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy per letter and rejection of each text."""
        codes, offsets, windows, bounds = letters_of(texts)
        rows, n_langs = len(offsets) - 1, len(self.langs)
        letters = np.concatenate([[0], np.cumsum(np.diff(bounds)[codes])])
        length = letters[offsets[1:]] - letters[offsets[:-1]]
        bits = np.zeros((rows, n_langs))
        if len(windows) and n_langs:
            _, first, inverse = np.unique(hashed([*windows.T]), return_index=True, return_inverse=True)
            per_window = np.concatenate([np.zeros((1, n_langs)), np.cumsum(self.bits(windows[first])[inverse], axis=0)])
            per_word = per_window[bounds[1:]] - per_window[bounds[:-1]]
            so_far = np.concatenate([np.zeros((1, n_langs)), np.cumsum(per_word[codes], axis=0)])
            bits = so_far[offsets[1:]] - so_far[offsets[:-1]]
        known = (length > 0) & (n_langs > 0)
        if not n_langs:
            none = np.zeros(rows)
            return [UNKNOWN] * rows, none, none, none > 0
        h = bits / np.maximum(length, 1)[:, None]
        best = h.argmin(axis=1)
        low = h[np.arange(rows), best]
        likely = np.exp2(-(h - low[:, None]) * np.minimum(length, EVIDENCE)[:, None])
        score = np.where(known, 1 / likely.sum(axis=1), 0.0)
        limit = self.mean[best] + ERRORS * self.spread[best] / np.sqrt(np.maximum(length, 1)) + SLACK
        names = [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return names, score, np.where(known, low, 0.0), known & (low > limit)


def _mapped(path: str | None, size: int, mode: str) -> list[np.ndarray]:
    """The columns of a model's file: key, language, and two numbers."""
    kinds, at, columns = (np.int64, np.int32, np.float64, np.float64), 0, []
    order = (0, 2, 3, 1)  # the widest first, so that all are aligned
    for i in order:
        columns.append(np.zeros(0, kinds[i]) if path is None else np.memmap(path, kinds[i], mode, at, (size,)))
        at += size * np.dtype(kinds[i]).itemsize
        mode = "r+" if mode == "w+" else mode
    return [columns[order.index(i)] for i in range(len(kinds))]


def _written(rows: DataFrame) -> tuple[int, str | None]:
    """The number of rows, and the name of the file with them in order of their keys that every executor gets.

    The driver holds one share of the keys at a time.
    """
    size = rows.count()
    if not size:
        return 0, None
    folder = tempfile.mkdtemp(prefix="model-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"model-{uuid.uuid4().hex}.bin")
    columns = _mapped(path, size, "w+")
    shares = -(-size // SHARE)
    bounds = [-(2**63) + (2**64 * i) // shares for i in range(shares)] + [2**63]
    at = 0
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = rows.filter(F.col("key").between(low, high - 1)).toArrow()
        read = [part[c].to_numpy() for c in ("key", "lang", "a", "b")]
        order = np.lexsort((read[1], read[0]))
        for column, values in zip(columns, read, strict=True):
            column[at : at + len(order)] = values[order]
        at += len(order)
    for column in columns:
        column.flush()
    rows.sparkSession.sparkContext.addFile(path)
    return size, os.path.basename(path)


def _keyed(langs: list[str]):
    place = {lang: i for i, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for kind in np.unique(kinds):
                part = batch.filter(pa.array(kinds == kind))
                keys = keys_of(characters(part.column("gram").to_pylist(), int(kind) // 2 - int(kind) % 2), int(kind))
                lang = np.array([place[x] for x in part.column("lang").to_pylist()], np.int32)
                yield pa.record_batch([pa.array(keys), pa.array(lang), part.column("a"), part.column("b")], names=["key", "lang", "a", "b"])

    return run


def _moments(model: Model):
    """Sums over training windows of what they cost in their own language, to tell its mean and spread."""
    place = {lang: i for i, lang in enumerate(model.langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            n = batch.column("n").to_numpy().astype(float)
            bits = model.bits(characters(batch.column("gram").to_pylist(), ORDER))[np.arange(len(lang)), lang]
            sums = [np.bincount(lang, n * x, len(place)) for x in (np.ones(len(n)), bits, bits * bits)]
            yield pa.record_batch([pa.array(np.arange(len(place))), *map(pa.array, sums)], names=["lang", "n", "x", "xx"])

    return run


def train(docs: DataFrame, scratch: Scratch | None = None) -> Model:
    """A model from all (text, lang) rows with a language, made of all their windows."""
    scratch = scratch or Scratch(docs.sparkSession)
    labelled = docs.select("text", "lang").filter("lang is not null and text is not null")
    langs = sorted(r.lang for r in labelled.select("lang").distinct().collect())
    counted = (
        map_arrow(labelled, _count(langs), "lang string, gram string, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    windows = scratch.save(counted, f"windows_{ORDER}")
    letters, rows = 1, None
    table = windows
    for n in range(ORDER, 0, -1):  # from the windows down; below them a count is one per distinct window
        if n < ORDER:
            shorter = table.groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
            table = scratch.save(shorter, f"windows_{n}")
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        share = F.when(ones > 0, ones / (ones + 2 * twos)).otherwise(0.5)
        discounts = F.broadcast(table.groupBy("lang").agg(F.least(F.greatest(share, F.lit(0.1)), F.lit(0.9)).alias("d")))
        total = F.sum("n").cast("double")
        contexts = table.groupBy("lang", F.substring("gram", 1, n - 1).alias("gram")).agg(
            total.alias("a"), F.count(F.lit(1)).alias("kinds")
        )
        counts = table.join(discounts, "lang").select(
            F.lit(2 * n).alias("kind"), "lang", "gram", (F.col("n") - F.least("d", "n")).alias("a"), F.lit(0.0).alias("b")
        )
        contexts = contexts.join(discounts, "lang").select(
            F.lit(2 * n + 1).alias("kind"), "lang", "gram", "a", (F.col("d") * F.col("kinds") / F.col("a")).alias("b")
        )
        rows = counts.union(contexts) if rows is None else rows.union(counts).union(contexts)
        if n == 1:
            letters += table.select("gram").distinct().count()
    keyed = map_arrow(rows, _keyed(langs), "key long, lang int, a double, b double")
    model = Model(langs, letters, *_written(scratch.save(keyed.sortWithinPartitions("key"), "model")))
    sums = map_arrow(windows, _moments(model), "lang long, n double, x double, xx double")
    for r in sums.groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("n", "x", "xx")]).filter("n > 0").collect():
        # rounded, as the order of addition changes the last digits
        model.mean[r.lang] = round(r.x / r.n, 9)
        model.spread[r.lang] = round(max(r.xx / r.n - (r.x / r.n) ** 2, 0.0) ** 0.5, 9)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of `docs`: doc_id, lang_pred, score, bits_per_letter, rejected.

    NULL texts and texts without letters are `und` with score 0, and so is everything if the model has no
    language. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, score, bits, rejected = model.score(batch.column("text"))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(bits), pa.array(rejected)],
                names=["doc_id", "lang_pred", "score", "bits_per_letter", "rejected"],
            )

    schema = f"doc_id {kind}, lang_pred string, score double, bits_per_letter double, rejected boolean"
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def held_out(doc_id: Column) -> Column:
    """The fold that training leaves out; a NULL id is in none."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
