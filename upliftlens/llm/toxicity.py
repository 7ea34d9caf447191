"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A word is read twice: as a hashed embedding, and letter by letter by a small network of the same kind.
The network over words reads windows that overlap, all of a text, and the highest window decides: one
abusive sentence makes a long text toxic. Training takes a bounded sample of labelled texts. At first any
window of a text carries its label; later its highest does, and for clean texts a random one too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upliftlens.llm.common import map_arrow, slices, word_codes

WINDOW, STRIDE = 32, 24
LETTERS, WORDS = 1024, 4096
LETTER_DIM, WORD_DIM, HIDDEN = 8, 8, 8
PUNCTUATION = ".,;:!?\"'()[]{}<>|*%$#&-"
#: Words whose letters have been read, kept in a worker.
KEPT = 200_000
#: Windows read at a time.
BLOCK = 4096


@dataclass(frozen=True)
class Training:
    """The bounds of the sample and of the work on it."""

    texts_per_class: int = 1500
    max_chars: int = 4000
    long_chars: int = 24000
    steps: int = 500
    batch: int = 24
    rate: float = 0.015
    word_rate: float = 4.0
    any_window: float = 0.5
    seed: int = 11


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def _direction(gates: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool):
    """Run one direction over gates (T, N, 3H); states (T, N, H) and what the way back needs."""
    steps, n, width = gates.shape
    hidden = width // 3
    h = np.zeros((n, hidden), np.float32)
    states = np.empty((steps, n, hidden), np.float32)
    saved = []
    for t in range(steps):
        g = h @ u
        zr = sigmoid(gates[t, :, : 2 * hidden] + g[:, : 2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        c = np.tanh(gates[t, :, 2 * hidden :] + r * g[:, 2 * hidden :])
        m = mask[t][:, None]
        new = h + m * (1 - z) * (c - h)
        if keep:
            saved.append((h, z, r, c, g[:, 2 * hidden :], m))
        h = new
        states[t] = h
    return states, saved


def _direction_back(d_states: np.ndarray, saved: list, u: np.ndarray):
    """Gradients of the gates and of u."""
    steps, n, hidden = d_states.shape
    d_gates = np.zeros((steps, n, 3 * hidden), np.float32)
    d_u = np.zeros_like(u)
    d_h = np.zeros((n, hidden), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, c, gc, m = saved[t]
        d = d_h + d_states[t]
        d_new = d * m
        d_c = d_new * (1 - z) * (1 - c * c)
        d_z = d_new * (h - c) * z * (1 - z)
        d_r = d_c * gc * r * (1 - r)
        d_gates[t] = np.concatenate([d_z, d_r, d_c], axis=1)
        d_g = np.concatenate([d_z, d_r, d_c * r], axis=1)
        d_u += h.T @ d_g
        d_h = d * (1 - m) + d_new * z + d_g @ u.T
    return d_gates, d_u


class Reader:
    """One bidirectional network with attention pooling over rows (T, N) of input ids."""

    def __init__(self, rng: np.random.Generator, inputs: int, name: str, p: dict[str, np.ndarray]) -> None:
        self.name, self.p = name, p
        for d in "fb":
            p[f"{name}_w{d}"] = rng.normal(0, 0.4 / np.sqrt(inputs / 8), (inputs, 3 * HIDDEN)).astype(np.float32)
            p[f"{name}_u{d}"] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
            p[f"{name}_b{d}"] = np.zeros(3 * HIDDEN, np.float32)
        p[f"{name}_v"] = rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32)

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gates that an input gives, once for each distinct input."""
        p, k = self.p, self.name
        return x @ p[f"{k}_wf"] + p[f"{k}_bf"], x @ p[f"{k}_wb"] + p[f"{k}_bb"]

    def read(self, gates: tuple[np.ndarray, np.ndarray], ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Pooled states (N, 2H) of the rows."""
        p, k = self.p, self.name
        f, save_f = _direction(gates[0][ids], mask, p[f"{k}_uf"], keep)
        b, save_b = _direction(gates[1][ids][::-1], mask[::-1], p[f"{k}_ub"], keep)
        h = np.concatenate([f, b[::-1]], axis=2)
        e = np.where(mask > 0, h @ p[f"{k}_v"], np.float32(-1e9))
        a = np.exp(e - e.max(axis=0)) * mask
        a /= np.maximum(a.sum(axis=0), np.float32(1e-9))
        pooled = np.einsum("tn,tnh->nh", a, h)
        return pooled, (h, a, pooled, save_f, save_b)

    def back(self, d_pooled: np.ndarray, kept, x: np.ndarray, ids: np.ndarray, grads: dict[str, np.ndarray]) -> np.ndarray:
        """Add the gradients of the parameters; the gradient of the distinct inputs x."""
        p, k = self.p, self.name
        h, a, pooled, save_f, save_b = kept
        d_h = a[:, :, None] * d_pooled[None]
        d_e = a * (np.einsum("tnh,nh->tn", h, d_pooled) - np.einsum("nh,nh->n", pooled, d_pooled)[None])
        grads[f"{k}_v"] += np.einsum("tn,tnh->h", d_e, h)
        d_h += d_e[:, :, None] * p[f"{k}_v"]
        d_x = np.zeros_like(x)
        backward = d_h[::-1, :, HIDDEN:]
        for d, d_states, saved, order in (("f", d_h[:, :, :HIDDEN], save_f, ids), ("b", backward, save_b, ids[::-1])):
            d_gates, d_u = _direction_back(d_states, saved, p[f"{k}_u{d}"])
            grads[f"{k}_u{d}"] += d_u
            flat = np.zeros((len(x), 3 * HIDDEN), np.float32)
            np.add.at(flat, order.ravel(), d_gates.reshape(-1, 3 * HIDDEN))
            grads[f"{k}_w{d}"] += x.T @ flat
            grads[f"{k}_b{d}"] += flat.sum(axis=0)
            d_x += flat @ p[f"{k}_w{d}"].T
        return d_x


class Network:
    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        self.p["letters"] = rng.normal(0, 0.5, (LETTERS, LETTER_DIM)).astype(np.float32)
        self.p["words"] = np.zeros((WORDS, WORD_DIM), np.float32)  # a word that training lacks says nothing
        self.by_letter = Reader(rng, LETTER_DIM, "l", self.p)
        self.by_word = Reader(rng, WORD_DIM + 2 * HIDDEN, "w", self.p)
        self.p["out"] = rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)
        self.shift = 0.0
        self.base_rate = 0.5

    def word_inputs(self, words: list[str], keep: bool = False):
        """Inputs of distinct words (V, WORD_DIM + 2H); words of like length are read together."""
        hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) % WORDS for w in words), np.int64, len(words))
        x = np.empty((len(words), WORD_DIM + 2 * HIDDEN), np.float32)
        x[:, :WORD_DIM] = self.p["words"][hashed]
        gates = self.by_letter.project(self.p["letters"])
        length = np.fromiter(map(len, words), np.int64, len(words))
        groups = np.ceil(np.log2(np.maximum(length, 4))).astype(int)
        kept = []
        for g in np.unique(groups):
            every = np.flatnonzero(groups == g)
            for start in range(0, len(every), BLOCK):
                rows = every[start : start + BLOCK]
                ids, mask = _letters([words[i] for i in rows], length[rows])
                pooled, saved = self.by_letter.read(gates, ids, mask, keep)
                x[rows, WORD_DIM:] = pooled
                if keep:
                    kept.append((rows, ids, saved))
        return x, (hashed, kept)

    def window_logits(self, gates, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logits of windows (T, N)."""
        out = np.empty(ids.shape[1], np.float32)
        for s in range(0, ids.shape[1], BLOCK):
            pooled, _ = self.by_word.read(gates, ids[:, s : s + BLOCK], mask[:, s : s + BLOCK])
            out[s : s + BLOCK] = pooled @ self.p["out"] + self.p["bias"]
        return out

    def learn(self, x, words_kept, ids, mask, labels, weights) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss of windows."""
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        pooled, kept = self.by_word.read(self.by_word.project(x), ids, mask, keep=True)
        logit = pooled @ self.p["out"] + self.p["bias"]
        d = (sigmoid(logit) - labels) * weights
        grads["out"] += d @ pooled
        grads["bias"] += d.sum()
        d_x = self.by_word.back(d[:, None] * self.p["out"][None], kept, x, ids, grads)
        hashed, letter_kept = words_kept
        np.add.at(grads["words"], hashed, d_x[:, :WORD_DIM])
        for rows, letter_ids, saved in letter_kept:
            grads["letters"] += self.by_letter.back(d_x[rows, WORD_DIM:], saved, self.p["letters"], letter_ids, grads)
        return grads


def _letters(words: list[str], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letters (T, N) and their mask."""
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % LETTERS
    steps = max(1, int(length.max()))
    place = np.arange(steps)[:, None]
    mask = place < length[None]
    ids = np.zeros(mask.shape, np.int64)
    begins = np.cumsum(length) - length
    ids[mask] = chars[(begins[None] + place)[mask]]
    return ids, mask.astype(np.float32)


def _windows(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts: word codes (T, N), mask, and the text of each."""
    length = np.diff(offsets)
    n = np.where(length > 0, 1 + np.maximum(0, -(-(length - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(length)), n)
    index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = offsets[:-1][text] + index * STRIDE
    place = begin[None] + np.arange(WINDOW)[:, None]
    mask = place < offsets[1:][text][None]
    ids = codes[np.minimum(place, max(len(codes) - 1, 0))] if len(codes) else np.zeros(place.shape, np.int64)
    return np.where(mask, ids, 0), mask.astype(np.float32), text


def _plain(vocabulary: pa.Array) -> list[str]:
    """Words in lower case without punctuation around them."""
    return pc.utf8_trim(pc.utf8_lower(vocabulary), PUNCTUATION).to_pylist()


def fit(texts: list[str], labels: np.ndarray, base_rate: float, how: Training) -> Network:
    """A network trained on a sample; `base_rate` is the share of label 1 that scores should assume."""
    net, rng = Network(how.seed), np.random.default_rng(how.seed)
    net.base_rate = base_rate
    labels = np.asarray(labels, np.float32)
    classes = [np.flatnonzero(labels == c) for c in (0, 1)]
    if not all(len(c) for c in classes):
        net.p["out"][:] = 0
        net.base_rate = float(labels.mean()) if len(labels) else base_rate
        net.p["bias"][:] = _logit(net.base_rate)
        return net
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, how.steps + 1):
        rows = np.concatenate([rng.choice(c, how.batch // 2) for c in classes])
        codes, offsets, vocabulary = word_codes(pa.array([texts[i] for i in rows]))
        if not len(codes):
            continue
        x, kept = net.word_inputs(_plain(vocabulary), keep=True)
        ids, mask, text = _windows(codes, offsets)
        logits = net.window_logits(net.by_word.project(x), ids, mask)
        chosen = []
        for i, row in enumerate(rows):
            own = np.flatnonzero(text == i)
            if not len(own):
                continue
            if step <= how.steps * how.any_window:
                chosen += [(w, labels[row]) for w in rng.permutation(own)[:3]]
            else:
                chosen.append((own[logits[own].argmax()], labels[row]))
                if not labels[row]:
                    chosen.append((rng.choice(own), 0.0))
        pick = np.array([c for c, _ in chosen])
        target = np.array([y for _, y in chosen], np.float32)
        weight = np.full(len(pick), 1 / len(pick), np.float32)
        grads = net.learn(x, kept, ids[:, pick], mask[:, pick], target, weight)
        rate = how.rate * min(1.0, 3 * (1 - step / (how.steps + 1)))
        # Plain steps for words: one that many texts share moves far, one of a single text hardly.
        net.p["words"] -= np.float32(how.word_rate * rate / how.rate) * grads.pop("words")
        for k, g in grads.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            net.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    # the batches hold as many of either class; scores should hold for the share that the labels have
    net.shift = _logit(base_rate)
    return net


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return float(np.log(p / (1 - p)))


class Scorer:
    """A network with the words that its worker has met."""

    def __init__(self, net: Network) -> None:
        self.net, self.place = net, {}
        self.gates = tuple(np.zeros((0, 3 * HIDDEN), np.float32) for _ in range(2))

    def _gates(self, words: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        if len(self.place) > KEPT:
            self.place, self.gates = {}, tuple(g[:0] for g in self.gates)
        fresh = [w for w in dict.fromkeys(words) if w not in self.place]
        if fresh:
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh)), strict=True))
            more = self.net.by_word.project(self.net.word_inputs(fresh)[0])
            self.gates = tuple(np.concatenate([g, m]) for g, m in zip(self.gates, more, strict=True))
        rows = np.fromiter((self.place[w] for w in words), np.int64, len(words))
        # the words of a slice side by side stay in the cache
        return tuple(g[rows] for g in self.gates), rows

    def score(self, texts: pa.Array) -> np.ndarray:
        codes, offsets, vocabulary = word_codes(texts)
        out = np.full(len(offsets) - 1, -np.inf)
        if len(codes):
            gates, _ = self._gates(_plain(vocabulary))
            ids, mask, text = _windows(codes.astype(np.int64), offsets)
            np.maximum.at(out, text, self.net.window_logits(gates, ids, mask))
        logit = np.where(np.isfinite(out), out + self.net.shift, _logit(self.net.base_rate))
        return 1 / (1 + np.exp(-logit.astype(float)))


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Network:
    """Train on labelled texts: (doc_id, text) and (doc_id, toxic), NULL labels and ids left out.

    The sample has the first `texts_per_class` texts of each class in an order by hash, those with at most
    `max_chars` characters before longer ones; of a text beyond `long_chars` it has that many characters from its
    beginning, middle and end. The driver holds the sample. An id with several labels counts as toxic if one
    says so. Without texts of both classes, every score is the share of label 1, or a half.
    """
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = marks.agg(F.avg("toxic")).first()[0]
    long = F.length("text") > how.max_chars
    # lengths and not texts meet the labels; a repeated id stands for the first of its texts
    sized = docs.select("doc_id", long.alias("long"), F.xxhash64("text").alias("th")).filter(F.col("text").isNotNull())
    sized = sized.join(marks, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("long", "th")).alias("t"))
    order = [F.col("t.long"), F.xxhash64("doc_id", F.lit(how.seed)), F.col("doc_id")]
    picked = [sized.filter(F.col("toxic") == c).orderBy(*order).limit(how.texts_per_class) for c in (0, 1)]
    # a few thousand ids at most
    chosen = F.broadcast(picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("picked"), "toxic", F.col("t.th").alias("th")))
    third = how.long_chars // 3
    middle = F.substring(F.col("text"), (F.length("text") / 2).cast("int") - third // 2, F.lit(third))
    parts = F.concat_ws(" ", F.left("text", F.lit(third)), middle, F.right("text", F.lit(third)))
    sample = (
        docs.select("doc_id", "text")
        .join(chosen, (F.xxhash64("text") == F.col("th")) & (F.col("doc_id") == F.col("picked")))
        .select("doc_id", F.when(F.length("text") > how.long_chars, parts).otherwise(F.col("text")).alias("text"), "toxic")
        .dropDuplicates(["doc_id", "text"])
        .orderBy("doc_id", "text")
        .toArrow()
    )
    return fit(sample["text"].to_pylist(), sample["toxic"].to_numpy(), 0.5 if share is None else float(share), how)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """The columns of `docs` and score (0 to 1); one that is called score is replaced.

    NULL and empty texts get the share of label 1 in training.
    """
    docs = docs.drop("score")
    schema = docs.withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in slices(batches, max_bytes=2_000_000):
            yield pa.record_batch([*batch.columns, pa.array(scorer.score(batch.column("text")))], names=[*batch.schema.names, "score"])

    return map_arrow(docs, run, schema)


def held_out(doc_id: Column) -> Column:
    """The fold that training leaves out; a NULL id is in none."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
