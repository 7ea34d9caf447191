"""Byte-level BPE over a public vocabulary: encoding, decoding and digests of both.

A text is cut into pre-tokens by the tokenizer's pattern. A pre-token that is in the vocabulary is found
by a minimal perfect hash; any other is merged byte by byte, with the next merge on top of a heap and the
bytes in a linked list, so a pre-token of n bytes takes n log n steps; a few bytes need no heap. Equal stretches of text are encoded
once for each slice of a batch, and recent ones are kept in the worker until its task ends.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame

from upliftlens.llm.common import map_arrow, slices

#: Stretches kept in a worker; when there are as many again, the older ones go.
KEPT = 250_000
#: Longer stretches are not kept.
KEPT_CHARS = 64
#: Pre-tokens kept in a worker, likewise: the same word stands before a space, a comma or a full stop.
KEPT_PIECES = 150_000
#: Pre-tokens of at most so many bytes are merged without a heap, and what stands for a pair that is no token there.
SHORT = 32
NO_RANK = 1 << 62
#: Two white-space characters in a row; texts with such runs are cut by the pattern as a whole.
RUNS = r"[\t-\r\x85\p{Z}][\t-\r\x85\p{Z}]"


class PerfectHash:
    """A minimal perfect hash of the vocabulary: hash and displace.

    A key falls into a bucket; the bucket's displacement sends its keys to slots that no other key has.
    Buckets are placed from the fullest down. A bucket of one key holds its slot itself.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = max(1, len(ranks))
        self.buckets = max(1, self.size // 2)
        self.shift = [0] * self.buckets
        self.slots: list[tuple[bytes, int]] = [(b"", -1)] * self.size
        members: dict[int, list[tuple[int, bytes]]] = {}
        for key in ranks:
            h = xxhash.xxh3_64_intdigest(key)
            members.setdefault(h % self.buckets, []).append((h, key))
        free = bytearray(b"\x01" * self.size)
        unused = self.size - 1
        for bucket, keys in sorted(members.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(keys) == 1:
                while not free[unused]:
                    unused -= 1
                places, d = [unused], -unused - 1
            else:
                d = 0
                while True:
                    places = [self._place(h, d) for h, _ in keys]
                    if len(set(places)) == len(places) and all(free[p] for p in places):
                        break
                    d += 1
            self.shift[bucket] = d
            for place, (_, key) in zip(places, keys, strict=True):
                free[place] = 0
                self.slots[place] = (key, ranks[key])

    def _place(self, h: int, d: int) -> int:
        x = (h + d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (x >> 17) % self.size

    def get(self, key: bytes) -> int:
        """The rank of a key, -1 if it is not in the vocabulary."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        found, rank = self.slots[-d - 1 if d < 0 else self._place(h, d)]
        return rank if found == key else -1


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token: the lowest rank merges first, of equal ones the leftmost."""
    n = len(piece)
    if n <= SHORT:
        return merged_short(piece, ranks)
    follow, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        right = follow[i]
        # stale if the left part has gone, or either part has grown since
        if ends[i] < 0 or right >= n or ends[right] != end or ends[i] != right:
            continue
        ends[i], ends[right] = end, -1
        follow[i] = after = follow[right]
        if after < n:
            before[after] = i
            rank = ranks.get(piece[i : ends[after]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, ends[after]))
        left = before[i]
        if left >= 0:
            rank = ranks.get(piece[left:end])
            if rank is not None:
                heapq.heappush(heap, (rank, left, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = follow[i]
    return out


def merged_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As `merged`, for a few bytes: a look over the ranks of all neighbours takes less time than a heap and its links."""
    get = ranks.get
    cuts = list(range(len(piece) + 1))
    pairs = [get(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
    while pairs:
        least = min(pairs)
        if least == NO_RANK:
            break
        i = pairs.index(least)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(piece[cuts[i] : cuts[i + 2]], NO_RANK)
        if i:
            pairs[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], NO_RANK)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]


class Codec:
    """Encoder and decoder of one vocabulary, with what a worker keeps."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.whole = PerfectHash(ranks)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.decimal = {rank: str(rank) for rank in ranks.values()}
        self.pieces: dict[str, list[int]] = {}
        self.older_pieces: dict[str, list[int]] = {}
        self.split = regex.compile(pattern).findall
        self.recent: dict[str, tuple[list[int], str, bytes]] = {}
        self.older: dict[str, tuple[list[int], str, bytes]] = {}

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.split(text):
            found = self.pieces.get(piece)
            ids += self.missed(piece) if found is None else found
        return ids

    def missed(self, piece: str) -> list[int]:
        """The ids of a pre-token that the worker has not met lately."""
        found = self.older_pieces.get(piece)
        if found is None:
            body = piece.encode()
            rank = self.whole.get(body)
            found = [rank] if rank >= 0 else merged(body, self.ranks)
        if len(piece) <= KEPT_CHARS:
            if len(self.pieces) >= KEPT_PIECES:
                self.older_pieces, self.pieces = self.pieces, {}
            self.pieces[piece] = found
        return found

    def forget(self) -> None:
        """Let go of what was kept."""
        for kept in (self.pieces, self.older_pieces, self.recent, self.older):
            kept.clear()

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def stretch(self, text: str) -> tuple[list[int], str, bytes]:
        """Of a stretch that no pre-token leaves: ids, the ids in decimal, and what they decode to."""
        found = self.recent.get(text)
        if found is None:
            found = self.older.get(text)
            if found is None:
                ids = self.encode(text)
                found = ids, ",".join([self.decimal[i] for i in ids]), self.decode(ids)
            if len(text) <= KEPT_CHARS:
                if len(self.recent) >= KEPT:
                    self.older, self.recent = self.recent, {}
                self.recent[text] = found
        return found

    def texts(self, texts: pa.Array) -> Iterator[list[tuple[list[int], str, bytes]]]:
        """For each text its stretches: a space begins a new one where no other white space is near."""
        texts = pc.fill_null(texts, "")
        runs = pc.match_substring_regex(texts, RUNS).to_pylist()
        parts = pc.split_pattern(texts, " ")
        flat = parts.flatten().dictionary_encode()
        codes = flat.indices.to_numpy(zero_copy_only=False)
        offsets = np.asarray(parts.offsets, dtype=np.int64) - parts.offsets[0].as_py()
        spaced: list = [None] * len(flat.dictionary)
        words = flat.dictionary.to_pylist()
        for row, run in enumerate(runs):
            if run:
                yield [self.stretch(texts[row].as_py())]
                continue
            own = codes[offsets[row] : offsets[row + 1]].tolist()
            out = [self.stretch(words[own[0]])] if words[own[0]] else []
            for code in own[1:]:
                if spaced[code] is None:
                    spaced[code] = self.stretch(" " + words[code])
            yield out + [spaced[code] for code in own[1:]]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def _codec(packed: bytes, pattern: str) -> Codec:
    ranks = {}
    for line in packed.split(b"\n"):
        token, rank = line.split()
        ranks[base64.b64decode(token)] = int(rank)
    return Codec(ranks, pattern)


def _packed(path: str) -> bytes:
    """The rank file as it goes to the tasks: tens of thousands of tokens, whatever the input's size."""
    with open(path, "rb") as lines:
        return lines.read().strip()


@contextmanager
def _one_task(codec: Codec):
    """What a worker keeps holds no cycles, and the search for them would go through all of it again and again.

    It goes with the task: workers live on through the stages that follow, beside a heap that has grown.
    """
    gc.disable()
    try:
        yield
    finally:
        codec.forget()
        gc.enable()


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) -> doc_id, ids. NULL counts as empty and has no ids. Other columns are ignored."""
    packed = _packed(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(packed, pattern)
        with _one_task(codec):
            for batch in slices(batches):
                lists = [[i for part in parts for i in part[0]] for parts in codec.texts(batch.column("text"))]
                yield pa.record_batch([batch.column("doc_id"), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {_id_type(docs)}, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> doc_id, body: the bytes that the ids stand for; NULL decodes to nothing."""
    packed = _packed(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(packed, ".+")
        for batch in batches:
            bodies = [codec.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(bodies, pa.binary())], names=["doc_id", "body"])

    return map_arrow(tokens.select("doc_id", "ids"), run, f"doc_id {_id_type(tokens)}, body binary")


def _digests(codec: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with _one_task(codec):
        for batch in slices(batches):
            counts, ids, bodies = [], [], []
            for parts in codec.texts(batch.column("text")):
                counts.append(sum([len(part[0]) for part in parts]))
                ids.append(hashlib.sha256(",".join([part[1] for part in parts]).encode()).hexdigest())
                bodies.append(hashlib.sha256(b"".join([part[2] for part in parts])).hexdigest())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(bodies, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Encodes every text and decodes the ids in one pass. ids_sha256 is over the decimal ids joined by
    commas. NULL counts as empty: no tokens, digests of nothing. Other columns are ignored.
    """
    packed = _packed(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _digests(_codec(packed, pattern), batches)

    schema = f"doc_id {_id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_arrow(docs.select("doc_id", "text"), run, schema)
