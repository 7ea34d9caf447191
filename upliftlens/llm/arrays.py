"""Texts as byte arrays, for tokenizers that work on a whole slice of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each begins; NULL counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, ends, body = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts_of(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The texts again: the bytes between each two offsets."""
    parts = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, parts)


def byte_table(word: bytes, lower: bool) -> np.ndarray:
    """What each byte becomes: itself if it is in `word` or no ASCII, else a space; A-Z in lower case on demand."""
    table = np.arange(256, dtype=np.uint8)
    other = np.ones(128, bool)
    other[np.frombuffer(word, np.uint8)] = False
    table[:128][other] = 32
    if lower:
        table[65:91][~other[65:91]] += 32
    return table


def owners(offsets: np.ndarray) -> np.ndarray:
    """The row of each element of a list column, from the rows' offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
