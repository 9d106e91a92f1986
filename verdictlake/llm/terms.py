"""Words of whole texts as integer codes: a batch's bytes are classed at once, and Arrow's dictionaries number the words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are coded together (a longer text is coded alone).
SLICE = 8 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Codes(NamedTuple):
    """A slice's words in order: codes into `words`, the number of the row and of the piece (pieces never span rows) of each."""

    codes: np.ndarray
    rows: np.ndarray
    pieces: np.ndarray
    words: pa.Array


def classes(space: bytes, end: bytes = b"") -> np.ndarray:
    """What each byte is: 0 part of a word, 1 between words, 2 between pieces."""
    table = np.zeros(256, np.uint8)
    table[list(space)], table[list(end)] = 1, 2
    return table


def encode(texts: pa.Array, table: np.ndarray) -> Codes:
    """The words of the texts, A-Z lower-cased; null texts have none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.empty(0, np.uint8)
    offsets = offsets - offsets[0] if len(texts) else offsets
    kind = table[raw]
    word, cut = kind == 0, kind == 2
    cut[offsets[:-1][offsets[:-1] < len(raw)]] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | cut[1:]
    at = np.flatnonzero(start)
    pieces = np.cumsum(cut, dtype=np.int32)[at] if len(raw) else np.empty(0, np.int32)
    ends = np.append(np.flatnonzero(start[word]), np.count_nonzero(word)).astype(np.int64)
    flat = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[raw[word]])])
    coded = flat.dictionary_encode()
    rows = np.searchsorted(offsets, at, "right").astype(np.int32) - 1
    return Codes(coded.indices.to_numpy(zero_copy_only=False), rows, pieces, coded.dictionary)


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch cut so that the texts of each part stay within SLICE bytes, but for single longer ones."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes and distinct values."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def fold(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for each pair of numbers from 0; equal pairs and no others share theirs."""
    if not len(first):
        return first.astype(np.int64)
    width = int(second.max()) + 1
    if (int(first.max()) + 1) * width >= 1 << 62:
        first = np.unique(first, return_inverse=True)[1]
    return first.astype(np.int64) * width + second
