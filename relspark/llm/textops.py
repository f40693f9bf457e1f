"""Vectorised tokenising of Arrow text columns.

Word rules here are byte-level: every byte of a non-ASCII character is above
0x7F and belongs to words under both rules, so UTF-8 needs no decoding.  Work
goes through slices of bounded size, whatever the length of a single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
SLICE = 512 << 10

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x61:0x7B] = _ALNUM[0x41:0x5B] = True
_ALNUM[0x80:] = True

#: Byte tables of the two word rules: white-space separated, and alphanumeric or non-ASCII.
WORDS_BY_SPACE = ~_SPACES
WORDS_ALNUM = _ALNUM

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.uint64(_BASE)
        np.multiply.accumulate(out, out=out)
    return out


_POW = _powers(64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes give equal hashes wherever they lie."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lens = ends - starts
    pos = np.arange(int(lens.sum()), dtype=np.int64)
    first = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=first[1:])
    pos -= np.repeat(first, lens)
    where = pos + np.repeat(starts, lens)
    top = int(lens.max())
    powers = _POW if top <= len(_POW) else _powers(top)
    terms = _BYTE[data[where]]
    terms *= powers[pos]
    return mix(np.add.reduceat(terms, first) + lens.astype(np.uint64))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls are empty."""
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = pc.fill_null(col, b"")
    bufs = col.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.empty(0, np.uint8)
    return data, offsets


def word_spans(data: np.ndarray, offsets: np.ndarray, rule: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word of the texts ``data[offsets[i]:offsets[i+1]]``."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    inside = rule[data[lo:hi]]
    edges = np.zeros(hi - lo + 1, bool)
    if hi > lo:
        edges[0] = inside[0]
        np.not_equal(inside[1:], inside[:-1], out=edges[1:-1])
        edges[-1] = inside[-1]
    cuts = np.flatnonzero(edges)
    starts, ends = cuts[0::2] + lo, cuts[1::2] + lo
    inner = np.unique(offsets[1:-1])
    inner = inner[(inner > lo) & (inner < hi)]
    if len(inner) and len(starts):  # a word that runs over the end of a text is two
        k = np.searchsorted(starts, inner, "right") - 1
        cut = (k >= 0) & (starts[np.maximum(k, 0)] < inner) & (ends[np.maximum(k, 0)] > inner)
        at = inner[cut]
        if len(at):
            starts, ends = np.sort(np.concatenate([starts, at])), np.sort(np.concatenate([ends, at]))
    texts = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, texts


def hashed_words(col: pa.Array, rule: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word of the column, in order."""
    data, offsets = text_buffers(col)
    n = len(offsets) - 1
    if n <= 0 or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    starts, ends, texts = word_spans(data, offsets, rule)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # spans are hashed in slices, so that temporaries stay small
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE)))
        lo, hi = int(starts[at]), int(ends[to - 1])
        part = _LOWER[data[lo:hi]] if lower else data[lo:hi]
        out[at:to] = hash_spans(part, starts[at:to] - lo, ends[at:to] - lo)
        at = to
    return out, texts


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 * SLICE) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each part holds about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if not len(col):
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64)
        group = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(col)], strict=True):
            yield batch.slice(lo, hi - lo)
