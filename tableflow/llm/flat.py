"""Texts of an Arrow batch as one flat byte array, with vectorised words.

The operators that work on bytes or words inside tasks share these helpers.
A batch is cut into slices of bounded size, so temporaries stay small
whatever the batch holds; only a single longer text makes a larger slice.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SLICE_ROWS = 1024

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, _U), _INVERSE: np.ones(1, _U)}

# [\x20\x09-\x0D] separates words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
# Everything but digits, ASCII letters and bytes of non-ASCII characters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def flatten(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if offsets else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, text: str = "text", max_bytes: int = SLICE_BYTES, max_rows: int = SLICE_ROWS) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive rows of a batch, each of at most
    `max_bytes` of text (or one row) and `max_rows` rows."""
    buf, offs = flatten(batch.column(text))
    at, n = 0, len(offs) - 1
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + max_bytes, "right")) - 1
        to = min(max(to, at + 1), at + max_rows, n)
        yield slice(at, to), buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def parts(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """A batch in parts of few rows, for what is gathered per batch."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base (or of its inverse), modulo 2**64."""
    base = _INVERSE if inverse else _BASE
    if len(_powers[base]) < n:
        full = np.full(max(n, 1 << 16), base, _U)
        full[0] = 1
        _powers[base] = np.cumprod(full)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words(buf: np.ndarray, offs: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of the words of all texts, and the
    number of words before each text (one more entry than texts)."""
    n = len(buf)
    inside = np.empty(n + 1, bool)
    np.logical_not(separators[buf], out=inside[:n])
    inside[n] = False
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    edges = offs[(offs > 0) & (offs < n)]
    begins[edges] = inside[edges]  # a text's first byte starts a word of its own
    starts = np.flatnonzero(begins)
    stops = inside[:n] & ~inside[1:]
    stops[edges - 1] |= inside[edges - 1]
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal bytes give equal hashes."""
    n = len(buf)
    sums = np.zeros(n + 1, _U)
    np.cumsum((buf.astype(_U) + _U(1)) * powers(n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(n + 1, inverse=True)[starts]
    return mix(h ^ ((ends - starts).astype(_U) << _U(40)))


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Consecutive values as one list per row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def pack(numbers: np.ndarray) -> bytes:
    """Ascending numbers as compressed differences, byte plane by byte plane."""
    steps = np.diff(numbers, prepend=_U(0)).astype("<u8")
    return plane(steps)


def plane(numbers: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes."""
    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    raw = numbers.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return struct.pack("<QB", len(numbers), width) + pa.compress(raw, "zstd", asbytes=True) if len(numbers) else b""


def unplane(blob: bytes) -> np.ndarray:
    """What `plane` packed."""
    if not blob:
        return np.zeros(0, _U)
    n, width = struct.unpack_from("<QB", blob)
    raw = np.frombuffer(pa.decompress(blob[9:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw.T
    return out.reshape(-1).view(_U)


def unpack(blob: bytes) -> np.ndarray:
    """What `pack` packed."""
    return np.cumsum(unplane(blob), dtype=_U)
