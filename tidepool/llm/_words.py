"""Vectorised words and word hashes over Arrow string columns.

Every helper works on whole blocks of documents: bytes become a numpy array, words are runs of bytes of one
class, and a word's 64-bit hash comes from prefix sums, so the Python cost is per block and not per word.
Byte classes equal the code point classes used here because every byte of a non-ASCII character is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 256 << 10
PIECE_BYTES = 512 << 10
_LO_BITS = 19

_all = np.arange(256)
#: A-Z to a-z, everything else as it is.
LOWER = np.where((_all >= 65) & (_all <= 90), _all + 32, _all).astype(np.uint8)
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
ALNUM = ((_all >= 48) & (_all <= 57)) | ((_all >= 97) & (_all <= 122)) | (_all >= 128)
#: Bytes of words [^\x20\x09-\x0D]+.
NONSPACE = ~((_all == 32) | ((_all >= 9) & (_all <= 13)))

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def _powers(base: int) -> tuple[np.ndarray, int]:
    low = np.full(1 << _LO_BITS, base, dtype=U64)
    low[0] = 1
    return np.cumprod(low), pow(base, 1 << _LO_BITS, 1 << 64)


_tables: dict[int, tuple[np.ndarray, int]] = {}


def _power_at(base: int, at: np.ndarray) -> np.ndarray:
    """base ** at modulo 2 ** 64."""
    low, step = _tables.get(base) or _tables.setdefault(base, _powers(base))
    out = low[at & ((1 << _LO_BITS) - 1)]
    top = int(at[-1]) >> _LO_BITS if len(at) else 0
    if top:
        high = np.array([pow(step, k, 1 << 64) for k in range(top + 1)], dtype=U64)
        out = out * high[at >> _LO_BITS]
    return out


def _mapped(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table[raw]`` for bytes and a table of 256 bytes or booleans; the result is read-only."""
    return np.frombuffer(raw.tobytes().translate(table.tobytes()), table.dtype)


def _slice(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), for at most 2 ** 19 of them."""
    return (_tables.get(base) or _tables.setdefault(base, _powers(base)))[0][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most ``limit`` bytes, or one row. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of a block: ``start``/``end`` bytes, ``hash``, and ``first``: each row's first word, with the end.

    Bytes are taken in pieces of ``PIECE_BYTES``, cut between words, so beside the words themselves a long text costs one byte a byte.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray, lower: bool = True):
        self.bytes = _mapped(raw, LOWER) if lower else raw
        n = len(raw)
        starts, ends, hashes = [], [], []
        at = 0
        while at < n:
            to = min(at + PIECE_BYTES, n)
            if to < n and keep[self.bytes[to]] and keep[self.bytes[to - 1]]:  # not inside a word
                to = self._word_end(to, keep)
            piece = self.bytes[at:to]
            inside = _mapped(piece, keep)
            edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
            cuts = offsets[np.searchsorted(offsets, at + 1) : np.searchsorted(offsets, to)] - at
            cuts = cuts[inside[cuts] & inside[cuts - 1]]  # rows that meet inside a run of word bytes
            if len(cuts):
                edge = np.sort(np.concatenate([edge, np.unique(cuts)]), kind="stable")
                edge = np.concatenate([[0], edge, [len(piece)]])
                start, end = edge[:-1], edge[1:]
                some = (end > start) & inside[np.minimum(start, len(piece) - 1)]
                start, end = start[some], end[some]
            else:
                edge = np.concatenate([[0] * bool(inside[0]), edge, [len(piece)] * bool(inside[-1])]).astype(np.int64)
                start, end = edge[::2], edge[1::2]
            if to - at <= 1 << _LO_BITS:
                power, inverse = _slice(_BASE, to - at), _slice(_INV, to - at)[start]
            else:
                power, inverse = _power_at(_BASE, np.arange(to - at)), _power_at(_INV, start)
            sums = np.zeros(len(piece) + 1, U64)
            terms = piece.astype(U64)
            terms += U64(1)
            terms *= power
            np.cumsum(terms, out=sums[1:])
            hashes.append(mix((sums[end] - sums[start]) * inverse))
            starts.append(start + at)
            ends.append(end + at)
            at = to
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.first = np.searchsorted(self.start, offsets)

    def _word_end(self, at: int, keep: np.ndarray) -> int:
        n = len(self.bytes)
        while at < n:
            out = np.flatnonzero(~keep[self.bytes[at : at + PIECE_BYTES]])
            if len(out):
                return at + int(out[0])
            at += PIECE_BYTES
        return n

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, k: int) -> bytes:
        return self.bytes[self.start[k] : self.end[k]].tobytes()


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive hashes (order matters)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, size, U64)
    for k in range(size):
        out += hashes[k : k + n] * _COEFF[k]
    return mix(out)


_COEFF = mix(np.arange(1, 65, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of consecutive groups of words and each group's first shingle, with the end.

    ``first`` are the groups' first words, with the end. A group of fewer words, but not none, has one
    shingle, its whole sequence. Repeats stay.
    """
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(at[-1], U64)
    full = windows(hashes, size)
    where = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], n)
    short = np.repeat(counts < size, n)
    out[~short] = full[where[~short]]
    for k in range(1, size):
        rows = np.flatnonzero(counts == k)
        if len(rows):
            total = np.full(len(rows), k, U64)
            for i in range(k):
                total += hashes[first[rows] + i] * _COEFF[i]
            out[at[rows]] = mix(total)
    return out, at


def group_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of groups of values, modulo 2 ** 64 for unsigned ones; empty groups give 0."""
    sums = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def sorted_distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each group's distinct values in order, and the groups' starts, with the end."""
    values = values.copy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[at[:-1][at[:-1] < len(values)]] = True
    counts = np.zeros(len(values) + 1, np.int64)
    np.cumsum(new, out=counts[1:])
    return values[new], counts[at]
