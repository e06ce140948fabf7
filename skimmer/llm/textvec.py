"""Whole-batch tokenising and hashing of text columns with numpy.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; A-Z count as
a-z.  All routines read every byte of every text; memory is bounded by working
through a batch in pieces of a few megabytes that end between words.  A null text
counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Fixed odd multipliers of the polynomial word hash and of the window hash.
BASE = 0x9E3779B97F4A7C15 | 1
WINDOW_BASE = 0xD6E8FEB86659FD93

PIECE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CODE = np.arange(1, 257, dtype=np.uint64)
_CODE[65:91] += np.uint64(32)

_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        inverse = pow(BASE, -1, 1 << 64)
        out = []
        for base in (BASE, inverse):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            out.append(np.multiply.accumulate(table))
        _powers = (out[0], out[1])
    return _powers


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _piece(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of one piece; bounds: row starts inside it."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = bounds[(bounds > 0) & (bounds < n)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_CODE[raw] * power[:n], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts]), starts


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the column, and the index of each row's first word (n + 1 entries)."""
    raw, at = buffers(column)
    hashes, starts, begin = [], [], 0
    while begin < len(raw):
        end = min(len(raw), begin + PIECE_BYTES)
        while end < len(raw):
            # end the piece at the start of a row, or else after white space
            k = np.searchsorted(at, end, "right") - 1
            if at[k] > begin:
                end = int(at[k])
                break
            space = np.flatnonzero(_SPACE[raw[begin:end]])
            if len(space):
                end = begin + int(space[-1]) + 1
                break
            end = min(len(raw), end + PIECE_BYTES)
        lo, hi = np.searchsorted(at, (begin, end))
        h, s = _piece(raw[begin:end], at[lo:hi] - begin)
        hashes.append(h)
        starts.append(s + begin)
        begin = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), at).astype(np.int64)


def row_slices(column: pa.Array, most: int = 2 * PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes of text, or of one row, so that a batch needs little memory."""
    _, at = buffers(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, min(end, len(column))
        row = end


def windows(hashes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside rows, repeats included, and each row's first.

    A row with fewer words, but at least one, gives one window of all its words.
    """
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(count)))
    row = np.repeat(np.arange(len(n)), count)
    begin = at[row] + np.arange(first[-1]) - first[row]
    out, factor = np.zeros(first[-1], np.uint64), 1
    length = n[row]
    for j in range(size):
        here = length > j
        index = np.where(here, begin + j, 0)
        if len(index):
            out += np.where(here, hashes[index], np.uint64(j + 1)) * np.uint64(factor)
        factor = factor * WINDOW_BASE % (1 << 64)
    return mix64(out), first


def word_bytes(text: str | None) -> list[bytes]:
    """The words of one text, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_bytes(words_: list[bytes], size: int) -> list[bytes]:
    """Space-joined windows of one text's words, repeats included; fewer words: all of them as one."""
    if len(words_) < size:
        return [b" ".join(words_)] if words_ else []
    return [b" ".join(words_[i : i + size]) for i in range(len(words_) - size + 1)]
