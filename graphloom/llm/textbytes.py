"""Words of Arrow text columns as arrays: hashes, starts and ends, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import mixed

#: Bytes of text that are looked at together; longer texts are taken alone.
CHUNK = 4 << 20
SLICE = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64; at least n of them."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.ones(1, np.uint64)
        with np.errstate(over="ignore"):
            while len(got) < n:
                got = np.concatenate((got, got * np.uint64(pow(base, len(got), 1 << 64))))
        _powers[base] = got
    return got


def word_table(spaces: bytes | None = None, word_ranges: list[tuple[int, int]] | None = None) -> np.ndarray:
    """For each byte, whether it is part of a word."""
    out = np.zeros(256, bool)
    if spaces is not None:
        out[:] = True
        out[list(spaces)] = False
    for low, high in word_ranges or []:
        out[low : high + 1] = True
    return out


#: Everything but ASCII white space.
NOT_SPACE = word_table(spaces=b" \t\n\v\f\r")


def codes(fold: bool) -> np.ndarray:
    """A random number for each byte; with fold the same for A-Z as for a-z."""
    out = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    if fold:
        out[65:91] = out[97:123]
    return out


_PLAIN, _FOLDED = codes(False), codes(True)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and where each row starts (and the last ends)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts) of consecutive rows with about `limit` bytes, or one longer row."""
    raw, at = column_bytes(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def _slices(raw: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(raw):
        end = min(len(raw), at + SLICE)
        while end < len(raw) and is_word[raw[end]]:
            end += 1
        yield at, end
        at = end


def words(raw: np.ndarray, starts: np.ndarray, is_word: np.ndarray = NOT_SPACE, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word; a word never goes over one of the starts."""
    table, out = _FOLDED if fold else _PLAIN, []
    bounds = starts[(starts > 0) & (starts < len(raw))]
    with np.errstate(over="ignore"):
        for lo, hi in _slices(raw, is_word):
            piece = raw[lo:hi]
            inside = is_word[piece]
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            cut = bounds[np.searchsorted(bounds, lo) : np.searchsorted(bounds, hi)] - lo
            first[cut] = inside[cut]
            last = inside.copy()
            last[:-1] &= ~inside[1:]
            before = cut[cut > 0] - 1
            last[before] = inside[before]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            n = len(piece)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(table[piece] * _power(_BASE, n + 1)[:n], out=total[1:])
            h = (total[e] - total[s]) * _power(pow(_BASE, -1, 1 << 64), n + 1)[s]
            out.append((mixed(h ^ ((e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), s + lo, e + lo))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
