"""Vectorised word hashing over Arrow text columns.

Words are maximal runs of bytes other than space, tab, LF, VT, FF and CR, with A-Z lower-cased. Every word gets a
64-bit hash: a polynomial over randomly mapped bytes, finished by a mixer. All work is done on whole Arrow
buffers, in slices of bounded size, so a batch costs a few passes of numpy and no Python loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudorandom 64-bit words."""
    with np.errstate(over="ignore"):
        return mix((np.arange(n, dtype=np.uint64) + np.uint64(1 + (seed << 32))) * np.uint64(0x9E3779B97F4A7C15))


def _byte_codes() -> np.ndarray:
    codes = stream(7, 256)
    codes[65:91] = codes[97:123]  # A-Z count as a-z
    return codes


_CODES = _byte_codes()
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


_POW, _INV = _powers(_BASE, SLICE + 1), _powers(_INVERSE, SLICE + 1)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets into them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each row the index of its first word (one more entry at the end)."""
    n = len(raw)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    parts, starts, at = [], [], 0
    while at < n:
        end = min(n, at + SLICE)
        while end < n and not (_SPACE[raw[end]] or first[end]):
            end += 1  # a slice ends where a word ends
        piece = raw[at:end]
        word = ~_SPACE[piece]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | first[at + 1 : end]
        ends[:-1] &= ~word[1:] | first[at + 1 : end]
        b, e = np.flatnonzero(begins), np.flatnonzero(ends)
        if len(b):
            size = len(piece)
            power, inverse = (_POW, _INV) if size <= SLICE else (_powers(_BASE, size), _powers(_INVERSE, size))
            with np.errstate(over="ignore"):
                total = np.cumsum(_CODES[piece] * power[:size], dtype=np.uint64)
                before = np.where(b > 0, total[b - 1], np.uint64(0))
                h = (total[e] - before) * inverse[b] + (e - b).astype(np.uint64)
                parts.append(mix(h))
            starts.append(b + at)
        at = end
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(parts), np.searchsorted(np.concatenate(starts), offsets)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words; entry i covers words i to i + n - 1, across rows too."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - n + 1 + j]
        return mix(out)


def slices(offsets: np.ndarray, limit: int = 4 << 20):
    """Row ranges of at most limit bytes each, or of one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end
