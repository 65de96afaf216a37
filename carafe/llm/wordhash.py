"""Vectorised word splitting and hashing over Arrow string columns (numpy only, no per-word Python)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits: separators of terms.
_NO_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_Q = U(0x9E3779B97F4A7C15)
SLICE_BYTES = 2_000_000


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), so that sums of mixed values behave like random ones."""
    with np.errstate(over="ignore"):
        x = x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the rows' limits in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    limits = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return data[limits[0] : limits[-1]], limits - limits[0]


def slices(limits: np.ndarray, size: int = SLICE_BYTES):
    """Runs of rows of about ``size`` bytes; a longer text is a run of its own."""
    at, n = 0, len(limits) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(limits, limits[at] + size, side="right")) - 1)
        yield at, min(to, n)
        at = to


def word_spans(data: np.ndarray, limits: np.ndarray, terms: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words (runs without white space 09-0D, 20) and the number of words before each row.

    With ``terms``, words are runs of ASCII letters and digits and of any other characters beyond ASCII.
    """
    solid = ~(_NO_TERM if terms else _SPACE)[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[limits] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, limits)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every word's bytes."""
    if not len(starts):
        return np.zeros(0, U)
    lengths = ends - starts
    before = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = np.arange(lengths.sum()) - np.repeat(before - starts, lengths)
    within = at - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        powers = np.concatenate([[U(1)], np.cumprod(np.full(int(lengths.max()), _Q | U(2 * seed + 1), U))])
        letters = (_LOWER[data[at]] if lower else data[at]).astype(U) + U(1)
        sums = np.add.reduceat(letters * powers[within], before)
        return mix(sums + lengths.astype(U) * U(0xD6E8FEB86659FD93), seed)


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``n`` words in one sequence of word hashes, by doubling; length len(words) - n + 1."""
    if len(words) < n:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        r = U((0xA24BAED4963EE407 + 2 * (seed * 0x9FB21C651E98DF25)) % 2**64 | 1)
        base, size, power = mix(words, seed), 1, r
        done, have = None, 0
        while True:
            if n & size:
                done = base if done is None else done[: len(words) - have - size + 1] * power + base[have : have + len(words) - have - size + 1]
                have += size
            if have == n:
                return mix(done, seed + 1)
            base, size, power = base[:-size] * power + base[size:], size * 2, power * power
