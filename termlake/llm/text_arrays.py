"""Words and word hashes of an Arrow column of texts as numpy arrays, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
LETTERS = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of ``column`` in a row, and the offsets of the texts; a null text is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def portions(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about ``most`` bytes each; a longer text is a range of its own."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            full = np.full(n, base, np.uint64)
            full[0] = 1
            _POWERS[name] = np.multiply.accumulate(full)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of the first word of each text (one more at the end)."""
    solid = np.zeros(len(raw) + 2, bool)
    solid[1:-1] = ~IS_SPACE[raw]
    begins, stops = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    cut = inner[solid[inner] & solid[inner + 1]]  # a text ends and the next begins without a space
    begins[cut], stops[cut - 1] = True, True
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: polynomials of their bytes from one running sum, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(LETTERS[raw] * up[: len(raw)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts])


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word shingles and the number of the first of each text (one more at the end).

    A text of fewer words has one shingle, all its words; a text without words has none.
    """
    starts, ends, first = words(raw, offsets)
    w = word_hashes(raw, starts, ends)
    if not len(w):
        return w, first
    counts = np.diff(first)
    stop = np.repeat(first[1:], counts)
    place = np.arange(len(w))
    sums = np.zeros(len(w), np.uint64)
    for k in range(min(size, len(w))):
        factor = np.uint64((2 * k + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
        sums[: len(w) - k] += np.where(place[: len(w) - k] + k < stop[: len(w) - k], w[k:] * factor, np.uint64(0))
    keep = (place + size <= stop) | (place == np.repeat(first[:-1], counts))
    numbers = np.concatenate([[0], np.cumsum(keep)])
    return mixed(sums[keep]), numbers[first]
