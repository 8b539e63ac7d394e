"""Words of many texts at once, found and hashed by array operations on their UTF-8 bytes.

A word is what ``common.WORD`` says. All bytes of a character beyond ASCII are above 0x7F
and belong to words, so bytes decide as characters do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes that are looked at together, and bytes of texts whose words are held together. A
# longer text is held alone.
SCAN_BYTES = 1 << 18
GROUP_BYTES = 1 << 22
# Odd factor of the running hashes.
FACTOR = 0x9E3779B97F4A7C15

_BYTES = np.arange(256, dtype=np.uint8)
_CAPITAL = (_BYTES >= ord("A")) & (_BYTES <= ord("Z"))
_LOWERED = np.where(_CAPITAL, _BYTES + 32, _BYTES).astype(np.uint8)
_IN_WORD = (
    (_BYTES >= 0x80)
    | ((_LOWERED >= ord("a")) & (_LOWERED <= ord("z")))
    | ((_BYTES >= ord("0")) & (_BYTES <= ord("9")))
)
_TO_WORDS = np.where(_IN_WORD, _LOWERED, ord(" ")).astype(np.uint8).tobytes()
# One 64-bit value for each byte, the same in every task.
_VALUES = np.random.default_rng(1).integers(1, 1 << 64, 256, dtype=np.uint64)[_LOWERED]


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(FACTOR)
    return values ^ (values >> np.uint64(29))


def powers(n: int, factor: int = FACTOR) -> np.ndarray:
    """1, factor, factor^2 ... as n numbers of 64 bits."""
    found = np.full(n, factor, np.uint64)
    found[:1] = 1
    return np.cumprod(found, dtype=np.uint64)


def back_powers(n: int) -> np.ndarray:
    return powers(n, pow(FACTOR, -1, 1 << 64))


def running(values: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Sums by which ``between`` hashes any stretch of the values."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def between(
    sums: np.ndarray, starts: np.ndarray, stops: np.ndarray, back: np.ndarray
) -> np.ndarray:
    """Hash of each stretch, which depends on the values in it alone."""
    return mixed((sums[stops] - sums[starts]) * back[starts])


_UP, _BACK = powers(SCAN_BYTES), back_powers(SCAN_BYTES)


def words(text: str | bytes | None) -> list[bytes]:
    """The words of a text, lower-cased, in UTF-8; null has none."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return raw.translate(_TO_WORDS).split()


def _scan(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in the bytes; none goes over a break."""
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[breaks] = inside[breaks]
    last[breaks - 1] = inside[breaks - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    n = len(data)
    up, back = (_UP, _BACK) if n <= SCAN_BYTES else (powers(n), back_powers(n))
    return starts, between(running(_VALUES[data], up), starts, stops, back)


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of at most SCAN_BYTES, more only for a longer word, that end outside of words."""
    low = 0
    while low < len(data):
        high = low + SCAN_BYTES
        if high < len(data):
            outside = np.flatnonzero(~_IN_WORD[data[low:high]])
            if len(outside):
                high = low + int(outside[-1]) + 1
            while not len(outside) and high < len(data):
                outside = np.flatnonzero(~_IN_WORD[data[high : high + SCAN_BYTES]])
                high += int(outside[0]) if len(outside) else SCAN_BYTES
        yield low, min(high, len(data))
        low = high


def hashed_texts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bounds, hashes) of groups of consecutive texts.

    Text i of a group has the word hashes from ``bounds[i]`` up to ``bounds[i + 1]``. Null
    has no words.
    """
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, buffer = raw.buffers()
    ends = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    every = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(raw):
        high = int(np.searchsorted(ends, ends[low] + GROUP_BYTES, "right")) - 1
        high = min(max(high, low + 1), len(raw))
        data, cuts = every[ends[low] : ends[high]], ends[low : high + 1] - ends[low]
        starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a, b in _pieces(data):
            inner = cuts[np.searchsorted(cuts, a, "right") : np.searchsorted(cuts, b)]
            at, found = _scan(data[a:b], inner - a)
            starts.append(at + a)
            hashes.append(found)
        yield low, np.searchsorted(np.concatenate(starts), cuts), np.concatenate(hashes)
        low = high


def least_places(values: np.ndarray, window: int) -> np.ndarray:
    """Place of the rightmost least value of each window of consecutive values."""
    least, place, width = values, np.arange(len(values)), 1
    while width < window and len(least):
        step = min(width, window - width)
        later = least[step:] <= least[:-step]
        least = np.where(later, least[step:], least[:-step])
        place = np.where(later, place[step:], place[:-step])
        width += step
    return place
