"""Word shingles of whole texts as sorted 64-bit hashes, and their MinHash values."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WIDTH = 5
BANDS, BAND_ROWS = 24, 4
HASHES = BANDS * BAND_ROWS

_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIXERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_CHUNK = 4096

_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[128:] = True
for _first, _last in ("09", "az", "AZ"):
    _WORD_BYTES[ord(_first):ord(_last) + 1] = True


def _mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    values = (values ^ (values >> np.uint64(30))) * _MIXERS[0]
    values = (values ^ (values >> np.uint64(27))) * _MIXERS[1]
    return values ^ (values >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the prime and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    return tuple(np.concatenate([one, np.cumprod(np.full(n, base, np.uint64))]) for base in (_PRIME, inverse))


def word_hashes(text: str) -> np.ndarray:
    """A hash per word: runs of letters and digits in lower case; any sign divides words.

    Characters beyond ASCII count as letters.
    """
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    inside = np.concatenate([[False], _WORD_BYTES[raw], [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(1 << max(16, len(raw).bit_length()))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * inverse[starts])


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words.

    A text with fewer words is one shingle of all of them; one without words has none.
    """
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if len(words) == 0:
        return words
    if len(words) < width:
        words = np.concatenate([words, np.full(width - len(words), len(words), np.uint64)])
    power, _ = _powers(1 << 16)
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += words[k:k + n] * power[2 * k + 1]
    return np.unique(_mixed(total))


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(20240101).integers(0, 1 << 32, (2, HASHES), dtype=np.uint64)
    return (drawn[0] | np.uint64(1)).astype(np.uint32), drawn[1].astype(np.uint32)


def minhashes(found: np.ndarray) -> np.ndarray:
    """``HASHES`` MinHash values of a set, 16 bits of each."""
    scale, shift = _permutations()
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), _CHUNK):
        values = short[at:at + _CHUNK, None] * scale
        values += shift
        np.minimum(least, values.min(axis=0), out=least)
    # The low bits of a minimum are as even as those of any hash; its high bits are not.
    return (least & np.uint32(0xFFFF)).astype("<u2")


def set_digest(found: np.ndarray) -> bytes:
    """16 bytes that name a set of shingles."""
    with np.errstate(over="ignore"):
        return np.array([found.sum(dtype=np.uint64), _mixed(found + np.uint64(len(found))).sum(dtype=np.uint64)]).tobytes()
