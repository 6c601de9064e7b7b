"""Longest common subsequences of lines, by bit vectors."""

from __future__ import annotations

import numpy as np

# Bits of the table kept for one walk back; longer pairs are halved first.
TABLE_BITS = 1 << 26


def _lines_of(codes: np.ndarray) -> dict[int, int]:
    """For every code the positions it has, as a bit vector."""
    found: dict[int, int] = {}
    for n, code in enumerate(codes.tolist()):
        found[code] = found.get(code, 0) | (1 << n)
    return found


def _table(a: np.ndarray, b: np.ndarray, keep: bool) -> list[int]:
    """Bit vectors over ``a`` after each line of ``b`` (only the last one unless ``keep``).

    A zero at position j says that the longest common subsequence grows with line j of ``a``.
    """
    at = _lines_of(a)
    full = (1 << len(a)) - 1
    state, rows = full, []
    for code in b.tolist():
        hit = state & at.get(code, 0)
        state = ((state + hit) | (state - hit)) & full
        if keep:
            rows.append(state)
    return rows if keep else [state]


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``b`` and each start of ``a``."""
    state = _table(a, b, False)[0] if len(a) else 0
    bits = np.frombuffer(state.to_bytes(len(a) // 8 + 1, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(1 - np.unpackbits(bits, bitorder="little")[:len(a)].astype(np.int64))])


def _walk(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    rows = _table(a, b, True)
    i, j, found = len(a), len(b), []
    while i and j:
        if (rows[j - 1] >> (i - 1)) & 1:
            i -= 1
        else:
            j -= 1
            if not j or (rows[j - 1] >> (i - 1)) & 1:
                i -= 1
                found.append((i, j))
    return found[::-1]


def _align(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    same = [(n, n) for n in range(start)]
    tail = [(len(a) - end + n, len(b) - end + n) for n in range(end)]
    a, b = a[start:len(a) - end], b[start:len(b) - end]
    if not len(a) or not len(b):
        return same + tail
    if len(a) * len(b) <= TABLE_BITS or len(b) == 1:
        inner = _walk(a, b)
    else:
        half = len(b) // 2
        left, right = _lengths(a, b[:half]), _lengths(a[::-1], b[half:][::-1])[::-1]
        cut = int(np.argmax(left + right))
        inner = _align(a[:cut], b[:half]) + [(i + cut, j + half) for i, j in _align(a[cut:], b[half:])]
    return same + [(i + start, j + start) for i, j in inner] + tail


def common_lines(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a`` and in ``b`` of a longest common subsequence.

    Lines that only one side has are left out first; they cannot be part of it.
    """
    x, y = np.flatnonzero(np.isin(a, b)), np.flatnonzero(np.isin(b, a))
    if not len(x):
        return x, y
    pairs = np.array(_align(a[x], b[y]), np.int64).reshape(-1, 2)
    return x[pairs[:, 0]], y[pairs[:, 1]]
