"""Numbers that describe the form of a text, computed a batch at a time."""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np

FEATURES = (
    "log_chars", "log_words", "mean_word", "long_words", "capital_share", "digit_share", "symbol_share",
    "space_share", "wide_share", "sentence_ends", "commas", "line_words", "repeated_words",
    "repeated_lines", "repeated_neighbours", "commonest_word", "symbol_words", "bare_symbols",
    "capital_words", "byte_entropy", "title_words", "letter_words",
)


def _byte_classes() -> np.ndarray:
    """Class of each byte value: 0 lower case, 1 capital, 2 digit, 3 space, 4 wide, 5 symbol."""
    classes = np.full(256, 5, np.uint8)
    classes[ord("a"):ord("z") + 1] = 0
    classes[ord("A"):ord("Z") + 1] = 1
    classes[ord("0"):ord("9") + 1] = 2
    classes[[9, 10, 11, 12, 13, 32]] = 3
    classes[128:] = 4
    return classes


_CLASSES = _byte_classes()
_PLAIN_END = (_CLASSES != 5) | np.isin(np.arange(256), np.frombuffer(b".,;:?", np.uint8))
_LETTER = np.isin(_CLASSES, (0, 1, 4))


def text_features(text: str | None) -> np.ndarray:
    """The numbers of one whole text, in the order of ``FEATURES``; null counts as empty.

    An empty text gives zeros only.
    """
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    share = np.bincount(_CLASSES, counts, 6) / len(raw)
    p = counts[counts > 0] / len(raw)
    words = text.split()
    lines = [line for line in text.split("\n") if line]
    out[0], out[1] = np.log1p(len(text)), np.log1p(len(words))
    out[4:9] = share[1], share[2], share[5], share[3], share[4]
    out[19] = -(p * np.log2(p)).sum()
    classes = _CLASSES[raw]
    inside = np.concatenate([[False], classes != 3, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    n = len(starts)
    if n == 0 or not words:
        return out

    def per_word(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return sums[ends] - sums[starts]

    lengths = ends - starts
    capitals, small, signs = per_word(classes == 1), per_word(classes == 0), per_word(classes == 5)
    first, last = raw[starts], raw[ends - 1]
    times = Counter(words)
    out[2], out[3] = lengths.mean(), (lengths > 16).mean()
    out[9] = (counts[ord(".")] + counts[ord("!")] + counts[ord("?")]) / n
    out[10] = counts[ord(",")] / n
    out[11] = np.log1p(n / max(1, len(lines)))
    out[12] = 1 - len(times) / len(words)
    out[13] = 1 - len(set(lines)) / max(1, len(lines))
    out[14] = sum(map(eq, words, words[1:])) / len(words)
    out[15] = max(times.values()) / len(words)
    out[16] = 1 - _PLAIN_END[last].mean()
    out[17] = (signs == lengths).mean()
    out[18] = ((capitals > 0) & (small == 0)).mean()
    out[20] = ((_CLASSES[first] == 1) & (capitals == 1)).mean()
    out[21] = (_LETTER[first] & _LETTER[last]).mean()
    return out
