"""Secrets in whole texts: fixed rules, and a character network over every candidate.

The rules' findings are always kept and label the candidates that the network is trained on. The
network sees a candidate and what surrounds it. It starts from a bounded set of candidates and is then
taught by every candidate of the table; its scores are calibrated on all held-back
candidates, and a threshold per kind keeps a set share of all of the rules' findings.
"""

from __future__ import annotations

import hashlib
import logging
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.batches import bounded_rows
from riskloom.plans.materialise import stored

# Kinds in the order in which spans of one start are listed, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
LEARNED = "learned"

# Access and hex findings lie inside runs of these.
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
# Candidates: printable ASCII but blanks, quotes, brackets and , ; : | \, from the rules' least length up.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=!@#$%^&*~?-]{6,}")
BEFORE, TOKEN, AFTER = 24, 56, 16
# Empty places on both sides of a candidate keep the convolution from reaching over its ends: what a candidate
# adds to its score depends on its own characters alone.
GAP = 2
OWN = BEFORE + GAP
LENGTH = OWN + TOKEN + GAP + AFTER
# Bounds of the start of the training: labelled findings of each kind, other candidates that look like secrets by their digits or
# signs, all other candidates (smallest hashes), and pieces of a long candidate.
KIND_ROWS, ALIKE_ROWS, OTHER_ROWS, PIECES = 1500, 1500, 6000, 8
# What is no secret though it has digits or signs (numbers, dates, addresses).
ALIKE = re.compile(r"[0-9+./:#-]*[0-9][0-9+./:#-]*|[^@]+@[^@]+|(?:https?|www)[./].*")
LEAST_RECALL = 0.97
# How labelled candidates are dealt in turn: 0 to train, 1 to set thresholds, 2 to test.
DEALT = (0, 0, 1, 0, 0, 2)
# Decay of the weights of the surroundings in training, a step and unit of rate.
AROUND_DECAY = 2.0
# Scores of one candidate differ by less than this between batches.
SLACK = 1e-3
# What every candidate teaches: a score is to lie this far on its label's side of 0, beyond which nothing is lost, and no
# score moves further than the leeway from the start, so that what lies below both together can lose nothing.
MARGIN, LEEWAY = 1.0, 1.0
# Looks at all that the candidates teach, and the first step as a share of each weight's length.
LOOKS, STEP = 10, 0.02
# Weights that every candidate has taught are multiples of one part, so that the order of sums does not show in them; scores
# that set thresholds are counted by steps of the other.
WEIGHT_GRID, SCORE_GRID = 1 << 16, 1 << 10
# Pieces that a task remembers.
REMEMBERED = 1 << 18
# Bytes of text whose candidates a task looks for at a time, windows that it scores and texts that it reads by place at a time.
RUN_BYTES, WINDOWS, TEXTS = 1 << 20, 4096, 512
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-=.:\"' "
_CODES = np.full(128, len(_ALPHABET) + 1, np.int64)
_CODES[[ord(c) for c in _ALPHABET]] = np.arange(1, len(_ALPHABET) + 1)
_IN_CANDIDATE = np.array([CANDIDATE.fullmatch(chr(c) * LEAST["assign"]) is not None for c in range(256)])
_LOG = logging.getLogger(__name__)
_SYMBOLS = len(_ALPHABET) + 2  # 0 is "nothing there", the last one any other character


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the rules' findings, by start and kind; code points, end exclusive.

    Matches of each kind are leftmost and do not overlap; those that are too short are dropped
    after they have been matched. Access and hex runs lie inside long runs, so only those are read for them.
    """
    found = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for token in RUN.finditer(text):
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            for m in pattern.finditer(text, token.start(), token.end()):
                if m.end() - m.start() >= LEAST[kind]:
                    found.append((m.start(), kind, m.end()))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def spans_of(column: pa.Array) -> list[list[tuple[int, str, int]]]:
    """The rules' findings in every text of a column; only texts with a word or a long run are looked at by the rules."""
    there = pc.or_(pc.match_substring_regex(column, "[A-Za-z0-9+/_-]{20}"), pc.match_substring_regex(column, "(?i)password|passwd|secret|token|api_?key"))
    rows = np.flatnonzero(pc.fill_null(there, False).to_numpy(zero_copy_only=False))
    spans: list[list[tuple[int, str, int]]] = [[] for _ in range(len(column))]
    for k, value in zip(rows, column.take(pa.array(rows)).to_pylist()):
        spans[k] = base_spans(value)
    return spans


def joined(spans: list[tuple[int, str, int]]) -> str:
    """kind:start:end of every span, joined by commas."""
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def window(text: str, start: int, end: int) -> str:
    """``LENGTH`` characters around at most ``TOKEN`` of a candidate: what precedes it, its own, what follows."""
    before = text[max(0, start - BEFORE):start].rjust(BEFORE, "\0")
    return before + "\0" * GAP + text[start:end].ljust(TOKEN + GAP, "\0") + text[end:end + AFTER].ljust(AFTER, "\0")


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping pieces of at most ``TOKEN`` characters that cover a candidate."""
    if end - start <= TOKEN:
        return [(start, end)]
    return [(a, a + TOKEN) for a in (*range(start, end - TOKEN, TOKEN // 2), end - TOKEN)]


def labelled(text: str, spans: list[tuple[int, str, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kinds as bits) of the rules' findings; of an assignment its value. Equal places have all their kinds."""
    found: dict[tuple[int, int], int] = {}
    for start, kind, end in spans:
        place = ASSIGN.match(text, start, end).span(2) if kind == "assign" else (start, end)
        found[place] = found.get(place, 0) | 1 << KINDS.index(kind)
    return [(*place, kinds) for place, kinds in found.items()]


def candidates(text: str, spans: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """(start, end) of every candidate outside the rules' findings, whose rests are candidates too."""
    out, at = [], 0
    for start, end in (*sorted((s[0], s[2]) for s in spans), (len(text), len(text))):
        if start > at:
            out += [m.span() for m in CANDIDATE.finditer(text, at, start)]
        at = max(at, end)
    return out


@dataclass(frozen=True)
class Found:
    """Candidates of a column of texts, in order: number of the text, place in code points, bytes of a candidate with its
    surroundings, and which of the distinct ones it is."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    context: tuple[np.ndarray, np.ndarray]
    data: np.ndarray
    which: np.ndarray
    distinct: pa.Array

    def marks(self) -> np.ndarray:
        """Checksums of each candidate with its surroundings."""
        raw = self.data.tobytes()
        return np.array([zlib.crc32(raw[a:b]) for a, b in zip(*(c.tolist() for c in self.context))], np.int64)

    def parts(self) -> np.ndarray:
        """``dealt`` of the distinct ones."""
        bounds, raw = _bytes(self.distinct)
        raw = raw.tobytes()
        ends = np.minimum(bounds[1:], bounds[:-1] + TOKEN).tolist()
        return np.array(DEALT)[np.array([zlib.crc32(raw[a:b]) for a, b in zip(bounds.tolist(), ends)], np.int64) % len(DEALT)]

    def texts(self) -> tuple[list[str], list[int]]:
        """The distinct ones, and the numbers of those longer than a piece."""
        bounds, raw = _bytes(self.distinct)
        whole, cuts = raw.tobytes().decode("ascii"), bounds.tolist()
        return [whole[a:b] for a, b in zip(cuts, cuts[1:])], np.flatnonzero(np.diff(bounds) > TOKEN).tolist()

    def alike(self) -> np.ndarray:
        """Which of the distinct ones are numbers, dates or addresses, as ``_strata`` says."""
        return pc.match_substring_regex(pc.utf8_slice_codeunits(self.distinct, 0, 4 * TOKEN), f"^(?:{ALIKE.pattern})$").to_numpy(zero_copy_only=False)

    def of(self, chosen: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Places of the chosen ones by their text."""
        places: dict[int, list[tuple[int, int]]] = {}
        for row, start, end in zip(*(c[chosen].tolist() for c in (self.row, self.start, self.end))):
            places.setdefault(row, []).append((start, end))
        return places


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of texts and their UTF-8 bytes."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return bounds - bounds[0], np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]


def found_in(column: pa.Array, spans: list[list[tuple[int, str, int]]]) -> Found:
    """``candidates`` of every text of a column, from the bytes of the column. They are ASCII, which no other character's bytes are."""
    bounds, data = _bytes(pc.fill_null(column, "").cast(pa.large_string()))
    # Bytes at which code points begin, and the code points before a byte.
    plain = not (data & 128).any()
    lead = np.arange(len(data) + 1) if plain else np.append(np.flatnonzero((data & 192) != 128), len(data))
    point = (lambda at: at) if plain else (lambda at: np.searchsorted(lead, at))
    first = point(bounds)
    inside = _IN_CANDIDATE[data]
    for k, row in enumerate(spans):
        for start, _, end in row:
            inside[lead[first[k] + start]:lead[first[k] + end]] = False
    full = np.diff(bounds) > 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    begins[bounds[:-1][full]] = inside[bounds[:-1][full]]
    ends[bounds[1:][full] - 1] = inside[bounds[1:][full] - 1]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = b - a >= LEAST["assign"]
    a, b = a[long], b[long]
    row = np.searchsorted(bounds, a, "right") - 1
    step = np.zeros(len(data) + 1, np.int8)
    step[a] += 1
    step[b] -= 1
    own = data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    own = pa.Array.from_buffers(pa.large_string(), len(a), [None, *map(pa.py_buffer, (np.append(0, np.cumsum(b - a)), own))]).dictionary_encode()
    start = point(a)
    end = start + (b - a)
    context = lead[np.maximum(first[row], start - BEFORE)], lead[np.minimum(first[row + 1], end + AFTER)]
    return Found(row, start - first[row], end - first[row], context, data, own.indices.to_numpy(), own.dictionary)


def dealt(own: str) -> int:
    """Part of a candidate, equal ones in the same: 0 to train, 1 to set thresholds, 2 to test."""
    return DEALT[zlib.crc32(own[:TOKEN].encode("utf-8", "replace")) % len(DEALT)]


def _symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points == 0, 0, np.where(points < 128, _CODES[np.minimum(points, 127)], _SYMBOLS - 1))


def encoded(windows: list[str]) -> np.ndarray:
    """Symbol numbers of windows, a row each."""
    return _symbols("".join(windows)).reshape(-1, LENGTH)


class CharacterNetwork:
    """Embedding, one convolution, largest and mean response inside and around, a score for each kind."""

    width, depth, filters, classes = 5, 8, 24, len(KINDS)

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.weights = [
            0.5 * rng.standard_normal((_SYMBOLS, self.depth)).astype(np.float32), draw(self.width * self.depth, self.filters),
            np.zeros(self.filters, np.float32), draw(4 * self.filters, self.classes), np.zeros(self.classes, np.float32),
        ]
        inside = np.zeros(LENGTH, np.float32)
        inside[OWN:OWN + TOKEN] = 1
        self.inside = inside[:, None]
        self.around = np.r_[self.filters:2 * self.filters, 3 * self.filters:4 * self.filters]

    def _columns(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Padded symbols, and the embedded symbols around every place."""
        half = self.width // 2
        padded = np.pad(x, ((0, 0), (half, half)))
        seen = self.weights[0][np.lib.stride_tricks.sliding_window_view(padded, self.width, 1)]
        return padded, seen.reshape(x.size, -1)

    def _short(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows without places that are empty and out of reach of the convolution in all of them, and the places kept."""
        used = x.any(0)
        used[OWN] = True
        half = self.width // 2
        kept = np.unique(np.clip(np.flatnonzero(used)[:, None] + np.arange(-half, half + 1), 0, LENGTH - 1))
        return x[:, kept], kept

    def _forward(self, x: np.ndarray, kept: np.ndarray | None = None) -> tuple:
        _, kernel, bias, out, shift = self.weights
        n = len(x)
        inside = self.inside if kept is None else self.inside[kept]
        padded, columns = self._columns(x)
        active = columns @ kernel
        active += bias
        active = np.maximum(active, 0, out=active).reshape(n, len(inside), -1)
        there = (x > 0).astype(np.float32)[:, :, None]
        active *= there
        own, near = there * inside, there * (1 - inside)
        sizes = np.maximum(own.sum(1), 1), np.maximum(near.sum(1), 1)
        begin, end = np.flatnonzero(inside)[[0, -1]] + (0, 1)
        mine, rest = active[:, begin:end], active.copy()
        rest[:, begin:end] = 0
        top_own, top_near = mine.argmax(1) + begin, rest.argmax(1)
        pooled = np.concatenate([
            np.take_along_axis(active, top_own[:, None], 1)[:, 0], np.take_along_axis(rest, top_near[:, None], 1)[:, 0],
            mine.sum(1) / sizes[0], rest.sum(1) / sizes[1],
        ], axis=1)
        return padded, columns, active, own, near, sizes, top_own, top_near, pooled, pooled @ out + shift

    def logits(self, x: np.ndarray, batch: int = 512) -> np.ndarray:
        """Scores of encoded windows."""
        scores = np.zeros((len(x), self.classes), self.weights[-1].dtype)
        for rows in _alike_long(x, batch):
            scores[rows] = self._forward(*self._short(x[rows]))[-1]
        return scores

    def own_logits(self, own: list[str], batch: int = 4096) -> np.ndarray:
        """What pieces of candidates add to their scores, the constant included."""
        emb, kernel, bias, out, shift = self.weights
        f = self.filters
        # What pairs of neighbouring symbols add to the responses at a place, and the last symbol alone.
        parts = [emb @ kernel[k * self.depth:(k + 1) * self.depth] for k in range(self.width)]
        pairs = [(parts[k][:, None] + parts[k + 1][None]).reshape(-1, f) for k in (0, 2)]
        last = parts[4] + bias
        scores = np.zeros((len(own), self.classes), np.float32)
        sizes = np.array([len(p) for p in own])
        order = np.argsort(sizes, kind="stable")
        begin = 0
        while begin < len(own):
            rows = order[begin:begin + max(1, batch * 8 // max(8, int(sizes[order[min(begin + batch // 8, len(own) - 1)]])))]
            begin += len(rows)
            long = int(sizes[rows].max())
            x = _symbols("".join(own[k].ljust(long, "\0") for k in rows)).reshape(-1, long)
            padded = np.pad(x, ((0, 0), (2, 2))).T.copy()
            two = padded[:-1] * _SYMBOLS + padded[1:]
            top, total = np.zeros((2, len(rows), f), np.float32)
            for k in range(long):
                active = pairs[0].take(two[k], 0)
                active += pairs[1].take(two[k + 2], 0)
                active += last.take(padded[k + 4], 0)
                np.maximum(active, 0, out=active)
                if not padded[k + 2].all():
                    active *= (padded[k + 2] > 0)[:, None]
                np.maximum(top, active, out=top)
                total += active
            seen = np.maximum((x > 0).sum(1), 1)[:, None]
            scores[rows] = top @ out[:f] + total / seen @ out[2 * f:3 * f] + shift
        return scores

    def most_around(self) -> np.ndarray:
        """The most that any surroundings can add to each score.

        A filter's response is between 0 and the sum of its largest parts, and its mean is no larger than its largest.
        """
        emb, kernel, bias, out, _ = self.weights
        parts = [(emb @ kernel[k * self.depth:(k + 1) * self.depth]).max(0) for k in range(self.width)]
        response = np.maximum(sum(parts) + bias, 0)
        top, mean = out[self.filters:2 * self.filters], out[3 * self.filters:]
        return (response[:, None] * np.maximum(0, np.maximum(top, top + mean))).sum(0)

    def most_moved(self, other: CharacterNetwork) -> float:
        """The most by which any score of any window differs between two networks."""
        (emb, kernel, bias, out, shift), (emb_, kernel_, bias_, out_, shift_) = ([w.astype(np.float64) for w in n.weights] for n in (self, other))
        spans = [slice(k * self.depth, (k + 1) * self.depth) for k in range(self.width)]
        response = np.maximum(sum((emb @ kernel[s]).max(0) for s in spans) + bias, 0)
        moved = sum(np.abs(emb_ @ kernel_[s] - emb @ kernel[s]).max(0) for s in spans) + np.abs(bias_ - bias)
        return float((np.tile(moved, 4) @ np.abs(out_) + np.tile(response, 4) @ np.abs(out_ - out) + np.abs(shift_ - shift)).max())

    def lesson(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, batch: int = 512) -> tuple[float, list[np.ndarray]]:
        """Weighted squares of what scores lack to ``MARGIN``, with and without surroundings, and their gradients, summed."""
        loss, sums = 0.0, [np.zeros(w.shape) for w in self.weights]
        for shown in (x, _bare(x)):
            side = np.where(y, 1.0, -1.0)
            lack = np.maximum(MARGIN - side * self.logits(shown, batch), 0) * (weight > 0)
            loss += float((weight * lack ** 2).sum())
            # Windows that lack nothing have no slope.
            some = np.flatnonzero(lack.any(1))
            for rows in _alike_long(shown[some], batch):
                rows = some[rows]
                forward = self._forward(*self._short(shown[rows]))
                for total, part in zip(sums, self._back(forward, (-2 * weight[rows] * lack[rows] * side[rows]).astype(np.float32))):
                    total += part
        return loss, sums

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 16, batch: int = 128, rate: float = 0.004) -> None:
        """Adam on the cross-entropy of each kind; half of the windows are shown without their surroundings."""
        rng = np.random.default_rng(9)
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        share = np.clip(y.mean(0), 1 / len(y), 1 - 1 / len(y))
        scale = np.where(y, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        step = 0
        around = np.ones(LENGTH, bool)
        around[OWN:OWN + TOKEN] = False
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for begin in range(0, len(y), batch):
                rows = order[begin:begin + batch]
                shown = x[rows].copy()
                shown[np.ix_(rng.random(len(rows)) < 0.5, around)] = 0
                step += 1
                for k, gradient in enumerate(self._gradients(shown, y[rows], scale[rows])):
                    first, second = moments[k]
                    first += 0.1 * (gradient - first)
                    second += 0.001 * (gradient ** 2 - second)
                    self.weights[k] -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-7)
                # What surroundings can add stays small against what a candidate says itself; see ``accepted``.
                self.weights[3][self.around] *= 1 - rate * AROUND_DECAY

    def _gradients(self, x: np.ndarray, y: np.ndarray, scale: np.ndarray) -> list[np.ndarray]:
        forward = self._forward(x)
        return self._back(forward, (_sigmoid(forward[-1]) - y) * scale / len(y))

    def _back(self, forward: tuple, d_logits: np.ndarray) -> list[np.ndarray]:
        emb, kernel, _, out, _ = self.weights
        padded, columns, active, own, near, sizes, top_own, top_near, pooled, _ = forward
        d_pooled = d_logits @ out.T
        f = self.filters
        d_active = own * (d_pooled[:, None, 2 * f:3 * f] / sizes[0][:, None]) + near * (d_pooled[:, None, 3 * f:] / sizes[1][:, None])
        n, cols = np.arange(len(d_logits))[:, None], np.arange(f)[None, :]
        d_active[n, top_own, cols] += d_pooled[:, :f] * own[n, top_own, 0]
        d_active[n, top_near, cols] += d_pooled[:, f:2 * f] * near[n, top_near, 0]
        d_active = (d_active * (active > 0)).reshape(-1, f)
        d_columns = (d_active @ kernel.T).reshape(*active.shape[:2], self.width, self.depth)
        d_emb = np.zeros_like(emb)
        for k in range(self.width):
            seen = padded[:, k:k + active.shape[1]].ravel()
            one = d_columns[:, :, k].reshape(-1, self.depth)
            for d in range(self.depth):
                d_emb[:, d] += np.bincount(seen, one[:, d], _SYMBOLS).astype(emb.dtype)
        return [d_emb, columns.T @ d_active, d_active.sum(0), pooled.T @ d_logits, d_logits.sum(0)]


@dataclass(frozen=True)
class SecretModel:
    """Network, the slope and shift that calibrate each kind's score, and each kind's threshold.

    ``recall`` is the share of findings that each kind's threshold keeps among ``tested`` findings (each with and without
    surroundings) that set nothing, ``precision`` the share of findings among the test candidates that it accepts; NaN
    where there was nothing to test. A kind that the rules never found has no threshold and accepts nothing.
    """

    network: CharacterNetwork
    slope: np.ndarray
    shift: np.ndarray
    thresholds: np.ndarray
    recall: np.ndarray
    precision: np.ndarray
    tested: np.ndarray

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        """Calibrated probability of each kind."""
        return _sigmoid(logits * self.slope + self.shift)

    def _least_logits(self) -> np.ndarray:
        """Scores below these are below every threshold."""
        known = np.clip(self.thresholds, 1e-12, 1 - 1e-12)
        least = (np.log(known / (1 - known)) - self.shift) / self.slope
        return np.where(self.thresholds > 1, np.inf, least)

    def accepted(self, texts: list[str], found: list[list[tuple[int, int]]], known: dict[str, bool] | None = None) -> list[np.ndarray]:
        """Which candidates of every text some threshold accepts: those with a piece whose score reaches it.

        A piece's score is what its own characters add and what surrounds it adds. Where the first stays below every
        threshold even with the most that surroundings can add, the piece is rejected, and all others are scored
        whole; ``known`` remembers this of pieces that come again.
        """
        known = {} if known is None else known
        out = [np.zeros(len(places), bool) for places in found]
        owner, split = [], []
        for t, places in enumerate(found):
            for c, (start, end) in enumerate(places):
                for piece in pieces(start, end) if end - start > TOKEN else ((start, end),):
                    owner.append((t, c))
                    split.append((t, *piece))
        own = [texts[t][a:b] for t, a, b in split]
        remember(self.network, dict.fromkeys(own), self._least_logits(), known)
        reached = [k for k, piece in enumerate(own) if known[piece]]
        for begin in range(0, len(reached), WINDOWS):
            open_ = reached[begin:begin + WINDOWS]
            logits = self.network.logits(encoded([window(texts[split[k][0]], *split[k][1:]) for k in open_]))
            for k in np.flatnonzero((self.probabilities(logits) >= self.thresholds).any(1)):
                t, c = owner[open_[k]]
                out[t][c] = True
        return out


def remember(network: CharacterNetwork, own: Iterable[str], least: np.ndarray, known: dict[str, bool]) -> None:
    """Note of distinct pieces whether their score can reach the least with the most that surroundings can add."""
    own = list(own)
    new = [piece for piece in own if piece not in known]
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = own
    reachable = (network.own_logits(new) + network.most_around() + SLACK >= least).any(1)
    known.update(zip(new, reachable.tolist()))


def _alike_long(x: np.ndarray, batch: int) -> Iterator[np.ndarray]:
    """Batches of windows with candidates of about one length."""
    order = np.argsort((x[:, OWN:OWN + TOKEN] > 0).sum(1), kind="stable")
    for begin in range(0, len(x), batch):
        yield order[begin:begin + batch]


def _bare(x: np.ndarray) -> np.ndarray:
    """Windows without their surroundings."""
    bare = x.copy()
    bare[:, :BEFORE] = 0
    bare[:, OWN + TOKEN + GAP:] = 0
    return bare


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def _calibrated(margin: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits labels to margins (smoothed targets) that occur ``n`` times."""
    a, b = 1.0, 0.0
    n = np.ones(len(y)) if n is None else n
    target = np.where(y, (n[y].sum() + 1) / (n[y].sum() + 2), 1 / (n[~y].sum() + 2))
    for _ in range(60):
        p = _sigmoid(a * margin + b)
        g = np.array([(n * (p - target) * margin).sum(), (n * (p - target)).sum()])
        w = n * p * (1 - p)
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        move = np.linalg.solve(h, g)
        a, b = max(1e-3, a - np.clip(move[0], -1, 1)), b - np.clip(move[1], -1, 1)
    return float(a), float(b)


def _best_logits(network: CharacterNetwork, x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Largest score of each candidate's pieces, seen with and then without their surroundings."""
    first = np.flatnonzero(np.diff(places, prepend=-1))
    return np.concatenate([np.maximum.reduceat(network.logits(v).astype(np.float64), first, axis=0) for v in (x, _bare(x))])


def fit_secrets(
    windows: list[str], labels: np.ndarray, least_recall: float = LEAST_RECALL, pieces_of: np.ndarray | None = None,
    docs: DataFrame | None = None, text: str = "text",
) -> SecretModel | None:
    """Train on two thirds of the labelled candidates, calibrate and set thresholds on a sixth, test on the last sixth.

    ``labels`` holds the kinds of each candidate as bits, so one that is of two kinds teaches both. ``pieces_of``
    numbers the candidate of each window, in order, where some have several: each is learned from, and the largest score
    of a candidate counts. A kind's threshold lies ``SLACK`` below the score that keeps ``least_recall`` of that sixth's
    findings, seen with and without their surroundings, however low that is and however few they are. Without
    findings, or without other candidates, there is no model.

    With ``docs``, the windows only start the network: every candidate of that table teaches it, calibrates it and sets
    and tests the thresholds (``taught_by_all``), and candidates are dealt out by their own text.
    """
    y = (labels[:, None] >> np.arange(len(KINDS)) & 1).astype(bool)
    if not y.any() or y.any(1).all():
        _LOG.warning("secrets: %d findings of %d candidates: nothing to learn", y.any(1).sum(), len(y))
        return None
    x = encoded(windows)
    places = np.arange(len(labels)) if pieces_of is None else pieces_of
    # Parts are dealt out within the findings of a kind and within the rest, so that each has its share of all.
    turn = np.zeros(len(labels), np.int64)
    for value in np.unique(labels):
        turn[labels == value] = np.arange((labels == value).sum()) % len(DEALT)
    part = np.array(DEALT)[turn[places]]
    if docs is not None:
        first = np.flatnonzero(np.diff(places, prepend=-1))
        own = np.array([dealt(windows[k][OWN:OWN + TOKEN].rstrip("\0")) for k in first])
        for value in np.unique(labels):
            if (own[labels == value] == 0).any():
                part = np.where(labels[places] == value, own[places], part)
    network = CharacterNetwork()
    network.fit(x[part == 0], y[places[part == 0]])
    if docs is not None:
        return taught_by_all(network, docs, text, least_recall)
    n = len(KINDS)
    slope, shift, thresholds = np.ones(n), np.zeros(n), np.full(n, 2.0)
    recall, precision, tested = np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, np.int64)
    set_on, seen = (part == 1, np.unique(places[part == 1])), (part == 2, np.unique(places[part == 2]))
    for k, kind in enumerate(KINDS):
        if not y[:, k].any():
            continue
        # Findings too few to reach the second part set the threshold themselves.
        rows, own = set_on if y[set_on[1], k].any() else (np.isin(places, np.flatnonzero(y[:, k] | ~y.any(1))), np.flatnonzero(y[:, k] | ~y.any(1)))
        margin, truth = _best_logits(network, x[rows], places[rows])[:, k], np.tile(y[own, k], 2)
        slope[k], shift[k] = _calibrated(margin, truth)
        scores = np.sort(margin[truth])
        least = scores[int(np.floor((1 - least_recall) * len(scores)))] - SLACK
        thresholds[k] = _sigmoid(np.array(least * slope[k] + shift[k]))
        rows, own = seen
        if len(own):
            margin, truth = _best_logits(network, x[rows], places[rows])[:, k], np.tile(y[own, k], 2)
            taken = _sigmoid(margin * slope[k] + shift[k]) >= thresholds[k]
            tested[k] = truth.sum() // 2
            recall[k] = taken[truth].mean() if truth.any() else np.nan
            precision[k] = truth[taken].mean() if taken.any() else np.nan
        _LOG.info("secrets: %s at %.3f keeps %.3f of %d tested findings, %.3f of what it accepts are findings",
                  kind, thresholds[k], recall[k], tested[k], precision[k])
    return SecretModel(network, slope, shift, thresholds, recall, precision, tested)


def lessons(docs: DataFrame, network: CharacterNetwork, text: str = "text") -> DataFrame:
    """part, label, mark, window, n, seen: what every candidate of the table teaches, equal rows counted.

    A row is a piece of a candidate: ``mark`` stands for the candidate, ``n`` counts pieces and ``seen``
    candidates. All findings have rows, and all pieces of others whose score can come within ``MARGIN`` and ``LEEWAY`` of 0. Pieces
    that cannot lose nothing with any network that ``most_moved`` keeps within the leeway: these, and the candidates of
    such pieces alone, are counted in rows without a window.
    """
    least = np.full(len(KINDS), -MARGIN - LEEWAY)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        beyond = np.zeros((max(DEALT) + 1, 2), np.int64)
        for batch in bounded_rows(parts, 0, RUN_BYTES):
            rows: list[tuple] = []
            spans = spans_of(batch.column(0))
            found = found_in(batch.column(0), spans)
            distinct, long = found.texts()
            times = np.bincount(found.which, minlength=len(distinct))
            split = {k: [distinct[k][a:b] for a, b in pieces(0, len(distinct[k]))] for k in long}
            remember(network, dict.fromkeys([own for k, own in enumerate(distinct) if k not in split] + [p for cut in split.values() for p in cut])
                     if long else distinct, least, known)
            part = found.parts()
            open_ = np.array([*map(known.get, distinct)], bool)
            shut = (~open_).astype(np.int64)
            for k, cut in split.items():
                shut[k] = sum(not known[p] for p in cut)
                open_[k] = shut[k] < len(cut)
            np.add.at(beyond, (part, 0), times * shut)
            np.add.at(beyond, (part, 1), times * ~open_)
            places = found.of(open_[found.which])
            looked = [k for k, row in enumerate(spans) if row or k in places]
            for k, value in zip(looked, batch.column(0).take(pa.array(looked, pa.int64())).to_pylist()):
                for a, b, label in (*labelled(value, spans[k]), *((*place, 0) for place in places.get(k, ()))):
                    around = value[max(0, a - BEFORE):b + AFTER].encode("utf-8", "replace")
                    mark = int.from_bytes(hashlib.blake2b(b"%d %d " % (min(a, BEFORE), b - a) + around, digest_size=8).digest(), "little", signed=True)
                    mine, first = dealt(value[a:b]), 1
                    for p in pieces(a, b):
                        if label or known[value[p[0]:p[1]]]:
                            rows.append((mine, label, mark, window(value, *p), 1, first))
                            first = 0
                    if len(rows) >= 16 * WINDOWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*((part, 0, 0, None, int(n), int(seen)) for part, (n, seen) in enumerate(beyond))), kinds)], names)

    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["part", "label", "mark", "window", "n", "seen"]
    found = docs.select(text).mapInArrow(batches, "part int, label int, mark long, window string, n long, seen long")
    return stored(found.groupBy(*names[:4]).agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")), "secret-lessons")


def _truth(labels: np.ndarray) -> np.ndarray:
    return (labels[:, None] >> np.arange(len(KINDS)) & 1).astype(bool)


def descend(network: CharacterNetwork, table: DataFrame) -> CharacterNetwork:
    """The network after steps against the gradient of what all training candidates of ``lessons`` lose.

    Findings of a kind and all others weigh the same. A step that loses more is halved, and none leads further than
    ``LEEWAY`` from the start, so the sums are those of the whole table.
    """
    train = table.where("part = 0")
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    labels, sizes = np.array([*counts]), np.array([*counts.values()], float)
    positive = (_truth(labels) * sizes[:, None]).sum(0)
    weights = 0.5 / np.maximum([sizes.sum() - positive, positive], 1)
    # A kind that training never found teaches nothing.
    weights[:, positive == 0] = 0
    taught = train.where("window is not null").select("label", "window", "n")

    def look(net: CharacterNetwork) -> tuple[float, list[np.ndarray]]:
        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + sum(w.size for w in net.weights))
            for part in parts:
                for begin in range(0, part.num_rows, 4096):
                    rows = part.slice(begin, 4096)
                    y = _truth(rows.column(0).to_numpy())
                    weight = np.where(y, weights[1], weights[0]) * rows.column(2).to_numpy()[:, None]
                    loss, sums = net.lesson(encoded(rows.column(1).to_pylist()), y, weight)
                    total += np.concatenate([[loss], *(g.ravel() for g in sums)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "value"])

        sums = taught.mapInArrow(batches, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        total = np.zeros(1 + sum(w.size for w in net.weights))
        for r in sums:
            total[r["place"]] = r["value"]
        cuts = np.cumsum([1] + [w.size for w in net.weights])
        return float(total[0]), [total[a:b].reshape(w.shape) for a, b, w in zip(cuts, cuts[1:], net.weights)]

    best, (loss, gradients), rate = network, look(network), STEP
    first = loss
    for _ in range(LOOKS - 1):
        while rate > 1e-5:
            tried = CharacterNetwork()
            tried.weights = [
                (np.round((w - rate * max(np.linalg.norm(w), 0.1) * g / (np.linalg.norm(g) + 1e-30)) * WEIGHT_GRID) / WEIGHT_GRID).astype(np.float32)
                for w, g in zip(best.weights, gradients)
            ]
            if network.most_moved(tried) <= LEEWAY - SLACK:
                break
            rate /= 2
        if loss == 0 or rate <= 1e-5:
            break
        seen = look(tried)
        if seen[0] < loss:
            best, (loss, gradients), rate = tried, seen, rate * 1.5
        else:
            rate /= 4
    _LOG.info("secrets: %d candidates' pieces lose %.5f, %.5f before; no score moved by more than %.2f",
              sizes.sum(), loss, first, network.most_moved(best))
    return best


def score_counts(network: CharacterNetwork, table: DataFrame) -> list:
    """part, label, kind, step, n: candidates by their pieces' largest score with and without surroundings, in ``SCORE_GRID`` steps.

    Candidates other than findings count as at least ``-MARGIN``, which those without rows in the table do not exceed.
    """
    n = len(KINDS)
    names = [f"{view}{k}" for view in ("shown", "bare") for k in range(n)]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for begin in range(0, part.num_rows, 4096):
                rows = part.slice(begin, 4096)
                scores = np.full((rows.num_rows, 2 * n), -MARGIN)
                there = np.flatnonzero(rows.column(3).is_valid().to_numpy(zero_copy_only=False))
                if len(there):
                    x = encoded(rows.column(3).take(pa.array(there)).to_pylist())
                    scores[there] = np.concatenate([network.logits(x), network.logits(_bare(x))], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(k) for k in (0, 1, 2, 5)), *map(pa.array, np.floor(scores * SCORE_GRID).astype(np.int64).T)],
                    ["part", "label", "mark", "seen", *names])

    scored = table.select("part", "label", "mark", "window", "n", "seen").mapInArrow(
        batches, "part int, label int, mark long, seen long, " + ", ".join(f"{c} long" for c in names))
    whole = scored.groupBy("part", "label", "mark").agg(*(F.max(c).alias(c) for c in names), F.sum("seen").alias("n"))
    floor = int(-MARGIN * SCORE_GRID)
    one = F.explode(F.array(*(F.struct(
        F.lit(i % n).alias("kind"), F.when(F.col("label") == 0, F.greatest(F.col(c), F.lit(floor))).otherwise(F.col(c)).alias("step")
    ) for i, c in enumerate(names))))
    return whole.select("part", "label", "n", one.alias("one")).groupBy("part", "label", "one.kind", "one.step").agg(F.sum("n").alias("n")).collect()


def taught_by_all(network: CharacterNetwork, docs: DataFrame, text: str = "text", least_recall: float = LEAST_RECALL) -> SecretModel:
    """The model that every candidate of the table has taught, calibrated and tested, from a network to start with."""
    table = lessons(docs, network, text)
    network = descend(network, table)
    rows = score_counts(network, table)
    part, label, kind, step, count = (np.array([r[c] for r in rows], np.int64) for c in ("part", "label", "kind", "step", "n"))
    n = len(KINDS)
    slope, shift, thresholds = np.ones(n), np.zeros(n), np.full(n, 2.0)
    recall, precision, tested = np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, np.int64)
    for k, name in enumerate(KINDS):
        mine, truth, margin = (kind == k) & (count > 0), label >> k & 1 == 1, step / SCORE_GRID
        if not (mine & truth).any():
            continue
        # Findings too few to reach the second part set the threshold themselves.
        own = mine & (part == 1)
        own = own if (own & truth).any() else mine & (truth | (label == 0))
        slope[k], shift[k] = _calibrated(np.maximum(margin[own], -MARGIN), truth[own], count[own].astype(float))
        kept = np.flatnonzero(own & truth)
        kept = kept[np.argsort(margin[kept], kind="stable")]
        upto = np.cumsum(count[kept])
        least = margin[kept[np.searchsorted(upto, np.floor((1 - least_recall) * upto[-1]), "right")]] - SLACK
        thresholds[k] = _sigmoid(np.array(least * slope[k] + shift[k]))
        seen = mine & (part == 2)
        taken = seen & (margin >= least)
        tested[k] = count[seen & truth].sum() // 2
        recall[k] = count[taken & truth].sum() / count[seen & truth].sum() if (seen & truth).any() else np.nan
        precision[k] = count[taken & truth].sum() / count[taken].sum() if taken.any() else np.nan
        _LOG.info("secrets: %s at %.3f keeps %.3f of %d tested findings, %.3f of what it accepts are findings",
                  name, thresholds[k], recall[k], tested[k], precision[k])
    return SecretModel(network, slope, shift, thresholds, recall, precision, tested)


def _strata(label: int, own: str) -> list[int]:
    """Samples that a candidate belongs to: one for each of its kinds, else that of what looks like a secret or the rest."""
    if label:
        return [2 + k for k in range(len(KINDS)) if label >> k & 1]
    return [1 if ALIKE.fullmatch(own, 0, 4 * TOKEN) else 0]


def training_rows(docs: DataFrame, text: str = "text") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Windows to start learning from, kinds of each candidate as bits, and candidate of each window.

    At most ``KIND_ROWS`` findings of a kind, ``ALIKE_ROWS`` other candidates of numbers, dates and addresses, and
    ``OTHER_ROWS`` of the rest, distinct and with the smallest hashes, each with at most ``PIECES`` windows: those with the
    smallest hashes. The bounds are the same at every size, and no task keeps more.
    """
    most = [OTHER_ROWS, ALIKE_ROWS] + [KIND_ROWS] * len(KINDS)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[tuple[int, int, tuple[str, ...]], None]] = [{} for _ in most]
        limits = [1 << 32] * len(most)
        for part in bounded_rows(parts, 0, RUN_BYTES):
            spans = spans_of(part.column(0))
            found = found_in(part.column(0), spans)
            places = found.of(found.marks() <= np.where(found.alike()[found.which], limits[1], limits[0]))
            looked = [k for k, row in enumerate(spans) if row or k in places]
            for k, value in zip(looked, part.column(0).take(pa.array(looked, pa.int64())).to_pylist()):
                for start, end, label in (*labelled(value, spans[k]), *((*c, 0) for c in places.get(k, ()))):
                    mark = zlib.crc32(value[max(0, start - BEFORE):end + AFTER].encode("utf-8", "replace"))
                    for stratum in _strata(label, value[start:end] if label == 0 else ""):
                        if mark > limits[stratum]:
                            continue
                        cut = pieces(start, end)
                        if len(cut) > PIECES:
                            cut = sorted(sorted(cut, key=lambda p: zlib.crc32(value[p[0]:p[1]].encode("utf-8", "replace")))[:PIECES])
                        mine = kept[stratum]
                        mine[mark, label, tuple(window(value, *p) for p in cut)] = None
                        if len(mine) >= 2 * most[stratum]:
                            kept[stratum] = dict.fromkeys(sorted(mine)[:most[stratum]])
                            limits[stratum] = max(kept[stratum])[0]
        rows = [(stratum, *item) for stratum, mine in enumerate(kept) for item in sorted(mine)[:most[stratum]]]
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.int32()), pa.array([list(r[3]) for r in rows], pa.list_(pa.string())),
        ], ["stratum", "mark", "label", "windows"])

    found = stored(
        docs.select(text).mapInArrow(batches, "stratum int, mark long, label int, windows array<string>"), "secret-candidates"
    )
    rows = set()
    for stratum, n in enumerate(most):
        chosen = found.where(F.col("stratum") == stratum).drop("stratum").distinct().orderBy("mark", "label", "windows").limit(n)
        rows |= {(r["label"], tuple(r["windows"])) for r in chosen.collect()}
    ordered = sorted(rows, key=lambda r: (hashlib.md5("".join(r[1]).encode("utf-8", "replace")).digest(), r))
    return (
        [w for _, ws in ordered for w in ws], np.array([label for label, _ in ordered], np.int64),
        np.array([k for k, (_, ws) in enumerate(ordered) for _ in ws], np.int64),
    )


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256 and spans of every row.

    ``spans`` holds the rules' findings and, as ``learned``, every other candidate that the network
    accepts. Null and empty texts have none; repeated rows are rows of their own.
    """
    windows, labels, pieces_of = training_rows(docs, text)
    model = fit_secrets(windows, labels, pieces_of=pieces_of, docs=docs, text=text)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    least = model._least_logits() if model else None

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for part in bounded_rows(parts, 1, RUN_BYTES):
            spans = spans_of(part.column(1))
            counts = [pa.array([sum(s[1] == k for s in row) for row in spans], pa.int64()) for k in KINDS]
            digests = [hashlib.sha256(joined(row).encode()).hexdigest() for row in spans]
            if model:
                found = found_in(part.column(1), spans)
                distinct, long = found.texts()
                remember(model.network, [own for own in distinct if len(own) <= TOKEN] if long else distinct, least, known)
                # Only candidates that can be accepted, and longer ones, are looked at by place.
                reach = np.array([*map(known.get, distinct)], bool)
                reach[long] = True
                places = found.of(reach[found.which])
                for begin in range(0, len(places), TEXTS):
                    rows = [*places][begin:begin + TEXTS]
                    texts = part.column(1).take(pa.array(rows, pa.int64())).to_pylist()
                    for k, taken in zip(rows, model.accepted(texts, [places[k] for k in rows], known)):
                        spans[k] += [(places[k][c][0], LEARNED, places[k][c][1]) for c in np.flatnonzero(taken)]
                        spans[k].sort(key=lambda s: (s[0], (*KINDS, LEARNED).index(s[1])))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *counts, pa.array(digests, pa.string()), pa.array(map(joined, spans), pa.string())], names
            )

    return docs.select(key, text).mapInArrow(
        batches, f"{key} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
