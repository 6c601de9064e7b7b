"""Language identification by bit-sliced Bloom filters of character n-grams.

A filter is one table of words with a bit per language: the AND of an n-gram's words names all
languages that contain it at once. A text's n-grams are counted per language, the
count is corrected for the false positives that the filling of the language's slice
predicts, and the largest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.batches import bounded_rows
from riskloom.llm.quality import is_held_out

UNKNOWN = "und"
SIZES = (3, 4)
# Slots and hashes of the filter.
FILTER_BITS, HASHES = 21, 3
# Bound of the rows that are learned from (those with the smallest hashes of their key), and
# how often a language must use an n-gram in them.
TRAINING_ROWS, LEAST_COUNT = 20_000, 3
_CHUNK = 1 << 20
_SPACE = 32
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> np.ndarray:
    """Hashes of all character n-grams within words, in lower case, word ends included.

    Signs, digits and spaces only divide words; a word of one letter is one n-gram.
    """
    if not text:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint64)
    # One space for every run of other signs, and one at both ends.
    letter = np.concatenate([[False], letter, [False]])
    codes = np.concatenate([[_SPACE], codes, [_SPACE]])
    keep = letter | np.concatenate([[True], letter[:-1]])
    codes = np.where(letter, codes, _SPACE)[keep].astype(np.uint64)
    space = codes == _SPACE
    found = []
    for size in SIZES:
        n = len(codes) - size + 1
        if n <= 0:
            continue
        value = np.full(n, size, np.uint64)
        inner = np.zeros(n, bool)
        for k in range(size):
            value = (value ^ codes[k:k + n]) * _MIX[0]
            if 0 < k < size - 1:
                inner |= space[k:k + n]
        ok = ~inner
        found.append(value[ok])
    values = np.concatenate(found)
    values = (values ^ (values >> np.uint64(29))) * _MIX[1]
    return values ^ (values >> np.uint64(32))


def _slots(values: np.ndarray) -> np.ndarray:
    """The filter slots of each n-gram."""
    first, second = values >> np.uint64(40), (values >> np.uint64(8)) | np.uint64(1)
    k = np.arange(HASHES, dtype=np.uint64)
    return ((first + k[:, None] * second) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


@dataclass(frozen=True)
class LanguageFilter:
    """Bits per slot and language, and the share of false positives per language."""

    names: tuple[str, ...]
    bits: np.ndarray  # slots x words of 64 languages
    false_share: np.ndarray
    usual: int  # the language with the most learned rows

    def shares(self, text: str | None) -> np.ndarray | None:
        """Corrected share of n-grams per language, or None for a text without letters."""
        values = ngrams(text)
        if len(values) == 0 or not self.names:
            return None
        slots = _slots(values)
        masks = self.bits[slots[0]]
        for row in slots[1:]:
            masks &= self.bits[row]
        hits = np.zeros(len(self.names))
        for at, name in enumerate(self.names):
            hits[at] = np.count_nonzero((masks[:, at // 64] >> np.uint64(at % 64)) & np.uint64(1))
        expected = len(values) * self.false_share
        return np.clip((hits - expected) / (1 - self.false_share), 0, None) / len(values)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its part of all corrected shares; ties go to the first name."""
        shares = self.shares(text)
        if shares is None:
            return UNKNOWN, 0.0
        total = shares.sum()
        if total <= 0:
            return self.names[self.usual], 0.0
        best = int(np.argmax(shares))
        return self.names[best], float(shares[best] / total)


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n), summed over up to ``_CHUNK`` n-grams; null gram: rows."""
    def summed(name: str, held: list[np.ndarray], rows: int) -> pa.RecordBatch:
        grams, n = np.unique(np.concatenate(held), return_counts=True)
        gram = pa.array([*grams.astype(np.int64).tolist(), None], pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(gram)), gram, pa.array(np.append(n, rows))], ["lang", "gram", "n"]
        )

    held: dict[str, list[np.ndarray]] = {}
    for part in parts:
        for name, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            grams = held.setdefault(name, [])
            grams.append(ngrams(value))
            if sum(map(len, grams[-64:])) > _CHUNK // 8 or len(grams) >= 4096:
                yield summed(name, grams, len(grams))
                held[name] = []
    for name, grams in held.items():
        if grams:
            yield summed(name, grams, len(grams))


def build_filter(names: tuple[str, ...], members: list[np.ndarray], usual: int) -> LanguageFilter:
    """A filter over each language's n-grams."""
    bits = np.zeros((1 << FILTER_BITS, max(1, -(-len(names) // 64))), np.uint64)
    false_share = np.zeros(len(names))
    for at, grams in enumerate(members):
        one = np.uint64(1) << np.uint64(at % 64)
        bits[np.unique(_slots(grams)), at // 64] |= one
        false_share[at] = ((bits[:, at // 64] & one) > 0).mean() ** HASHES
    return LanguageFilter(names, bits, false_share, usual)


def fit_languages(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = TRAINING_ROWS
) -> LanguageFilter:
    """Learn from rows of ``docs`` that have a language and are not held out (``held_out``).

    The rows with the ``max_rows`` smallest hashes of their key are used, with their whole
    texts. A language contains an n-gram that it uses at least ``LEAST_COUNT`` times and
    for a larger part of its n-grams than the languages do on average.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    # Bounded: max_rows keys.
    chosen = F.broadcast(known.select(key).orderBy(F.xxhash64(key), key).limit(max_rows).distinct())
    totals = (
        known.select(key, lang, text).join(chosen, key, "left_semi").select(lang, text)
        .mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .where((F.col("n") >= LEAST_COUNT) | F.col("gram").isNull()).toArrow()
    )
    langs = np.array(totals.column("lang").to_pylist(), dtype=object)
    names = tuple(sorted(set(langs.tolist())))
    if not names:
        return LanguageFilter((), np.zeros((1, 1), np.uint64), np.zeros(0), 0)
    n = np.asarray(totals.column("n"))
    is_gram = np.asarray(totals.column("gram").is_valid())
    at = np.searchsorted(np.array(names, dtype=object), langs)
    grams, code = np.unique(
        np.asarray(totals.column("gram").fill_null(0))[is_gram].astype(np.uint64), return_inverse=True
    )
    table = np.zeros((len(names), len(grams)))
    np.add.at(table, (at[is_gram], code), n[is_gram])
    learned = np.zeros(len(names))
    np.add.at(learned, at[~is_gram], n[~is_gram])
    share = table / np.maximum(table.sum(1, keepdims=True), 1)
    member = share > share.mean(0) if len(names) > 1 else share > 0
    return build_filter(names, [grams[m] for m in member], int(np.argmax(learned)))


def held_out(key: Column) -> Column:
    """Rows that no language is learned from."""
    return is_held_out(key, 3, 1)


def languages(docs: DataFrame, model: LanguageFilter, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score of every row; whole texts.

    Null texts and texts without a letter are ``und`` with score 0, as is everything when
    nothing was learned. A text none of whose n-grams is known gets the language with the most
    learned rows, with score 0. The filter (2^``FILTER_BITS`` words) travels once per executor.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded_rows(parts, 1):
            found = [sent.value.predict(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [key, "lang_pred", "score"],
            )

    return docs.select(key, text).mapInArrow(batches, f"{key} {kind}, lang_pred string, score double")
