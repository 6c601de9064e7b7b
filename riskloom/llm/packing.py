"""Packing tokenised documents into sequences of bounded length."""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.batches import bounded_rows
from riskloom.llm.bins import Filling, least_bins, pack_counts
from riskloom.llm.spread import hashed_at, running_sums
from riskloom.llm.tokens import token_ids
from riskloom.plans.materialise import stored

_LOG = logging.getLogger(__name__)
SEQUENCE_TOKENS = 1024
END_ID = 2


def token_pieces(
    docs: DataFrame, key: str = "doc_id", text: str = "text", room: int = SEQUENCE_TOKENS,
    end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``room`` tokens: key, piece, start, length, ids_crc32 (and ids).

    A document is the ids of its whole text and ``end_id``. Only longer ones are cut; the
    first piece takes what whole pieces leave over. A null text is an empty one: its
    end id alone. Repeated rows give pieces of their own.
    """
    kind = docs.schema[key].dataType.simpleString()
    extra = ", ids binary" if with_ids else ""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded_rows(parts, 1):
            row, piece, start, length, crc, content = [], [], [], [], [], []
            for k, value in enumerate(part.column(1).to_pylist()):
                ids = np.append(token_ids(value or ""), end_id).astype("<u4").tobytes()
                n = len(ids) // 4
                ends = range((n - 1) % room + 1, n + 1, room)
                begin = 0
                for number, end in enumerate(ends):
                    cut = ids[4 * begin:4 * end]
                    row.append(k)
                    piece.append(number)
                    start.append(begin)
                    length.append(end - begin)
                    crc.append(zlib.crc32(cut))
                    if with_ids:
                        content.append(cut)
                    begin = end
            columns = [
                part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(content, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(key, text).mapInArrow(
        batches, f"{key} {kind}, piece int, start long, length long, ids_crc32 long{extra}"
    )


class _Places:
    """Where the n-th piece of a length goes: ranges of ranks per length, in sorted arrays."""

    def __init__(self, plan: list[tuple[Filling, int]], room: int):
        taken = np.zeros(room + 1, np.int64)
        found: list[tuple[int, int, int, int, int]] = []
        sequence = 0
        for filling, times in plan:
            at = 0
            while at < len(filling):
                size = filling[at]
                each = filling[at:].count(size)
                offset = sum(filling[:at])
                found.append((size, int(taken[size]), each, sequence, offset))
                taken[size] += each * times
                at += each
            sequence += times
        table = np.array(sorted(found), np.int64).reshape(-1, 5)
        self.size, self.first, self.each, self.sequence, self.offset = table.T
        # One sorted key for (length, rank): ranks are below 2^50, lengths below 2^13.
        self.keys = (self.size << 50) + self.first

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, (length << 50) + rank, "right") - 1
        local = rank - self.first[at]
        return self.sequence[at] + local // self.each[at], self.offset[at] + local % self.each[at] * length


def pack(pieces: DataFrame, key: str = "doc_id", room: int = SEQUENCE_TOKENS) -> DataFrame:
    """Add sequence_id and offset to pieces (see ``token_pieces``).

    The driver sees one count per length (at most ``room`` of them) and plans fillings for the
    counts; the n-th piece of a length, counted in many tasks, takes the n-th
    place of that length. The plan's size depends on ``room``, not on the data.
    """
    pieces = stored(pieces, "pack-pieces")
    counts = np.zeros(room + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    plan = pack_counts(counts, room)
    _LOG.info("packing: %d sequences, at least %d are needed", sum(times for _, times in plan), least_bins(counts, room))
    places = _Places(plan, room)
    ranked = running_sums(
        pieces, ["length"], hashed_at(key, "piece", "start"),
        [F.col(key), F.col("piece"), F.col("start"), F.col("ids_crc32")],
        {"rank": F.lit(1).cast("long")}, int(counts.sum()),
    )
    names = pieces.columns
    schema = pieces.select(*names).schema.add("sequence_id", "long").add("offset", "long")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            length = part.column(names.index("length")).to_numpy()
            sequence, offset = places.of(length, part.column(len(names)).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    return ranked.select(*names, "rank").mapInArrow(batches, schema)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", room: int = SEQUENCE_TOKENS) -> DataFrame:
    """Pieces of all rows of ``docs`` with their sequence and offset; no rows give none."""
    return pack(token_pieces(docs, key, text, room), key, room)
