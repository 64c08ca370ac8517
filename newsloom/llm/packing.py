"""Packing: token pieces into fixed-length sequences by first-fit decreasing in randomised groups."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import byte_bpe, ship, text_or_empty
from newsloom.session import stage

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
END_ID = 1


class Tournament:
    """Room left in bins, as a tournament tree: each inner node holds the larger of its two children."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.width = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.width)

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first bin with room for it; the bin and the room it had."""
        room, node = self.room, 1
        while node < self.width:
            node *= 2
            if room[node] < size:
                node += 1
        had, bin_ = room[node], node - self.width
        room[node] = had - size
        while node > 1:
            node //= 2
            larger = max(room[2 * node], room[2 * node + 1])
            if room[node] == larger:
                break
            room[node] = larger
        return bin_, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (at most ``capacity``), longest first, equal ones in the given order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = Tournament(max(len(lengths), 1), capacity)
    for i in np.argsort(-lengths, kind="stable"):
        bins[i], had = tree.place(int(lengths[i]))
        offsets[i] = capacity - had
    return bins, offsets


def _cut(vocabulary: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(vocabulary)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(np.asarray(encoder.encode_ordinary(text), "<u4"), np.uint32(END_ID)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    piece = ids[at : at + capacity]
                    rows.append((doc, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in columns],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return run


def token_pieces(
    docs: DataFrame, capacity: int = 2048, key: str = "doc_id", text: str = "text",
    vocabulary: str = "byte_bpe_50k.tiktoken",
) -> DataFrame:
    """The ids of each text and a final 1, cut every ``capacity`` ids: one row a piece, without the ids themselves."""
    ship(docs.sparkSession)
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(
        _cut(vocabulary, capacity), PIECE
    )


def pack(pieces: DataFrame, capacity: int = 2048, group_pieces: int = 4096, seed: int = 23) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: every piece lies in one sequence of ``capacity`` ids.

    Pieces are dealt at random into groups of about ``group_pieces``, and each group is packed by itself, longest piece
    first, into the first sequence with room; a group is one task's work however many pieces there are, and all groups
    run side by side. The pieces are written to the shared folder first, so that counting the groups does not cut the
    texts twice and a lost executor deals the same way again.

    A null or empty text is the piece of its final id. Rows that share an id are packed by themselves. Sequence ids are
    unique, not dense. An empty table gives no rows.
    """
    ship(pieces.sparkSession)
    rows = stage(pieces, "pieces")
    groups = max(1, math.ceil(rows.count() / group_pieces))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start", "ids_crc32", "doc_tokens"], ignore_index=True)
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        group["sequence_id"] = group.pop("_group") * (1 << 24) + bins
        return group.assign(offset=offsets)

    dealt = rows.withColumn("_group", F.floor(F.rand(seed) * groups).cast("long"))
    return dealt.groupBy("_group").applyInPandas(run, f"{PIECE}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 2048, **columns: str) -> DataFrame:
    """Cut and pack whole texts: one row for each piece of each row of ``docs``."""
    return pack(token_pieces(docs, capacity, **columns), capacity)
