"""Best-fit packing of token sequences in bounded space.

Documents become pieces of at most ``room`` ids; only longer documents are cut.
The pieces are dealt to tasks by hash, and each task packs its own in one pass:
a fixed number of open bins stands in a bitset keyed by free space, a piece goes
to the bin with the least room that suffices, and when a new bin is needed and
all are open, the fullest closes.  Only lengths are dealt and packed; ids
stay where they are made.

Defined results: a null or empty text is its end mark alone.  Repeated rows are
packed as often as they stand.  An empty table gives no pieces.  Null ids are
kept.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import table
from .tokens import encoder_of

ROOM = 4096
OPEN_BINS = 256
#: Tokens that one packing task takes, about; few tasks leave few bins part full.
TASK_TOKENS = 1 << 26
END_ID = 1

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """At most ``limit`` open bins, found by free space."""

    def __init__(self, room: int, limit: int):
        self._room, self._limit, self._open, self._next = room, limit, 0, 0
        self._free = 0  # bit f: some open bin has f places left
        self._bins: list[list[int]] = [[] for _ in range(room + 1)]

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of 1 to ``room`` ids."""
        fitting = self._free >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self._open == self._limit:
                self._take((self._free & -self._free).bit_length() - 1)
            free, bin_ = self._room, self._next
            self._next += 1
        if free > length:
            self._bins[free - length].append(bin_)
            self._free |= 1 << (free - length)
            self._open += 1
        return bin_, self._room - free

    def _take(self, free: int) -> int:
        bin_ = self._bins[free].pop()
        if not self._bins[free]:
            self._free &= ~(1 << free)
        self._open -= 1
        return bin_


def pieces(docs: DataFrame, vocabulary: str, room: int = ROOM, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``PIECES``: the parts of every document, with a checksum of each part's ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder_of(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for key_, text_ in zip(batch.column(0), batch.column(1)):
                data = encode.ids(text_.as_py()).astype("<u4").tobytes() + end
                for k, at in enumerate(range(0, len(data), 4 * room)):
                    part = data[at : at + 4 * room]
                    out.append((key_.as_py(), k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def pack(parts: DataFrame, room: int = ROOM, open_bins: int = OPEN_BINS) -> DataFrame:
    """``parts`` with sequence_id and offset.  ``parts`` is read twice."""
    total = parts.agg(F.sum("length")).first()[0] or 0

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, base = OpenBins(room, open_bins), TaskContext.get().partitionId() << 40
        for b in batches:
            put = [bins.put(n) for n in b["length"].tolist()]
            yield b[["doc_id", "piece", "start", "length", "ids_crc32"]].astype({"doc_id": "Int64"}).assign(
                sequence_id=np.array([base + s for s, _ in put], np.int64), offset=np.array([o for _, o in put], np.int64))

    dealt = parts.withColumn("_h", F.xxhash64("doc_id", "piece", "ids_crc32"))
    dealt = dealt.repartition(1 + total // TASK_TOKENS, "_h").sortWithinPartitions("_h", "doc_id", "piece", "start")
    return dealt.mapInPandas(fill, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, room: int = ROOM, end_id: int = END_ID, open_bins: int = OPEN_BINS, key: str = "doc_id", text: str = "text") -> DataFrame:
    return pack(table(pieces(docs, vocabulary, room, end_id, key, text), "pieces"), room, open_bins)
