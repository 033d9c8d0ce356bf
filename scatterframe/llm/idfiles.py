"""Token ids in files of canonical length-limited Huffman codes.

Codes come from the counts of all ids, so one table serves all files; only code
lengths are stored.  A file row holds a block of whole documents in ascending
order: their ids and lengths, the packed codes, and the bit offset of every
``STRIDE``-th code.  A reader decodes all stretches of a block in step, by one
table lookup a code, and can start at any stretch.

Defined results: a null or empty text is its end mark alone.  Null document ids
sort first; equal ids are ordered by text, and repeated rows all stay.  An empty
table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import new_folder, sized, table, tasks
from .tokens import encoder_of

END_ID = 2
STRIDE = 256
#: Ids in a block, about; a block holds whole documents.
BLOCK_IDS = 1 << 18

_RAW = "part int, block int, base long, doc_ids array<long>, lengths array<long>, ids binary"
BLOCK = "part int, block int, base long, doc_ids array<long>, lengths array<long>, stretches array<long>, codes binary"


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths up to ``limit`` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    leaves = np.sort(counts[used].astype(np.float64))
    order = used[np.argsort(counts[used], kind="stable")]
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((leaves, pairs))
        by = np.argsort(both, kind="stable")
        level = both[by]
        is_leaf.append(by < n)
    take = 2 * n - 2
    for flags in reversed(is_leaf):
        here = int(flags[:take].sum())
        out[order[:here]] += 1
        take = 2 * (take - here)
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    for s in sorted(np.flatnonzero(lengths).tolist(), key=lambda s: (lengths[s], s)):
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Packed codes, and the bit offset of every ``STRIDE``-th."""
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    at = end - n
    total = int(end[-1]) if len(end) else 0
    word, bit = at >> 5, at & 31
    wide = codes[ids].astype(np.uint64) << (64 - bit - n).astype(np.uint64)
    size = (total >> 5) + 2
    words = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), size)
    words += np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    return words.astype(np.uint32).astype(">u4").tobytes(), at[::STRIDE]


def decode_table(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbol, length) of the code that a window of so many bits begins with."""
    width = int(lengths.max()) if len(lengths) else 0
    symbols, sizes = np.zeros(1 << width, np.uint32), np.zeros(1 << width, np.uint8)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    runs = 1 << (width - lengths[order].astype(np.int64))
    fill = int(runs.sum())
    symbols[:fill], sizes[:fill] = np.repeat(order, runs), np.repeat(lengths[order], runs)
    return symbols, sizes, width


def decode(codes: bytes, stretches: np.ndarray, n: int, lookup: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    symbols, sizes, width = lookup
    words = np.frombuffer(codes, ">u4").astype(np.uint64)
    out = np.zeros((STRIDE, len(stretches)), np.uint32)
    at = stretches.astype(np.int64).copy()
    last = len(words) - 2
    for k in range(STRIDE):
        word = np.minimum(at >> 5, last)
        window = (words[word] << np.uint64(32) | words[word + 1]) >> (64 - width - (at & 31)).astype(np.uint64)
        window &= np.uint64((1 << width) - 1)
        out[k] = symbols[window]
        at += sizes[window]
    return out.T.reshape(-1)[:n]


def tokenize(docs: DataFrame, vocabulary: str, end_id: int, key: str, text: str) -> DataFrame:
    """Blocks of whole documents in ascending order of ``key``: parts follow each other, and blocks in a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, block, base = encoder_of(vocabulary), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], encoder.dtype).tobytes()
        keys, sizes, data, held = [], [], [], 0

        def emit() -> pa.RecordBatch:
            return pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([base], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(data)], pa.binary())],
                ["part", "block", "base", "doc_ids", "lengths", "ids"])

        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                packed = encoder.packed(t.as_py()) + end
                n = len(packed) // encoder.dtype.itemsize
                keys.append(k.as_py())
                sizes.append(n)
                data.append(packed)
                held += n
                if held >= BLOCK_IDS:
                    yield emit()
                    block, base = block + 1, base + held
                    keys, sizes, data, held = [], [], [], 0
        if keys:
            yield emit()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(tasks(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, _RAW)


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> None:
    """Files under ``path``: ``blocks``, and the code lengths in ``lengths``."""
    spark, dtype = docs.sparkSession, encoder_of(vocabulary).dtype
    raw = table(tokenize(docs, vocabulary, end_id, key, text), "ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column(0):
                more = np.bincount(np.frombuffer(data.as_buffer(), dtype))
                short, sums = sorted((sums, more.astype(np.int64)), key=len)
                sums[: len(short)] += short
        used = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(sums[used], pa.int64())], ["id", "n"])

    found = raw.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # a row per id of the vocabulary
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 0, np.int64)
    counts[found["id"]] = found["n"]
    lengths = code_lengths(counts, max(18, len(found).bit_length() + 1))
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").write.parquet(f"{path}/lengths")
    codes = canonical_codes(lengths)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = np.frombuffer(row.column(5)[0].as_buffer(), dtype)
                data, stretches = encode(ids, lengths, codes)
                yield pa.record_batch([*row.columns[:5], pa.array([stretches], pa.list_(pa.int64())), pa.array([data], pa.binary())], [c.split()[0] for c in BLOCK.split(", ")])

    raw.mapInArrow(pack, BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/lengths").first()[0], np.uint8)
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = decode_table(lengths, canonical_codes(lengths))
        for batch in batches:
            for i in range(batch.num_rows):
                part, _, base, keys, sizes, stretches, codes = (c[i] for c in batch.columns)
                sizes = np.array(sizes.as_py(), np.int64)
                data = decode(codes.as_py(), np.array(stretches.as_py(), np.int64), int(sizes.sum()), lookup).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                sums = [zlib.crc32(data[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())]
                yield pa.record_batch(
                    [pa.array([part.as_py()] * len(sums), pa.int32()), keys.values.cast(pa.int64()), pa.array(base.as_py() + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                    ["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    sizes = blocks.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sized(table(sizes.select("part", before.alias("first")), "parts"), 16)  # a row per part, of which there are as many as tasks
    rows = blocks.mapInArrow(unpack, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(firsts, "part").select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
