"""Streaming deduplication of texts with keyed state on disk.

Files of a growing Parquet table arrive as a stream.  The state, held in
RocksDB and in the store's folder and never expired, has one entry for each
digest: the row that came first (its id and locator), the row with the largest
id, and the number of rows.  A locator is a file of the table and the row's
number in it, so texts stay where they are.  The streaming aggregation combines
rows before it shuffles them, so a text that fills a third of the table costs
one row a task.

A run takes in what has arrived since the last one with the same store, then
checks hits: every row whose digest has others is compared, byte for byte, with
the text at the first row's locator.  Rows that differ from it in spite of an
equal digest form groups by their whole text.  Texts of hits are shuffled by
digest; digests with many rows are salted, and there can be only a few of them.

Defined results: null text is empty and equals empty text.  Of equal texts the
row with the largest id stays; null ids are the smallest; of rows that repeat
the id, the one with the largest locator stays.  Each row of the table has its
own row in the result.  Files must not change once they have arrived.  A table
without rows gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, sized, small, table, tasks

#: Bytes of files taken into one micro-batch.
BATCH_BYTES = 64 << 30
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition sets 4 MB of disk aside
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "512",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(files: DataFrame, key: str, text: str, digest) -> DataFrame:
    """(id, place, digest, body) of every row of a file source."""
    body = F.coalesce(F.col(text), F.lit(""))
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return files.select(F.col(key).cast("long").alias("id"), place.alias("place"), digest(body).alias("digest"), body.alias("body"))


def take_in(spark: SparkSession, path: str, store: str, key: str = "doc_id", text: str = "text", digest=sha256, batch_bytes: int = BATCH_BYTES) -> None:
    """Run the stream over all files of ``path`` that the store has not seen."""
    session = spark.newSession()
    for k, v in {**STATE, "spark.sql.shuffle.partitions": str(tasks(spark))}.items():
        session.conf.set(k, v)
    # as a pattern, the path may be one file as well as a folder
    arrivals = session.readStream.schema(session.read.parquet(path).schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(f"{path[:-1]}[{path[-1]}]")
    rows = _rows(arrivals, key, text, digest).withColumn("arrived", F.current_timestamp())
    seen = rows.groupBy("digest").agg(F.min(F.struct("arrived", "id", "place")).alias("first"), F.max(F.struct("id", "place")).alias("last"), F.count(F.lit(1)).alias("n"))
    seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", store).trigger(availableNow=True).start().awaitTermination()


def known(spark: SparkSession, store: str) -> DataFrame:
    """(digest, place, last, n): the state, with the locator of the first row of each digest."""
    return spark.read.format("statestore").load(store).select("key.digest", F.col("value.min.place").alias("place"), F.col("value.max").alias("last"), F.col("value.count").alias("n"))


def checked(contents: DataFrame, state: DataFrame) -> DataFrame:
    """(id, place, digest, last, n, other): rows with their digest's state; ``other`` is the text of a row that differs from the first."""
    spark = contents.sparkSession
    state = table(state, "state")
    rows = state.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = state.where("n > 1")
    # what reads texts needs only 8 bytes of each digest and locator, while those are few; equality decides below
    hits, firsts = many.select(F.xxhash64("digest").alias("short")).distinct(), many.select(F.xxhash64("place").alias("short")).distinct()
    if small(hits, 24):
        marked = contents.withColumn("short", F.xxhash64("digest")).join(F.broadcast(hits.withColumn("hit", F.lit(True))), "short", "left")
        leads = contents.join(F.broadcast(firsts), F.xxhash64(contents["place"]) == firsts["short"], "left_semi")
    else:
        marked, leads = contents.withColumn("hit", F.lit(True)), contents

    # a digest with this share of all rows is hot; at most 4 * tasks of them fit
    parts = tasks(spark)
    hot = many.where(F.col("n") >= max(2.0, rows / (4 * parts))).select("digest", F.lit(parts).alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    marked = marked.join(F.broadcast(hot), "digest", "left").select("id", "place", "digest", F.when(F.col("hit"), F.col("body")).alias("body"), F.pmod(F.xxhash64("place"), salts).alias("salt"))
    leads = many.hint("merge").join(leads.select("place", "digest", F.col("body").alias("whole")), ["digest", "place"], "left").drop("place")
    leads = leads.withColumn("whole", F.coalesce("whole", F.raise_error(F.lit("a file that had arrived was changed or removed"))))
    leads = leads.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), (salts - 1).cast("long")))).drop("salts")
    both = marked.hint("merge").join(leads, ["digest", "salt"], "left")
    differs = F.col("whole").isNotNull() & (F.col("body") != F.col("whole"))
    return both.select("id", "place", "digest", "last", "n", F.when(differs, F.col("body")).alias("other"))


def grouped(rows: DataFrame) -> DataFrame:
    """(id, place, digest, last, n) with the last row and the size of each row's own group."""
    odd = rows.where("other is not null").select("digest").distinct()
    own = rows.join(sized(odd, 64), "digest", "left_semi").groupBy("digest", "other").agg(F.max(F.struct("id", "place")).alias("own_last"), F.count(F.lit(1)).alias("own_n"))
    own = sized(own.select(F.col("digest").alias("of"), F.col("other").alias("text"), "own_last", "own_n"), 256, F.octet_length("text"))
    joined = rows.join(own, (F.col("digest") == F.col("of")) & F.col("other").eqNullSafe(F.col("text")), "left")
    last = F.coalesce("own_last", "last", F.struct("id", "place"))
    return joined.select("id", "place", "digest", last.alias("last"), F.coalesce("own_n", "n", F.lit(1)).cast("long").alias("n"))


def deduplicate(spark: SparkSession, path: str, store: str | None = None, key: str = "doc_id", text: str = "text", digest=sha256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id, place, digest, keep_id, group_size, kept) of every row of the Parquet table at ``path``.

    ``store`` is the folder of the state, in a file system that executors share;
    a later run with it reads new files only to take them in.  ``digest`` maps a
    text column to a binary one, the same for all runs of a store.
    """
    store = store or new_folder(spark, "digests")
    take_in(spark, path, store, key, text, digest, batch_bytes)
    rows = table(checked(_rows(spark.read.parquet(path), key, text, digest), known(spark, store)), "checked")
    kept = F.struct("id", "place").eqNullSafe(F.col("last"))
    return grouped(rows).select("id", "place", "digest", F.col("last.id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"))
