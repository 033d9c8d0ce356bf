"""Benchmark passages in documents: a prefix-filtered join of item windows, in DataFrame operations only.

An item's windows are its runs of ``size`` words; a shorter item is one window.
A window can only occur in a document that holds all its words, so it is enough
to join on one, and the rarest in the corpus (by the count of all documents'
words) is taken.  An occurrence of that word fixes where the window would start;
starts outside the document are dropped, and the rest are compared word by word
with the document at that place.

Documents are normalised once to words with single blanks and written to the
shared folder; no join moves their texts unless the places to compare outgrow a
broadcast of measured size.

Defined results: null and empty texts, and texts of separators only, have no
words and no hits; such items have no windows.  An item without an id still marks
words, but is not counted among the items.  Repeated documents each get their
row, repeated items count once.  An empty benchmark hits nothing.  Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, table

SIZE = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal(text: Column) -> Column:
    """The words, A-Z lower-cased, with single blanks between them."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, SEPARATORS, " "))


def words(norm: str) -> Column:
    return F.when(F.col(norm) == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def windows(items: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(wid, item_id, n, window): the distinct windows of every item."""
    rows = items.select(F.col(key).cast("string").alias("item_id"), normal(F.col(text)).alias("norm")).where("norm <> ''").select("item_id", words("norm").alias("w"))
    rows = rows.withColumn("n", F.least(F.size("w"), F.lit(size)))
    rows = rows.select("item_id", "n", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("i"))
    return rows.select("item_id", "n", F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("window")).distinct().withColumn("wid", F.md5("window"))


def occurrences(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(rid, hits): where windows occur in each document, as structs of start, n and wid.

    ``docs`` has rid, norm and n_words; ``found`` has wid, n and window.
    """
    distinct = table(found.select("wid", "n", "window").distinct(), "windows")
    parts = distinct.select("wid", F.posexplode(F.split("window", " ")).alias("at", "word"))
    vocabulary = sized(parts.select("word").distinct(), 32, F.length("word"))
    counts = docs.where("norm <> ''").select(F.explode(F.split("norm", " ")).alias("word")).join(vocabulary, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("times"))
    counts = table(counts, "counts")
    rarest = parts.join(counts, "word", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "word", "at")).alias("r")).where("r.times > 0")
    anchors = table(rarest.join(distinct, "wid").select(F.col("r.word").alias("word"), F.col("r.at").alias("at"), "wid", "n", "window"), "anchors")
    places = docs.where("norm <> ''").select("rid", "n_words", F.posexplode(F.split("norm", " ")).alias("pos", "word"))
    places = places.join(sized(anchors, 96, F.length("window")), "word").withColumn("start", F.col("pos") - F.col("at")).where("start >= 0 and start + n <= n_words")
    starts = places.select("rid", "start", "n", "wid")
    listed = table(starts.groupBy("rid").agg(F.collect_list(F.struct("start", "n", "wid")).alias("starts"), F.count(F.lit(1)).alias("k")), "starts")
    rows = docs.select("rid", "norm").join(sized(listed, 64, F.col("k") * 72), "rid")
    rows = rows.select("rid", F.split("norm", " ").alias("w"), "starts")
    same = F.filter("starts", lambda s: F.md5(F.array_join(F.slice(F.col("w"), s["start"] + 1, s["n"]), " ")) == s["wid"])
    return rows.select("rid", same.alias("hits")).where(F.size("hits") > 0)


def _marked(docs: DataFrame, items: DataFrame, size: int, text: str, item_key: str, item_text: str, *kept: Column) -> tuple[DataFrame, DataFrame]:
    """(rid, n_words and ``kept`` of every row; what was found, by rid)."""
    written = docs.select(F.monotonically_increasing_id().alias("rid"), normal(F.col(text)).alias("norm"), *kept)
    written = table(written.withColumn("n_words", F.size(words("norm")).cast("long")), "normal")
    found = windows(items, size, item_key, item_text)
    hits = table(occurrences(written, found), "hits")
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1)))))
    n_hit = hits.select("rid", covered.cast("long").alias("n_hit"))
    owners = found.where("item_id is not null").select("wid", "item_id")
    pairs = hits.select("rid", F.explode(F.array_distinct(F.transform("hits", lambda h: h["wid"]))).alias("wid")).join(owners, "wid").select("rid", "item_id").distinct()
    listed = F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ","), 256)
    by_item = pairs.groupBy("rid").agg(F.count(F.lit(1)).alias("n_items"), listed.alias("items_sha256"))
    return written.drop("norm"), sized(table(n_hit.join(by_item, "rid", "left"), "result"), 112)


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document: its words, hit words and items."""
    rows, result = _marked(docs, items, size, text, item_key, item_text, F.col(key).alias("doc_id"))
    none = F.lit(0).cast("long")
    return rows.join(result, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, size: int = SIZE, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no window."""
    rows, result = _marked(docs, items, size, text, item_key, item_text, F.struct(*docs.columns).alias("kept"))
    return rows.join(result, "rid", "left_anti").select("kept.*")
