"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Fingerprints of windows that are similar enough differ in about 10 bits of 64, give or take 3;
#: more than this happens once in several hundred thousand times at the very threshold.
RADIUS = 23
BLOCKS, BLOCK_BITS = 8, 8
#: Benchmarks of so many items and words at most are sent to all tasks; for larger ones, places of words in documents are
#: shuffled to them, and the texts of documents with a place in common are fetched afterwards.
BROADCAST_ITEMS = 2_000
BROADCAST_WORDS = 500_000
WHITE = " \t\n\x0b\f\r"

#: What to flip in a block so that all values within its share of the radius are met.
FLIPS = [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= RADIUS // BLOCKS]


def _words(text: Column) -> Column:
    """Lower-cased words between ASCII white space; one empty word if there are none."""
    return F.split(F.lower(F.trim(text, F.lit(WHITE))), r"[ \t-\r]+")


def _shingles(words: str, width: str) -> str:
    return f"transform(sequence(1, size({words}) - {width} + 1), i -> array_join(slice({words}, i, {width}), ' '))"


def _fingerprint(shingles: str) -> str:
    """SimHash of an array of shingles: each counts as often as it is there."""
    hashes = f"transform({shingles}, s -> xxhash64(s))"
    ones = "size(filter(hs, h -> shiftrightunsigned(h, b) & 1L = 1L))"
    bit = f"if(2 * {ones} > size(hs), shiftleft(1L, b), 0L)"
    return f"transform(array({hashes}), hs -> aggregate(sequence(0, 63), 0L, (all, b) -> all | {bit}))[0]"


def _blocks(print_: str, size: str) -> Column:
    block = lambda b: f"shiftleft(cast({size} as long), 16) | {b * 256}L | (shiftrightunsigned({print_}, {b * BLOCK_BITS}) & 255L)"
    return F.expr(f"array({', '.join(block(b) for b in range(BLOCKS))})")


def _maybe_broadcast(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _places(words: DataFrame, width: int, keys: DataFrame, small: bool) -> DataFrame:
    """(doc_id, words, at, size): where in ``words`` (doc_id, words) a shingle of ``width`` words begins whose hash is in
    ``keys`` (key, size). If the keys are small they are sent to the words; else hashes of places go to the keys, and
    words, which travel once a document, to what is met there."""
    key = F.xxhash64(F.concat_ws(" ", *(F.expr(f"get(words, at + {i})") for i in range(width)))).alias("key")
    fits = words.select("doc_id", "words", F.posexplode("words").alias("at", "word")).where(f"at + {width} <= size(words)")
    if small:
        return fits.select("doc_id", "words", "at", key).join(F.broadcast(keys), "key").drop("key")
    # rows of one id and text have the same places, so the text's hash names the row
    text = F.xxhash64("words").alias("text")
    met = fits.select("doc_id", text, "at", key).join(keys, "key").select("doc_id", "text", "at", "size").distinct()
    named = words.select(F.col("doc_id").alias("_id"), text.alias("_text"), "words").dropDuplicates(["_id", "_text"])
    return met.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text") == F.col("_text"))).select("doc_id", "words", "at", "size")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents of ``docs`` (doc_id, text, ...) that have a window like an item of ``benchmark``
    (item_id, text, ...).

    Returns (doc_id, item_id, similarity, first_word), a row per pair: the greatest weighted Jaccard
    similarity of five-word shingles, 0.8 or more, of the item and a window of as many words, and the
    least start, in words from 0, of the windows read that are so similar. Items of fewer than five
    words are one shingle;
    a document of fewer words than an item is one window. Null and blank texts have no words and
    match nothing. Rows that repeat an id are taken as one document or item; null ids are an id.
    Empty tables give no rows; other columns are ignored.

    Windows are read where they begin with a shingle of some item of their size, and at a document's
    last place if an item's shingle is there. The best match is among them: a window that begins
    otherwise can move on by a word and loses nothing it shares. Each distinct window is
    fingerprinted and meets items of its size in some block that differs in RADIUS / BLOCKS bits at
    most, which all fingerprints within RADIUS do; those are then compared shingle by shingle.
    """
    item_words = (
        benchmark.select("item_id", _words(text_or_empty()).alias("item"))
        .where("item[0] <> ''")
        .select("item_id", "item", F.size("item").alias("size"), F.least(F.lit(SHINGLE_WORDS), F.size("item")).alias("width"))
        .distinct()
    )
    items = cut(
        item_words.withColumn("item_shingles", F.expr(_shingles("item", "width"))).withColumn(
            "item_print", F.expr(_fingerprint("item_shingles"))
        )
        .withColumn("item_key", F.xxhash64("item_id", "item"))
    )
    state = items.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    few, small = state.n <= BROADCAST_ITEMS, state.words <= BROADCAST_WORDS
    places = items.select("size", "width", F.explode(F.expr("transform(item_shingles, s -> xxhash64(s))")).alias("key")).distinct()

    words = docs.select("doc_id", _words(text_or_empty()).alias("words")).where("words[0] <> ''")
    windows = None
    for width in sorted(r.width for r in items.select("width").distinct().collect()):
        met = _places(words, width, places.where(F.col("width") == width).select("key", "size"), small)
        met = met.withColumn("start", F.expr("greatest(0, least(at, size(words) - size))")).select(
            "doc_id", "start", "size", F.lit(width).alias("width"), F.expr("slice(words, start + 1, size)").alias("window")
        )
        windows = met if windows is None else windows.unionByName(met)
    if windows is None:
        return docs.join(benchmark.select("item_id"), F.lit(False)).select("doc_id", "item_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("first_word"))
    # windows are known by two hashes, so that no arrays of words are compared or joined
    own = ["size", "width", "hash", "hash2"]
    hashed = windows.withColumns({"hash": F.xxhash64("window"), "hash2": F.xxhash64(F.lit("second"), "window")})
    found = cut(hashed.groupBy("doc_id", *own).agg(F.min("start").alias("start"), F.first("window").alias("window")))

    distinct = (
        found.groupBy(*own)
        .agg(F.first("window").alias("window"))
        .withColumn("shingles", F.expr(_shingles("window", "width")))
        .withColumn("print", F.expr(_fingerprint("shingles")))
        .drop("window")
    )
    probes = distinct.withColumn("block", F.explode(_blocks("print", "size")))
    flipped = F.transform(F.array(*map(F.lit, FLIPS)), lambda f: F.col("own").bitwiseXOR(f.cast("long")))
    index = items.withColumn("own", F.explode(_blocks("item_print", "size"))).select(
        F.explode(flipped).alias("item_block"), "item_key", "item_print"
    )
    within = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS
    near = (
        probes.join(_maybe_broadcast(index, few), (F.col("block") == F.col("item_block")) & within)
        .dropDuplicates([*own, "item_key"])
        .select(*own, "shingles", "item_key")
        .join(_maybe_broadcast(items.select("item_key", "item_id", "item_shingles"), small), "item_key")
    )
    common = (
        "aggregate(array_distinct(item_shingles), 0, (n, s) ->"
        " n + least(size(filter(item_shingles, x -> x = s)), size(filter(shingles, x -> x = s))))"
    )
    alike = (
        near.withColumn("common", F.expr(common))
        .withColumn("similarity", F.expr("common / (size(shingles) + size(item_shingles) - common)"))
        .where(F.col("similarity") >= SIMILARITY)
        .select(*own, "item_id", "similarity")
    )
    return (
        found.drop("window").join(alike, own)
        .groupBy("doc_id", "item_id")
        .agg(F.max("similarity").alias("similarity"), F.min("start").alias("first_word"))
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, without the documents that have a window like a benchmark item.

    Rows whose id is null stay, as no decision can name them.
    """
    found = leaks(docs.where("doc_id is not null"), benchmark).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti")
