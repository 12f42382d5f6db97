"""SimHash near-duplicate detection over a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, text_or_empty
from loamgraph.operators.components import connected_components

SHINGLE_WORDS = 3
RADIUS = 3
N_BYTES = 8
SEED = 42
#: Shingles hashed at a time, so that a text of any length takes bounded memory.
BLOCK = 1 << 16

#: The index is keyed by the values at three byte positions out of one half of the fingerprint.
#: At most RADIUS of the eight bytes differ in a link, so five agree, so three agree in one half.
POSITIONS = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]


def shingle_hashes(text: str | None, width: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The 64-bit hashes of a text's word shingles in their order, repeats included, BLOCK at a time.

    Null and blank texts have none; a text of fewer than ``width`` words has one shingle, its
    whole word sequence.
    """
    words = (text or "").encode().lower().split()  # for bytes both mean ASCII only
    if not words:
        return
    size = min(width, len(words))
    data = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words])
    starts = (stops - [len(w) + 1 for w in words])[: len(words) - size + 1].tolist()
    ends = (stops - 1)[size - 1 :].tolist()
    for at in range(0, len(starts), BLOCK):
        spans = zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)
        yield np.array([xxhash.xxh64_intdigest(data[i:j], SEED) for i, j in spans], "<u8")


def simhash(blocks: Iterable[np.ndarray]) -> int:
    """The 64-bit SimHash of hashes that come in blocks; zero of none."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; zero for null and blank texts."""
    return simhash(shingle_hashes(text, width))


@F.pandas_udf(T.LongType())
def _fingerprints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame, name: str = "simhash") -> DataFrame:
    """``docs`` (text, ...) with the SimHash of each text, as a signed long."""
    return docs.withColumn(name, _fingerprints(text_or_empty()))


def _byte(value: Column, i: int) -> Column:
    return F.shiftrightunsigned(value, 8 * i).bitwiseAND(F.lit(255))


def _postings(prints: DataFrame, name: str) -> DataFrame:
    value = F.col("simhash")
    keys = [
        reduce(lambda key, i: key * 256 + _byte(value, i), at, F.lit(n).cast("long")) for n, at in enumerate(POSITIONS)
    ]
    return prints.select(value.alias(name), F.explode(F.array(*keys)).alias("key"))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most ``radius`` <= 3 bits.

    Postings of the positional index are joined by key; for each pair that meets there, the
    agreeing bytes are tallied, pairs below the guaranteed minimum go, and the rest is verified
    by Hamming distance. All of that is part of the join's condition: only links leave it.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius must be in 0..{RADIUS}")
    found = F.col("a"), F.col("b")
    shared = sum(((_byte(found[0], i) == _byte(found[1], i)).cast("int") for i in range(N_BYTES)), F.lit(0))
    left, right = _postings(prints, "a"), _postings(prints, "b").withColumnRenamed("key", "key_b")
    met = left.join(
        right,
        (F.col("key") == F.col("key_b"))
        & (found[0] < found[1])
        & (shared >= N_BYTES - radius)
        & (F.bit_count(found[0].bitwiseXOR(found[1])) <= radius),
    )
    return met.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text, ...).

    Equal fingerprints are one class; classes link within ``radius`` bits, transitively.
    component_id is the smallest doc_id of all rows reachable (null ids are passed over; a
    component of null ids only has a null component_id). Null and blank texts have fingerprint
    zero and are linked like any other. Repeated rows each get their row; an empty table gives
    none; other columns of ``docs`` are ignored.
    """
    rows = cut(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "simhash"))
    classes = rows.groupBy("simhash").agg(F.min("doc_id").alias("first_id"))
    parts = connected_components(links(classes, radius), "a", "b")
    placed = classes.join(parts.withColumnRenamed("node", "simhash"), "simhash", "left").withColumn(
        "component", F.coalesce("component", "simhash")
    )
    heads = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = placed.join(heads, "component").select("simhash", "component_id")
    return rows.join(ids, "simhash").select(
        "doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs``, all columns, with one row of each component kept: that with the smallest doc_id, of several by the hash
    of the row; rows without an id count as the last. Of rows that are the same in all columns one stays."""
    own = "__near"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    print_, group, place, least = (f"{own}_{n}" for n in ("print", "group", "place", "least"))
    rows = with_fingerprint(docs, print_)
    classes = cut(rows.select(F.col(print_).alias("simhash")).distinct())
    parts = connected_components(links(classes, radius), "a", "b").toDF(print_, group)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("hash"))
    keyed = rows.join(parts, print_, "left").withColumns({group: F.coalesce(group, print_), place: order})
    first = keyed.groupBy(group).agg(F.min(place).alias(least))
    kept = keyed.join(first, (keyed[group] == first[group]) & keyed[place].eqNullSafe(first[least]), "left_semi")
    return kept.select(*(f"`{c}`" for c in docs.columns)).dropDuplicates()
