"""Document fingerprints by locally consistent parsing with deterministic coin tossing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty

#: Names that a fingerprint keeps: the least ones, as 32-bit numbers in hexadecimal.
SKETCH = 64
#: Phrases count from this level on; a level's phrases have about three of the level below.
LEAST_LEVEL = 2
#: Coin tosses leave labels below this many values, whatever the names they start from.
TOSSES = 3
#: Characters of texts that are parsed together, about.
TOGETHER = 1 << 16
WEIGHTS = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _toss(labels: np.ndarray) -> np.ndarray:
    """Each label becomes the lowest bit in which it differs from its left neighbour, and that bit.

    Neighbours differ before, so they differ after; b-bit labels become labels below 2 * b.
    """
    left, right = labels[:-1], labels[1:]
    differ = left ^ right
    lowest = np.bitwise_count((differ & -differ) - labels.dtype.type(1))
    bit = (right >> lowest.astype(labels.dtype)) & labels.dtype.type(1)
    return (lowest * np.uint8(2) + bit.astype(np.uint8)).astype(np.uint8)


def borders(names: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which names begin a phrase, for texts of ``sizes`` names laid end to end; no two neighbours of a
    text are equal.

    A text's first name does; else it does where the tossed label is a local minimum, which a bounded
    number of neighbours decides: equal stretches get equal borders but near their ends.
    """
    stops = np.cumsum(sizes)
    out = np.zeros(len(names), bool)
    if len(names) >= TOSSES + 3:
        labels = names
        for _ in range(TOSSES):
            labels = _toss(labels)
        out[TOSSES + 1 : -1] = (labels[1:-1] < labels[:-2]) & (labels[1:-1] < labels[2:])
    # labels near the ends of a text have to do with the next one
    for k in range(TOSSES + 1):
        out[(stops - sizes + k)[sizes > k]] = False
    out[stops - 1] = False
    out[stops - sizes] = True
    return out


def _named(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A name for each stretch, from its values and their places in it."""
    sizes = np.diff(np.append(starts, len(values)))
    place = np.arange(len(values)) - np.repeat(starts, sizes)
    return _mixed(np.add.reduceat(values * WEIGHTS[place & 255], starts) + sizes.astype(np.uint64))


def next_level(names: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of the next level, and how many each text has.

    Runs of one name are taken together with their length before the parse.
    """
    starts = np.cumsum(sizes) - sizes
    change = np.append(True, names[1:] != names[:-1])
    change[starts] = True
    first = np.flatnonzero(change)
    runs, sizes = np.diff(np.append(first, len(names))), np.add.reduceat(change.astype(np.int64), starts)
    names = names[first]
    begins = borders(names, sizes)
    values = _mixed(names.astype(np.uint64) + runs.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return _named(values, np.flatnonzero(begins)), np.add.reduceat(begins.astype(np.int64), np.cumsum(sizes) - sizes)


def levels(text: str) -> Iterator[np.ndarray]:
    """Names of the phrases of each level, from the characters up to a single phrase."""
    names = np.frombuffer(text.encode("utf-32-le"), "<u4")
    while len(names) > 1:
        yield names
        names = next_level(names, np.array([len(names)]))[0]
    yield names


def fingerprints(texts: list[str], sketch: int = SKETCH, least_level: int = LEAST_LEVEL) -> list[str]:
    """For each text the least ``sketch`` names of its phrases, from ``least_level`` on and of its whole.

    Equal texts have equal fingerprints; the empty text has an empty one. Texts are parsed together,
    a level at a time, which changes nothing but the speed.
    """
    owner = np.flatnonzero([len(t) for t in texts])
    sizes = np.array([len(texts[i]) for i in owner], np.int64)
    names = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    found, level = [], 0
    while len(owner):
        whole = np.repeat(sizes == 1, sizes)
        kept = np.ones(len(names), bool) if level >= least_level else whole
        hashed = _mixed(names[kept].astype(np.uint64)) >> np.uint64(32)
        found.append(np.repeat(owner, sizes)[kept].astype(np.uint64) << np.uint64(32) | hashed)
        names, owner, sizes = names[~whole], owner[sizes > 1], sizes[sizes > 1]
        if len(owner):
            names, sizes = next_level(names, sizes)
        level += 1
    keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))
    cuts = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32)).tolist()
    low = (keys & np.uint64(0xFFFFFFFF)).astype(">u4")
    return [low[i : min(j, i + sketch)].tobytes().hex() for i, j in zip(cuts, cuts[1:])]


def fingerprint(text: str) -> str:
    return fingerprints([text])[0]


def likeness(a: str, b: str, sketch: int = SKETCH) -> float:
    """Estimated share of phrases in common, 0 to 1, from two fingerprints; two empty ones are alike."""
    if a == b:
        return 1.0
    x, y = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (a, b))
    least = sorted(x | y)[:sketch]
    both = x & y
    return sum(name in both for name in least) / len(least) if both else 0.0


def with_edit(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in ascending order of a range; each is held against the one before it, the next one
    in descending order. A range begins with the row carried over from the range below."""
    names = [f.split()[0] for f in RESULT.split(",")]
    kinds = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    span, before = None, ("", "")

    def rows_of(group: list[tuple]) -> list[tuple]:
        nonlocal before
        edits = [None if carried else with_edit(text, last) for _, carried, text, last in group]
        prints = fingerprints([g[2] for g in group] + [e or "" for e in edits])
        out = []
        for (doc_id, carried, text, _), edit, own, changed in zip(group, edits, prints, prints[len(group) :], strict=False):
            if not carried:
                digest = hashlib.sha256(edit.encode()).hexdigest()
                out.append((doc_id, len(text), digest, own, changed, likeness(own, changed), likeness(own, before[1])))
            before = text, own
        return out

    for batch in batches:
        rows, group, size, last = [], [], 0, before[0]
        for own, carried, doc_id, text in zip(*(batch[c].to_pylist() for c in ("span", "carried", "doc_id", "text")), strict=True):
            if own != span and not carried:
                raise ValueError("a range without a row carried over")
            group.append((doc_id, carried, text, last))
            span, last, size = own, text, size + len(text)
            if size >= TOGETHER:
                rows += rows_of(group)
                group, size = [], 0
        rows += rows_of(group)
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row of ``docs`` (doc_id, text, ...) and of its edited text.

    The next row is that with the next smaller doc_id, after the smallest the largest; the edited
    text is the text with its last third replaced by as much of the next text's beginning. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next, the
    likeness of the fingerprint to that of the edited and of the next text. A null text is empty;
    null ids come last; rows that repeat an id follow each other by descending text. A table of one
    row is next to itself, an empty one gives no rows; other columns are ignored.

    Texts are shuffled once, into ranges of ids; each range also gets the largest row of the range
    below. What comes to the driver are the ranges' bounds, a fixed number per shuffle partition.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = [i / (4 * parts) for i in range(1, 4 * parts)]
    bounds = np.array(sorted(set(rows.agg(F.percentile_approx("doc_id", share, 100 * parts)).first()[0] or [])), np.int64)

    @F.pandas_udf(T.LongType())
    def span_of(ids: pd.Series) -> pd.Series:
        known = ids.to_numpy(np.int64, na_value=np.iinfo(np.int64).min) if ids.hasnans else ids.to_numpy(np.int64)
        return pd.Series(np.searchsorted(bounds, known))

    spans = rows.withColumn("span", span_of("doc_id"))
    tops = sorted(spans.groupBy("span").agg(F.max("doc_id").alias("top")).collect())
    # the largest row of each range goes to the next range, that of the last to the first
    hand = [(top.top, tops[(i + 1) % len(tops)].span) for i, top in enumerate(tops)]
    carried = rows.join(
        F.broadcast(spark.createDataFrame(hand, "top long, span long")), F.col("doc_id").eqNullSafe(F.col("top"))
    ).select("doc_id", "text", "span", F.lit(True).alias("carried"))
    order = [F.col("span"), F.col("carried").desc(), F.col("doc_id").asc_nulls_first(), F.col("text")]
    return (
        spans.withColumn("carried", F.lit(False))
        .unionByName(carried)
        .repartition(parts, "span")
        .sortWithinPartitions(*order)
        .mapInArrow(_walk, RESULT)
    )
