"""Stupid-backoff scores of documents under the n-grams of all other documents."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, freeing_shuffles, text_or_empty

ORDER = 3
#: The factor for each step back to a lower order.
ALPHA = 0.4
#: Contexts are dealt with in so many rounds by hash, one after the other, so that the rows of one round only are on disk.
ROUNDS = 4
#: An n-gram is hot if it is more than this share of a partition's mean number of tokens. There are partitions / HOT_SHARE
#: hot ones of a length at most; their counts are sent to all tasks.
HOT_SHARE = 0.25
#: Bytes of documents that a task turns into rows at a time, bytes that it hashes at a time, and rows that it counts at a time.
CHUNK_BYTES, LARGEST, CHUNK_ROWS = 1 << 20, 1 << 22, 1 << 19
#: Sums of documents travel in blocks of 256 rows.
BLOCK_BITS = 8
#: In place of the word before a document's first one, and behind its last one; words have greater numbers.
START, END = 0, 1
#: Flags of a row: what it is for, whether it adds to counts and is scored itself, and which end it touches. The length of
#: its context is above them.
HIGH, LOW, COUNTS, SCORES, FIRST, LAST, LENGTH = 1, 2, 4, 8, 16, 32, 6

#: An n-gram a X b of a document: what its counts are grouped by, the document, how often it is there, and of a X b, a X, X b
#: and X the count in other documents where it is known beforehand, else -1 - the count in this one.
GRAMS = "key long, first long, second long, row long, flags long, n long, whole long, left long, right long, core long"
VALUES = ["tokens", "logs", "known", "unseen"]
BLOCKS = "block long, row array<long>, tokens array<double>, logs array<double>, known array<double>, unseen array<double>"
SUMS = "row long, tokens long, logs double, known long, unseen long"
Hot = dict[int, tuple[np.ndarray, np.ndarray]]


def _mixed(*parts) -> np.ndarray:
    """A 64-bit hash of numbers in order."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ p) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(32))
    return h


#: A number for each byte, the same for A-Z and a-z, and powers of an odd number and of its inverse modulo 2^64.
_BYTES = _mixed(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64))
_WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))
_BASE = 0xD1342543DE82EF95


@cache
def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, bytes ``data`` cut at ``offsets``, and the text of each; words are what ASCII
    white space separates, A-Z lower-cased.

    A word's hash is the sum of numbers for its bytes, times powers of a base by their places: a difference of running sums.
    """
    size = len(data)
    inside = ~_WHITE[data]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    follows = np.concatenate([[False], inside[:-1]]) & ~edge[:size]
    starts = np.flatnonzero(inside & ~follows)
    goes_on = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    ends = np.flatnonzero(inside & ~goes_on) + 1
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _powers(_BASE, max(LARGEST, size))[:size])])
        hashes = _mixed((sums[ends] - sums[starts]) * _powers(pow(_BASE, -1, 1 << 64), max(LARGEST, size))[starts], (ends - starts).astype(np.uint64))
    return np.maximum(hashes, np.uint64(2)), np.searchsorted(offsets, starts, "right") - 1


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Some documents at a time: words after each other, their documents' places in the chunk, and the documents' rows."""
    for batch in batches:
        rows, texts = batch["row"].to_numpy(), batch["text"].cast(pa.large_binary())
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < len(batch):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + CHUNK_BYTES, "right")))
            own = texts.slice(at, stop - at)
            offsets = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + stop - at + 1]
            data = np.frombuffer(own.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            yield *_hashed(data, offsets - offsets[0]), rows[at:stop]
            at = stop


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same as ``word_hashes`` for texts of any length, which are cut into pieces at white space."""
    if len(data) <= LARGEST:
        return word_hashes(data, offsets)
    parts, at = [], 0
    while at < len(data):
        stop = min(len(data), at + LARGEST)
        white = np.flatnonzero(_WHITE[data[at:stop]])
        if stop < len(data):  # a word that is longer than a piece makes it longer
            stop = at + int(white[-1]) + 1 if len(white) else stop + int(np.argmax(np.append(_WHITE[data[stop:]], True)))
        inner = offsets[(offsets > at) & (offsets < stop)] - at
        words, text = word_hashes(data[at:stop], np.concatenate([[0], inner, [stop - at]]))
        parts.append((words, text + np.searchsorted(offsets, at, "right") - 1))
        at = stop
    return np.concatenate([w for w, _ in parts]), np.concatenate([d for _, d in parts])


def _ngrams(words: np.ndarray, doc: np.ndarray, most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Hashes of the n-grams that begin at each word, and whether they end in the same document."""
    out = {1: (words, np.ones(len(words), bool))}
    for k in range(2, most + 1):
        n = max(0, len(words) - k + 1)
        out[k] = (_mixed(out[k - 1][0][:n], words[k - 1 :]), doc[:n] == doc[k - 1 :])
    return out


def _grouped(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which equal hashes are together, which place begins a group, and each place's group."""
    order = np.argsort(hashes)
    new = np.ones(len(order), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    return order, new, np.cumsum(new) - 1


def _in(table: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of ``keys`` in a table of sorted hashes and counts, and whether they are there."""
    if table is None or not len(table[0]):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return table[1][at], table[0][at] == keys


def _counted(docs: DataFrame, length: int, hot: Hot) -> DataFrame:
    """(gram, n): how often n-grams are in all of ``docs`` (row, text), those of two words or more only if both
    n-grams of one word less in them are hot."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, doc, _ in _chunks(batches):
            grams, inside = _ngrams(words, doc, length)[length]
            if length > 1:
                _, known = _in(hot[length - 1], _ngrams(words, doc, length - 1)[length - 1][0])
                grams = grams[inside & known[:-1] & known[1:]] if len(grams) else grams
            grams, n = np.unique(grams, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    return docs.mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def hot_ngrams(docs: DataFrame, order: int) -> tuple[Hot, int]:
    """The n-grams of each length up to ``order`` that would fill a partition, with their counts, and the number of tokens."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot, total = {}, 0
    for k in range(1, order + 1):
        counts = _counted(docs, k, hot)
        if k == 1:
            counts = cut(counts)
            total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        rows = counts.where(F.col("n") > max(1.0, HOT_SHARE * total / partitions)).collect()
        grams = np.array([r.gram for r in rows], np.int64).view(np.uint64)
        at = np.argsort(grams)
        hot[k] = grams[at], np.array([r.n for r in rows], np.int64)[at]
        if not rows:
            break
    return hot, total


def _exploded(docs: DataFrame, hot: Hot, order: int, turn: int, flags: int, own_counts: bool) -> DataFrame:
    """The n-grams of each of ``docs`` (row, text) whose contexts this round has, once per document.

    Rows are keyed by the context X, which brings all counts together that they need. A hot context has its count with it
    and gives a row for what precedes it, which needs a X and a X b, and one for what follows, which needs X b and a X b;
    if those are hot too, they have their counts with them and are keyed by one word more, or are on their own.
    """
    fields = [f.split()[0] for f in GRAMS.split(", ")]

    def rows_of(words: np.ndarray, doc: np.ndarray, rows: np.ndarray, core: int) -> list[dict[str, np.ndarray]]:
        grams = _ngrams(words, doc, core + 2)
        at = np.flatnonzero(grams[core][1] & (grams[core][0] % np.uint64(ROUNDS) == turn))
        if not len(at):
            return []
        x = grams[core][0][at]
        begins = (at == 0) | (doc[at - 1] != doc[at])
        ends = at + core == len(words)
        ends |= doc[np.where(ends, at, at + core)] != doc[at]
        a = np.where(begins, np.uint64(START), words[at - 1])
        b = np.where(ends, np.uint64(END), words[np.where(ends, at, at + core)])
        hashes = {"core": x, "left": _mixed(a, x), "right": _mixed(x, b), "whole": _mixed(a, x, b)}
        n, count, is_hot, own = None, {}, {}, doc[at].astype(np.uint64)
        for name, h in hashes.items():
            order_, new, group = _grouped(_mixed(own, h))
            times = np.empty(len(at), np.int64)
            times[order_] = np.bincount(group)[group]
            mine = times if own_counts else np.zeros(len(at), np.int64)
            if name == "whole":
                n, once = times, order_[new]
            start = at - (name in ("left", "whole"))
            length = core + {"core": 0, "left": 1, "right": 1, "whole": 2}[name]
            whole = ~(begins & (name in ("left", "whole"))) & ~(ends & (name in ("right", "whole")))
            gram = grams[length][0][np.where(whole, start, 0)] if len(grams[length][0]) else np.zeros(len(at), np.uint64)
            others, known = _in(hot.get(length), gram)
            is_hot[name] = known & whole
            count[name] = np.where(is_hot[name], others - mine, -1 - mine)
        table = {"first": a, "second": b, "row": rows[doc[at]], "n": n, **count}
        table["flags"] = flags | np.where(begins, FIRST, 0) | np.where(ends, LAST, 0) | core << LENGTH
        table["key"] = x

        def part(rows_: np.ndarray, role: int, **changed: np.ndarray) -> dict[str, np.ndarray]:
            out = {k: v[rows_] for k, v in (table | changed).items()}
            return out | {"flags": out["flags"] | role}

        row, kept = table["row"].astype(np.uint64), np.zeros(len(at), bool)
        kept[once] = True
        before, after = _mixed(hashes["left"], np.uint64(HIGH)), _mixed(hashes["right"], np.uint64(LOW))
        before = np.where(is_hot["left"], _mixed(before, b), before)
        before = np.where(begins | is_hot["left"] & (ends | is_hot["whole"]), _mixed(before, row), before)
        after = np.where(is_hot["right"], _mixed(after, a), after)
        after = np.where(is_hot["right"] & (begins | is_hot["whole"]), _mixed(after, row), after)
        none = np.zeros(len(at), np.uint64)
        return [
            part(kept & ~is_hot["core"], HIGH | LOW),
            part(kept & is_hot["core"], HIGH, key=before, first=none),
            part(kept & is_hot["core"] & ~ends, LOW, key=after, second=none),
        ]

    def exploded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, doc, rows in _chunks(batches):
            for core in range(1, max(2, order - 1)):
                for part in rows_of(words, doc, rows, core):
                    yield pa.RecordBatch.from_arrays([pa.array(part[f].view(np.int64)) for f in fields], fields)

    return docs.mapInArrow(exploded, GRAMS)


def _scored(order: int, alpha: float):
    """A function from n-grams in order of their keys to sums of log scores per document; a key's rows meet in one part."""

    def scores(t: dict[str, np.ndarray]) -> pa.RecordBatch:
        flags, n, sums = t["flags"], t["n"], {}
        weight = np.where(flags & COUNTS, n, 0)
        for names in (("key",), ("key", "first"), ("key", "first", "second"), ("key", "second")):
            at, _, group = _grouped(_mixed(*(t[c].view(np.uint64) for c in names)))
            sums[names] = np.empty(len(at))
            sums[names][at] = np.bincount(group, weight[at])[group]
        others = lambda c, *names: np.where(t[c] >= 0, t[c], sums[names] + t[c] + 1)
        whole, left = others("whole", "key", "first", "second"), others("left", "key", "first")
        right, core = others("right", "key", "second"), others("core", "key")
        begins, ends, length = (flags & FIRST) > 0, (flags & LAST) > 0, flags >> LENGTH
        high, low = (flags & HIGH) > 0, (flags & LOW) > 0
        longer = ~begins & ~ends & (whole > 0) & (order > 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.where(high & longer & (length == order - 2), np.log(whole) - np.log(left), 0.0)
            step = (order - length - 1) * math.log(alpha) + np.log(right) - np.log(core)
            logs += np.where(low & ~ends & ~longer & (right > 0), step, 0.0)
            alone = high & (length == 1) & (begins | (left <= 0))
            logs += np.where(alone, (order - 1) * math.log(alpha) + np.where(core > 0, np.log(core), 0.0), 0.0)
        scored = (flags & SCORES) > 0
        rows, at = np.unique(t["row"][scored], return_inverse=True)
        tokens = np.where(high & (length == 1), n, 0)
        values = [np.bincount(at, v[scored], len(rows)) for v in (tokens, n * logs, n * (alone & (core > 0)), n * (alone & (core <= 0)))]
        return in_blocks(rows, values)

    def in_blocks(rows: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
        blocks, starts = np.unique(rows >> BLOCK_BITS, return_index=True)
        offsets = pa.array(np.append(starts, len(rows)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (rows, *values)]
        return pa.RecordBatch.from_arrays([pa.array(blocks), *lists], ["block", "row", *VALUES])

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= CHUNK_ROWS:
                t = pa.Table.from_batches(held)
                key = t["key"].to_numpy()
                end = int(np.searchsorted(key, key[-1]))  # the last key goes on, maybe
                if end:
                    yield scores({c: t[c][:end].to_numpy() for c in t.column_names})
                held, size = t.slice(end).to_batches(), len(t) - end
        if size:
            t = pa.Table.from_batches(held)
            yield scores({c: t[c].to_numpy() for c in t.column_names})

    return scored


def _added_up(table: pa.Table) -> pa.Table:
    """The sums of a block's documents over all parts that have some."""
    rows, at = np.unique(pc.list_flatten(table["row"]).to_numpy(), return_inverse=True)
    sums = [np.bincount(at, pc.list_flatten(table[v]).to_numpy(), len(rows)) for v in VALUES]
    return pa.table([rows, *(v if c == "logs" else v.astype(np.int64) for c, v in zip(VALUES, sums, strict=True))], ["row", *VALUES])


def stupid_backoff(docs: DataFrame, counted: DataFrame | None = None, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """Stupid-backoff scores of each row of ``docs`` (doc_id, text, ...) under the n-grams of all its other rows, or of
    ``counted`` (text, ...).

    A word scores count(n-gram) / count(context) by the longest n-gram of ``order`` words at most that ends with it and is
    counted, times ``alpha`` for each word less than could be; without its context it scores count / number of tokens, a
    word that isn't counted 1 / (number of tokens + 1). A document's own n-grams don't count for it, so a text that is there
    twice scores high. Returns doc_id, n_tokens, log_score (the sum of natural logarithms) and score, the mean per token,
    null for null and blank texts. Every row gets its row: repeated rows are documents of their own, null ids stay; no rows
    give none; other columns are ignored. The rows are read several times and must come in the same order each time, as
    those of a table do.

    N-grams, once per document, are hash-partitioned by their inner words, the context. All counts that a X b takes part in
    meet there: of a X b and a X, which score b by the whole n-gram; of X b and X, which score it by one word less; of X,
    which, if it is one word that a doesn't precede elsewhere, scores X alone. So no n-gram travels to look up a lower order:
    a longer n-gram that is counted implies the shorter ones, and each step scores just those that no longer one does.
    """
    spark, partitions = docs.sparkSession, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    texts = docs.select("row", "text")
    source = texts if counted is None else counted.select(F.lit(-1).cast("long").alias("row"), text_or_empty().alias("text"))
    sums = []
    with freeing_shuffles(spark):
        hot, total = hot_ngrams(source, order)
        for turn in range(ROUNDS):
            if counted is None:
                rows = _exploded(texts, hot, order, turn, COUNTS | SCORES, True)
            else:
                rows = _exploded(texts, hot, order, turn, SCORES, False).unionByName(_exploded(source, hot, order, turn, COUNTS, False))
            scored = rows.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(_scored(order, alpha), BLOCKS)
            sums.append(cut(scored.groupBy("block").applyInArrow(_added_up, SUMS)))
    per_row = reduce(DataFrame.unionAll, sums).groupBy("row").agg(*(F.sum(c).alias(c) for c in VALUES))
    others = F.lit(total) - (F.col("tokens") if counted is None else F.lit(0))
    # the first words of a document have fewer words before them, so fewer steps back
    fewer = F.least("tokens", F.lit(order - 1))
    steps = fewer * order - fewer * (fewer + 1) / 2
    share = F.when(F.col("known") > 0, F.col("known") * F.log(others)).otherwise(0.0) + F.col("unseen") * F.log(others + 1)
    scores = per_row.where("tokens > 0").select("row", "tokens", (F.col("logs") - steps * math.log(alpha) - share).alias("sum"))
    joined = docs.select("row", "doc_id").join(scores, "row", "left")
    return joined.select("doc_id", F.coalesce("tokens", F.lit(0)).alias("n_tokens"), F.coalesce("sum", F.lit(0.0)).alias("log_score"), F.try_divide("sum", "tokens").alias("score"))
