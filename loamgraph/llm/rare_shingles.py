"""Word shingles of documents in the order of how many distinct sets have them, counted over all documents, and the
prefixes of sets under that order: what an exact similarity join has to look at."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remove_folder, shared_folder
from .simhash_dedup import SEED, shingle_hashes, simhash

#: Shingles that a task holds before it deals them out, and those that are counted at a time, about.
FLUSH, BUCKET = 1 << 21, 1 << 21
#: Documents whose sets are needed are marked among so many bits, sent to all tasks; most others are passed over unhashed.
MARKS = 1 << 24
#: Bits of a set's parity.
PARITY = 1024
DEALT = "bucket int, tokens binary, classes binary, counts binary, ids array<long>, sizes binary, folded binary, prints binary"
COUNTED = "class long, tokens array<long>, of array<int>, doc_id long, n int, folded int, simhash long"


def distinct(blocks: Iterable[np.ndarray]) -> np.ndarray:
    """Hashes that come in blocks, each once, sorted."""
    found = np.zeros(0, np.int64)
    for hashes in blocks:
        found = np.union1d(found, hashes.view(np.int64))
    return found


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles, sorted. Null and blank texts have none; a text of fewer than
    ``width`` words has one shingle, its whole word sequence."""
    return distinct(shingle_hashes(text, width))


def class_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def lists(parts: list[np.ndarray], kind=np.int64) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, kind), *parts])))


def needed(n: int, percent: int) -> int:
    """Shingles that a set of n has in common, at least, with any one that is similar enough."""
    return -(-percent * n // 100)


@dataclass(frozen=True)
class Index:
    """rows: (doc_id, class, n, simhash) per document, where class stands for a set of n shingles. posts: (class, n, m, at,
    token) for the places of each set's prefix; of its n shingles other sets have m at most, and only those have places,
    counted from the rarest. Sets that have something similar share a token of their prefixes."""

    rows: DataFrame
    posts: DataFrame


def _dealt(docs: DataFrame, width: int, bits: int, prints: bool) -> DataFrame:
    """Shingles by bucket, the first ``bits`` bits of their hash, packed: the next four bytes of each, the classes that have
    them, and how many each has. A row without tokens tells of the documents themselves, and how many of a set's shingles
    can't be told from another one by those bits."""

    def flushed(ids: list, sets: list[np.ndarray], found: list[int], turn: int) -> Iterator[pa.RecordBatch]:
        classes = np.array([class_of(s) for s in sets], np.int64)
        sizes = np.array([len(s) for s in sets], np.int32)
        tokens = np.concatenate([np.zeros(0, np.int64), *sets]).view(np.uint64) >> np.uint64(32 - bits)
        owner = np.repeat(np.arange(len(sets)), sizes)
        # sets are sorted, so shingles of one token are next to each other
        folded = np.bincount(owner[1:][(tokens[1:] == tokens[:-1]) & (owner[1:] == owner[:-1])], minlength=len(sets)).astype(np.int32)
        bucket = (tokens >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rest = tokens.astype(np.uint32)[order]
        owner, bucket = owner[order], bucket[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        columns: list[list] = [[turn % (1 << bits)], [None], [classes.tobytes()], [None], [ids], [sizes.tobytes()], [folded.tobytes()], [np.array(found, np.uint64).tobytes()]]
        for i, j in pairwise([*starts, len(bucket)]):
            who, n = np.unique(owner[i:j], return_counts=True)
            for column, value in zip(columns, [int(bucket[i]), rest[i:j].tobytes(), classes[who].tobytes(), n.astype(np.uint32).tobytes(), None, None, None, None], strict=True):
                column.append(value)
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in DEALT.split(", ")])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, found, held, turn = [], [], [], 0, 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                blocks = list(shingle_hashes(text.as_py(), width))
                ids.append(doc_id)
                sets.append(distinct(blocks))
                found.append(simhash(blocks) if prints else 0)
                held += len(sets[-1])
                if held >= FLUSH:
                    yield from flushed(ids, sets, found, turn)
                    ids, sets, found, held, turn = [], [], [], 0, turn + 1
        if ids:
            yield from flushed(ids, sets, found, turn)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, DEALT)


def _counted(dealt: DataFrame) -> DataFrame:
    """For each class the tokens that other classes have too, with how many have each, bucket by bucket; and the documents."""

    def shared(bucket: int, tokens: list[bytes], classes: list[bytes], counts: list[bytes]) -> pa.RecordBatch:
        token = np.frombuffer(b"".join(tokens), np.uint32)
        owner = np.repeat(np.frombuffer(b"".join(classes), np.int64), np.frombuffer(b"".join(counts), np.uint32))
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        once = np.r_[True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])]  # copies of a set count once
        token, owner = token[once], owner[once]
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        of = np.repeat(np.diff(np.r_[starts, len(token)]), np.diff(np.r_[starts, len(token)]))
        common = of > 1
        token, owner, of = token[common].astype(np.int64) + (bucket << 32), owner[common], of[common]
        order = np.argsort(owner, kind="stable")
        token, owner, of = token[order], owner[order], of[order].astype(np.int32)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
        offsets = pa.array(np.r_[starts, len(owner)].astype(np.int32))
        none = [pa.nulls(len(starts), k) for k in (pa.int64(), pa.int32(), pa.int32(), pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(owner[starts]), pa.ListArray.from_arrays(offsets, pa.array(token)), pa.ListArray.from_arrays(offsets, pa.array(of)), *none], names)

    def documents(row: dict) -> pa.RecordBatch:
        classes, sizes, folded, prints = (np.frombuffer(row[c], k) for c, k in (("classes", np.int64), ("sizes", np.int32), ("folded", np.int32), ("prints", np.int64)))
        none = [pa.nulls(len(classes), pa.list_(k)) for k in (pa.int64(), pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(classes), *none, pa.array(row["ids"], pa.int64()), pa.array(sizes), pa.array(folded), pa.array(prints)], names)

    names = [f.split()[0] for f in COUNTED.split(", ")]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, ([], [], [])
        for batch in batches:
            for row in batch.to_pylist():
                if row["tokens"] is None:
                    yield documents(row)
                    continue
                if row["bucket"] != now and parts[0]:
                    yield shared(now, *parts)
                    parts = ([], [], [])
                now = row["bucket"]
                for part, name in zip(parts, ("tokens", "classes", "counts"), strict=True):
                    part.append(row[name])
        if parts[0]:
            yield shared(now, *parts)

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(read, COUNTED)


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Places of prefixes from ``sets`` (class, n, folded, tokens, of): the rarest tokens, so many that similar sets have one
    of them in common. Tokens of a single set come before all others and need no place."""
    fields = ["class", "n", "m", "at", "token"]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for own, n, folded, tokens, of in zip(*(batch[c].to_pylist() for c in ("class", "n", "folded")), batch["tokens"], batch["of"], strict=True):
                token = tokens.values.to_numpy()
                most = len(token) + folded
                first = token[np.lexsort((token, of.values.to_numpy()))][: most - needed(n, percent) + 1]
                for column, value in zip(rows, (np.full(len(first), own, np.int64), np.full(len(first), n, np.int32), np.full(len(first), most, np.int32), np.arange(len(first), dtype=np.int32), first), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, k), *c])) for c, k in zip(rows, (np.int64, np.int32, np.int32, np.int32, np.int64), strict=True)], fields)

    return sets.mapInArrow(read, "class long, n int, m int, at int, token long")


def rare_index(docs: DataFrame, width: int, percent: int, prints: bool = False) -> Index:
    """The index of ``docs`` (doc_id, text) for sets of ``width``-word shingles and a least similarity in percent.

    Every shingle of every document is counted, by the number of distinct sets that have it: shingles are dealt by hash in
    packed rows, and only those of two sets or more go on. A set of which others have less than ``percent`` of the
    shingles can't be similar to any and has no place in the index. Shingles are told apart by 32 bits and those of the
    bucket, of which there are more for a larger corpus; two that fall together share a count and a list.
    """
    spark = docs.sparkSession
    # about one shingle a word, and five characters a word at least
    length = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(31, max(0, int(length // 5 // BUCKET).bit_length()))
    folder = f"{shared_folder(spark)}/shingles-{uuid.uuid4().hex}"
    _counted(_dealt(docs, width, bits, prints)).write.parquet(folder)
    counted = spark.read.parquet(folder)
    rows = cut(counted.where("n is not null").select("doc_id", "class", "n", "simhash"))
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731  no more than a set's own shingles
    sets = counted.groupBy("class").agg(F.max("n").alias("n"), F.max("folded").alias("folded"), flat("tokens"), flat("of"))
    sets = sets.where((F.size("tokens") > 0) & ((F.size("tokens") + F.col("folded")) * 100 >= F.col("n") * percent))
    posts = cut(_prefixes(sets, percent))
    remove_folder(spark, folder)
    return Index(rows, posts)


def _marks(ids: DataFrame) -> np.ndarray:
    """MARKS bits, by the last bits of the hashes of ``ids`` (doc_id) that are there."""
    low = F.xxhash64("doc_id").bitwiseAND(F.lit(MARKS - 1))
    bit = F.expr("shiftleft(1L, cast(low & 31 as int))")
    rows = ids.select(low.alias("low")).groupBy(F.shiftright("low", 5).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(MARKS // 32, np.int64)
    bits[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return bits.astype(np.uint32)


def sets_of(docs: DataFrame, firsts: DataFrame, width: int) -> DataFrame:
    """(class, shingles, odd), once for each class of ``firsts`` (class, doc_id), from a document of that id. Bit i of odd, a
    row of longs, tells whether an odd number of shingles falls on it."""
    marks = docs.sparkSession.sparkContext.broadcast(_marks(firsts))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = batch["id"].to_numpy() & MARKS - 1
            wanted = (marks.value[low >> 5] >> (low & 31).astype(np.uint32) & 1).nonzero()[0]
            sets = [shingle_set(batch["text"][i].as_py(), width) for i in wanted.tolist()]
            odd = [np.packbits((np.bincount(s & PARITY - 1, minlength=PARITY) & 1).astype(np.uint8)).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), lists(sets), lists(odd)], ["class", "shingles", "odd"])

    found = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("id"), "text").mapInArrow(read, "class long, shingles array<long>, odd array<long>")
    return found.join(firsts, "class", "left_semi").groupBy("class").agg(F.first("shingles").alias("shingles"), F.first("odd").alias("odd"))
