"""Bounded-space online packing of tokenized documents into fixed-length sequences."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

LENGTH = 2048
#: Windows that a partition keeps open at a time: its memory is OPEN_WINDOWS * LENGTH ids.
OPEN_WINDOWS = 64
#: The id that ends each document.
END_ID = 1
#: How byte-level BPE cuts a text before it merges: contractions, words, numbers, signs, white space.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level_encoder(tokenizer_file: str):
    """An encoder for a byte-level BPE vocabulary in a tokenizers .json file.

    It gives the ids that library gives (the tests compare them), at several times its speed.
    Strings of special tokens inside a text become those tokens, as the library does.
    """
    import tiktoken

    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
    shown = {chr(b): b for b in plain} | {
        chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))
    }
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(shown[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("byte-level", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)


class Encoder:
    """Ids of texts by ``byte_level_encoder``, and by the tokenizers library where that one gives up:
    its expression's stack doesn't hold runs of a million white-space characters."""

    def __init__(self, tokenizer_file: str):
        self.file, self.fast, self.library = tokenizer_file, byte_level_encoder(tokenizer_file), None

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.file)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


class Packer:
    """Packs a stream of documents, with a fixed number of windows open.

    A piece goes to the open window it fits best. When it fits none and no more may be opened,
    the fullest window takes as much of the piece as it has room for and is emitted; the rest
    opens a window in its place. Windows that become full are emitted at once.
    """

    def __init__(self, length: int, open_windows: int):
        self.length, self.most = length, open_windows
        self.windows: list[tuple[int, list]] = []  # room, pieces

    def _put(self, at: int, piece: tuple) -> Iterator[list]:
        room, pieces = self.windows[at]
        pieces.append(piece)
        room -= len(piece[2])
        if room:
            self.windows[at] = room, pieces
        else:
            del self.windows[at]
            yield pieces

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list]:
        """Full sequences: lists of (doc_id, start, ids, ids in the document)."""
        total, start = len(ids), 0
        while total - start >= self.length:
            yield [(doc_id, start, ids[start : start + self.length], total)]
            start += self.length
        if start == total:
            return
        rest = total - start
        at = min((i for i, w in enumerate(self.windows) if w[0] >= rest), key=lambda i: self.windows[i][0], default=None)
        if at is None and len(self.windows) >= self.most:
            fullest = min(range(len(self.windows)), key=lambda i: self.windows[i][0])
            room = self.windows[fullest][0]
            yield from self._put(fullest, (doc_id, start, ids[start : start + room], total))
            start += room
        if at is None:
            self.windows.append((self.length, []))
            at = len(self.windows) - 1
        yield from self._put(at, (doc_id, start, ids[start:], total))

    def leftovers(self) -> Iterator[tuple[bool, list]]:
        """What is open at the end, merged by cutting: full sequences, and one that isn't full."""
        room, pieces = self.length, []
        for _, window in sorted(self.windows, key=lambda w: w[0]):
            for doc_id, start, ids, total in window:
                while len(ids):
                    head, ids = ids[:room], ids[room:]
                    pieces.append((doc_id, start, head, total))
                    start, room = start + len(head), room - len(head)
                    if not room:
                        yield True, pieces
                        room, pieces = self.length, []
        if pieces:
            yield False, pieces


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long,"
    " sequence_id long, offset long, part long, ids binary"
)
ARROW = pa.schema(
    [(n, pa.int64()) for n in "doc_id start length ids_crc32 doc_tokens sequence_id offset part".split()]
    + [("ids", pa.binary())]
)


def _rows(pieces: list, sequence: int, part: int, full: bool) -> Iterator[tuple]:
    offset = 0
    for doc_id, start, ids, total in pieces:
        data = ids.astype("<u4").tobytes()
        yield doc_id, start, len(ids), zlib.crc32(data), total, sequence, offset, part, None if full else data
        offset += len(ids)


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    length: int = LENGTH,
    open_windows: int = OPEN_WINDOWS,
    end_id: int = END_ID,
) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text, ...) into sequences of ``length`` ids.

    Returns a row per piece: doc_id, start (ids of its document before it), length, ids_crc32 (of
    its ids as little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset. A document
    is its byte-level BPE ids and ``end_id``; a null or empty text is ``end_id`` alone. Each
    partition packs its own rows; the part-filled sequence that each has at the end is laid end to
    end with those of the other partitions and cut anew, so that one sequence of the whole result
    isn't full, however many partitions there are. Rows are packed each for itself: repeated rows
    and null ids give as many pieces. No rows give no pieces; other columns are ignored.
    """

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, part = Encoder(tokenizer_file), Packer(length, open_windows), TaskContext.get().partitionId()
        out, sequence = [], part << 33
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.append(encoder.ids(text.as_py()), end_id)
                for pieces in packer.add(doc_id, ids):
                    out += _rows(pieces, sequence, part, True)
                    sequence += 1
            yield pa.RecordBatch.from_pylist([dict(zip(ARROW.names, r, strict=True)) for r in out], ARROW)
            out = []
        for full, pieces in packer.leftovers():
            out += _rows(pieces, sequence, part, full)
            sequence += 1
        yield pa.RecordBatch.from_pylist([dict(zip(ARROW.names, r, strict=True)) for r in out], ARROW)

    pieces = cut(docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(packed, SCHEMA))
    full, tails = pieces.where("ids is null"), pieces.where("ids is not null")

    # A row per partition, each of less than a sequence: where its tail begins among all tails.
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        tails.groupBy("part")
        .agg(F.sum("length").alias("tail"))
        .select("part", F.coalesce(F.sum("tail").over(ahead), F.lit(0)).alias("begin"))
    )
    place = F.col("begin") + F.col("offset")
    recut = (
        tails.join(begins, "part")
        .withColumn("place", place)
        .withColumn("nth", F.explode(F.sequence(F.expr(f"place div {length}"), F.expr(f"(place + length - 1) div {length}"))))
        .withColumn("skip", F.greatest(F.lit(0), F.col("nth") * length - F.col("place")))
        .withColumn("n", F.least(F.col("length"), (F.col("nth") + 1) * length - F.col("place")) - F.col("skip"))
        .select(
            "doc_id",
            (F.col("start") + F.col("skip")).alias("start"),
            F.col("n").alias("length"),
            F.crc32(F.expr("substring(ids, cast(1 + 4 * skip as int), cast(4 * n as int))")).alias("ids_crc32"),
            "doc_tokens",
            (F.lit(1 << 62) + F.col("nth")).alias("sequence_id"),
            (F.col("place") + F.col("skip") - F.col("nth") * length).alias("offset"),
        )
    )
    return full.drop("part", "ids").unionByName(recut)
