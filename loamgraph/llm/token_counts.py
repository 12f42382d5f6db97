"""Exact token counts of every prefix of a text, by dynamic programming over BPE encodings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty

TOKEN_LIMIT = 4096
#: Chunks whose prefix counts a worker remembers; it starts anew beyond them.
REMEMBERED = 1 << 20
#: Longer chunks are counted each time they are met; the counts of shorter ones fit in bytes.
LONGEST_REMEMBERED = 63
#: Chunks with the same so many first characters share the entries of those.
HEAD = 6
SPACE = "▁"
#: No piece has a space after another character, so no merge crosses from one chunk to the next.
CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PrefixCounter:
    """Token counts of all prefixes of texts, for a BPE model of sentencepiece with byte fallback.

    For a prefix of length i whose encoding ends in piece t, the rest of that encoding is the
    encoding of the prefix of length i - len(t): no merge crosses the border. So count[i] is
    count[i - len(t)] + 1, where t is the one suffix that keeps apart from the last piece of the
    shorter prefix. Whether two pieces keep apart is asked of the library, once a pair.
    """

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=model_file).serialized_model_proto())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only models that leave texts as they are and add a space in front")
        normal = pb.ModelProto.SentencePiece.NORMAL
        pieces = {p.piece for p in model.pieces if p.type == normal}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces with a space behind another character")
        norm.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        #: Every ending of a piece, and whether it is a piece itself.
        self.endings = {p[k:]: p[k:] in pieces for p in pieces for k in range(len(p))}
        self.apart: dict[tuple[str, str], bool] = {}
        self.heads: dict[str, tuple[list[int], list[str]]] = {}
        self.known: dict[str, bytes] = {}

    def _keep_apart(self, pair: tuple[str, str]) -> bool:
        if len(self.apart) >= REMEMBERED // 2:
            self.apart.clear()
        alone = not self.endings.get(pair[0])  # a character without a piece merges with nothing
        known = self.apart[pair] = alone or self.bare.encode_as_pieces(pair[0] + pair[1]) == [*pair]
        return known

    def _extend(self, chunk: str, counts: list[int], last: list[str]) -> None:
        """Entry i: the count of the chunk's prefix of length i, and the piece that ends it."""
        ending, apart = self.endings.get, self.apart
        for i in range(len(counts), len(chunk) + 1):
            j, fits = i - 1, []
            while j >= 0 and (whole := ending(chunk[j:i])) is not None:
                if whole:
                    fits.append(j)
                j -= 1
            for j in reversed(fits):
                piece = chunk[j:i]
                if not j:
                    break
                known = apart.get(pair := (last[j], piece))
                if known or (known is None and self._keep_apart(pair)):
                    break
            else:
                j, piece = i - 1, chunk[i - 1]
            # a character without a piece falls back to its bytes
            counts.append(counts[j] + (1 if fits else len(piece.encode())))
            last.append(piece)

    def of_chunk(self, chunk: str) -> list[int]:
        """Counts of the chunk's prefixes of 1, 2, ... characters. Chunks share their beginnings' entries."""
        head = chunk[:HEAD]
        known = self.heads.get(head)
        if known is None:
            if len(self.heads) >= REMEMBERED // 4:
                self.heads.clear()
            known = self.heads[head] = ([0], [""])
            self._extend(head, *known)
        counts, last = known[0].copy(), known[1].copy()
        self._extend(chunk, counts, last)
        return counts[1:]

    def _chunk(self, chunk: str) -> bytes | list[int]:
        if len(chunk) > LONGEST_REMEMBERED:
            return self.of_chunk(chunk)
        counts = self.known.get(chunk)
        if counts is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            counts = self.known[chunk] = bytes(self.of_chunk(chunk))
        return counts

    def chunks(self, text: str) -> list[str]:
        return CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def total(self, text: str) -> int:
        known = self.known.get
        return sum((known(c) or self._chunk(c))[-1] for c in self.chunks(text))

    def prefixes(self, text: str) -> np.ndarray:
        """Entry i is the number of tokens of ``text[:i]``, for i from 0 to its length."""
        out, done = [0], 0
        for chunk in self.chunks(text):
            counts = self._chunk(chunk)
            out += [done + n for n in counts]
            done += counts[-1]
        return np.array([0, *out[2:]], np.int32)  # the space in front belongs to no prefix


@lru_cache(maxsize=1)
def counter_for(model_file: str) -> PrefixCounter:
    """One counter for all tasks of a Python worker, with what it remembers."""
    return PrefixCounter(model_file)


def fitting(prefix_tokens: np.ndarray, limit: int) -> int:
    """The length of the longest prefix of at most ``limit`` tokens."""
    return int(np.flatnonzero(prefix_tokens <= limit)[-1])


def prefix_token_counts(
    docs: DataFrame, model_file: str, limit: int = TOKEN_LIMIT, keep_prefixes: bool = True
) -> DataFrame:
    """Token counts of each row of ``docs`` (doc_id, text, ...) under a sentencepiece BPE model.

    Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), fit_chars (length in
    characters of the longest prefix within the limit) and, with ``keep_prefixes``,
    prefix_tokens: the exact count at every prefix length from 0 on, from which any truncation
    or budget question is answered without encoding again. A null text is empty: no bytes, no
    tokens. Rows are independent: repeated rows and null ids stay as they are; other columns of
    ``docs`` are ignored. Strings that look like special tokens are ordinary text.
    """
    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("fit_chars", T.LongType()),
        *([T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))] if keep_prefixes else []),
    ]

    @F.pandas_udf(T.StructType(fields))
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = counter_for(model_file)
        for texts in parts:
            rows = []
            for text in texts:
                n = counter.total(text)
                known = counter.prefixes(text) if keep_prefixes or n > limit else None
                rows.append((n, len(text) if n <= limit else fitting(known, limit), *([known] if keep_prefixes else [])))
            yield pd.DataFrame(rows, columns=[f.name for f in fields])

    text = text_or_empty()
    return docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("counts")
    ).select("doc_id", "n_bytes", "counts.*", (F.col("counts.n_tokens") > limit).alias("over_limit"))
