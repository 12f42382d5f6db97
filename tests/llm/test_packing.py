import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from loamgraph.llm.packing import Encoder, Packer, pack
from tokenizers import Tokenizer

FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a<|endoftext|>b", " <|endoftext|>", "é漢字🙂", "don't I'LL we've", "\n\n  x\t", "12345 %%%", "y" * 30_000, " " * 20_000, " " * 1_500_000 + "a\n"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def test_ids_equal_the_library(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    encoder = Encoder(FILE)
    for text in ODD + [r.text for r in rows]:
        assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_packer_keeps_few_windows_and_fills_them():
    rng = np.random.default_rng(1)
    packer, full = Packer(64, 8), []
    for i in range(2000):
        full += packer.add(i, np.arange(rng.integers(1, 100)))
        assert len(packer.windows) <= 8
    assert all(sum(len(p[2]) for p in s) == 64 for s in full)
    ends = [*packer.leftovers()]
    assert all(is_full for is_full, _ in ends[:-1])


def check_rows(rows, want, length):
    """Each id lies in one piece; sequences are gapless; at most one isn't full."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == want.keys()
    for doc_id, ids in want.items():
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sizes = []
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        sizes.append(at)
    assert sum(n != length for n in sizes) <= 1 and max(sizes) <= length


@pytest.mark.parametrize("parts", [1, 7])
def test_pack_round_trip(spark, documents, library, parts):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [*ODD, None, *(r.text for r in rows)]
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    check_rows(pack(documents(texts).repartition(parts), FILE).collect(), want, 2048)


def test_odd_tables(spark, documents):
    assert pack(documents([]), FILE).count() == 0
    rows = pack(documents([None, "", ""], [None, 3, 3]), FILE).collect()
    assert sorted((r.doc_id is None, r.length, r.doc_tokens) for r in rows) == [(False, 1, 1), (False, 1, 1), (True, 1, 1)]
    clash = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, part int, ids int")
    assert pack(clash, FILE).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
