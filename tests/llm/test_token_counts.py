import random

import public_tokenizers
import pytest
import sentencepiece
from loamgraph.llm.token_counts import PrefixCounter, prefix_token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "   ", "a", " a", "a ", "  two  spaces ", "\n\n\t tab", "x" * 300, "</s> <s> <unk>", "日本語テキスト", "é è ß ▁ ▁▁x",
    "emoji 🙂🙂 zero​width", "the " * 500, "\x00\x01", " " * 100 + "end", "%%% *** ###&&&", "ﬁ ① Å",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts(spark, n=60):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(n).collect()
    return [r.text for r in rows]


def test_totals_equal_the_library(spark, library):
    counter = PrefixCounter(MODEL)
    for text in ODD + texts(spark):
        assert counter.total(text) == len(library.encode(text)), text[:80]


def test_every_prefix_equals_the_library(spark, library):
    counter = PrefixCounter(MODEL)
    for text in ODD + [t[:400] for t in texts(spark, 12)]:
        want = [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        assert counter.prefixes(text).tolist() == want, text[:80]


def test_random_strings(library):
    rng, counter = random.Random(5), PrefixCounter(MODEL)
    for _ in range(400):
        text = "".join(rng.choices(" aeinorst▁.é漢", k=rng.randrange(40)))
        assert counter.total(text) == len(library.encode(text)), repr(text)


def test_operator(spark, documents, library):
    rows = [*ODD, None, "many words " * 3000]
    got = prefix_token_counts(documents(rows), MODEL, limit=50).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r.doc_id] or ""
        assert r.n_bytes == len(text.encode())
        assert r.n_tokens == len(library.encode(text)) == r.prefix_tokens[-1]
        assert r.over_limit == (r.n_tokens > 50)
        assert len(library.encode(text[: r.fit_chars])) <= 50
        assert r.fit_chars == len(text) or len(library.encode(text[: r.fit_chars + 1])) > 50


def test_odd_tables(spark, documents):
    assert prefix_token_counts(documents([]), MODEL).count() == 0
    rows = prefix_token_counts(documents(["a", "a"], [None, None]), MODEL, keep_prefixes=False).collect()
    assert [(r.doc_id, r.n_tokens) for r in rows] == [(None, 1), (None, 1)]
    clash = spark.createDataFrame([(1, "a b", "x", 9)], "doc_id long, text string, counts string, n_tokens int")
    assert prefix_token_counts(clash, MODEL).first().n_tokens == 2
