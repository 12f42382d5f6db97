import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    def make(texts, ids=None, **extra):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, DOCUMENTS)

    return make
