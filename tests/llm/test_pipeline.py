from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from loamgraph.llm.registry import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F
from test_decontaminate import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage kept, from the documents on."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        folder = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(folder)
        docs = spark.read.parquet(folder)
        out.append(docs)
    return out


def test_stages_keep_the_columns_of_documents(stages):
    assert [s.columns for s in stages[1:-1]] == [stages[0].columns] * 4
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "packing"]


def test_filters_reject_the_labelled_and_keep_the_clean(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    left = {r.doc_id for r in stages[2].collect()}
    rows = labels.collect()
    clean = [r.doc_id in left for r in rows if r.quality == 1 and r.toxic == 0]
    assert np.mean(clean) > 0.9
    assert np.mean([r.doc_id in left for r in rows if r.quality == 0]) < 0.5


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_dedup_and_decontamination_against_brute_force(spark, stages):
    before = [(r.doc_id, r.text) for r in stages[2].select("doc_id", "text").collect()]
    sets = {i: shingles(t) for i, t in before}
    near = [(a, b) for a, b in combinations(sets, 2) if sets[a] == sets[b] or len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b])]
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in near:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    heads = {find(i) for i in sets}
    assert {r.doc_id for r in stages[3].collect()} == heads and len(heads) < len(sets)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {i for i, _ in brute([x for x in before if x[0] in heads], items)}
    assert {r.doc_id for r in stages[4].collect()} == heads - dirty


def odd_rows(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __quality_threshold double, __simhash long, `key` string"
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None, None, None)] * 2 + [(1, "", "en", "s", 0, 0.5, 1, "k"), (2, "some text. and more", None, None, 3, None, None, None), (2, "some text. and more", None, None, 3, None, None, None), (3, "long words " * 20_000, "en", "s", 1, 2.0, 3, "k")]])
def test_odd_tables_go_through_all_stages(spark, tmp_path, rows):
    docs = odd_rows(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs, before = spark.read.parquet(str(tmp_path / name)), docs
        if name != "packing":
            assert docs.columns == before.columns and docs.count() <= before.count()
    kept = {r.doc_id for r in docs.collect()}
    assert kept <= {1, 2, 3, None} and (not rows or 2 in kept)


def test_packing_takes_all_that_is_left(spark, stages):
    packed = stages[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in stages[4].collect()}
    assert all(r.n == r.d for r in packed)
    whole = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {tuple(r) for r in whole} == {(r.doc_id, r.n) for r in packed}


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)
