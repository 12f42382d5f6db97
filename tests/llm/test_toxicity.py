import random
import zlib

import numpy as np
from loamgraph.llm import toxicity as toxicity_module
from loamgraph.llm.toxicity import Model, drop_toxic, features, fit_noisy_or, held_out, score_toxicity, toxicity, train
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    pairs = (s[y == 1][:, None] > s[y == 0][None]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None]).mean()
    assert pairs > 0.97
    assert ((s >= 0.5) == y).mean() > 0.97
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def numbers(words):
    return np.array(sorted(f for w in set(words.split()) for f in features(w)))


def test_noisy_or_finds_the_word():
    rng = random.Random(3)
    bags, labels = [], []
    for i in range(300):
        bag = [numbers(" ".join(rng.choices("abcdefghijkl", k=4))) for _ in range(5)]
        if i % 3 == 0:
            bag[2] = np.append(bag[2], numbers("awful"))
        bags.append(bag)
        labels.append(i % 3 == 0)
    model = fit_noisy_or(bags, np.array(labels, int), np.unique(np.concatenate([s for bag in bags for s in bag])))
    score, spans = model.score("a b c. an AWFUL day! d e f\ng")
    assert score > 0.5 and [p > 0.5 for *_, p in spans] == [False, True, False, False]
    assert model.score("a b. c d. e f.")[0] < 0.3


def test_noisy_or_of_sentences():
    model = Model(-1.0, {f: 0.7 for f in features("bad")})
    score, spans = model.score("good. bad.")
    assert np.isclose(score, 1 - np.prod([1 - p for *_, p in spans]))
    assert model.score("") == (0.0, [])


def test_learns_from_no_held_out_row(spark, documents):
    docs = documents(["bad word here", "fine word here"] * 60)
    labels = docs.select("doc_id", ((F.col("doc_id") + 1) % 2).cast("int").alias("toxic"))
    out = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    assert {i: r.score for i, r in out.items()} == {r.doc_id: r.score for r in score_toxicity(docs, flipped).collect()}
    assert out[0].score > 0.5 > out[1].score


def test_offending_sentences_and_filter(spark, documents):
    docs = documents(["this is fine. really", "this is trash. fine"] * 40 + [None, ""])
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).limit(80)
    model = train(docs, labels)
    row = docs.where("doc_id = 1").select(toxicity(model, spans=True).alias("t")).first().t
    assert [(s.start, s.stop) for s in row.sentences] == [(0, 13)]
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id % 2 if r.doc_id < 80 else 0 for r in kept.collect()} == {0} and kept.count() == 42


def test_every_labelled_document_counts(spark, documents):
    """A bound on what one task fits leaves no document out: with any, the model knows what only some of them show."""
    docs = documents([f"word{i} is {'rotten' if i % 4 == 0 else 'vile' if i % 4 == 2 else 'fine'} here" for i in range(400)])
    labels = docs.select("doc_id", ((F.col("doc_id") + 1) % 2).cast("int").alias("toxic"))
    whole, dealt = train(docs, labels, 1000), train(docs, labels, 100)
    for word in ("rotten", "vile", "fine"):
        scores = [m.score(f"this is {word} here")[0] for m in (whole, dealt)]
        assert all((p > 0.5) == (word != "fine") for p in scores)
    assert whole.weights.keys() == dealt.weights.keys() and whole.bias != dealt.bias
    assert dealt.weights == train(docs, labels, 100).weights
    known = train(documents([f"a common line. {chr(97 + i % 26) * 3} {'trash' if i == 7 or i > 60 else 'fine'}" for i in range(120)]), labels.limit(120), 1)
    assert known.weights


def test_very_long_texts_are_scored_whole(spark, documents, monkeypatch):
    monkeypatch.setattr(toxicity_module, "TRAIN_CHARS", 50_000)
    docs = documents(["this is fine. really", "this is trash. fine"] * 40 + ["fine words. " * 200_000 + "this is trash", "x" * 2_000_000])
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).limit(80)
    rows = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    assert rows[80].score > 0.5 and (rows[80].sentences[-1].start, rows[80].sentences[-1].stop) == (2_399_999, 2_400_013)
    assert 0 <= rows[81].score <= 1 and [s.start for s in rows[1].sentences] == [0] and rows[0].sentences == []


def test_odd_tables(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert score_toxicity(documents([]), none).count() == 0
    rows = score_toxicity(documents([None, "", "a", "a"], [None, 1, 2, 2]), none).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(None, 1), (2, None), (2, 1), (2, 0)], "doc_id long, toxic int")
    clash = spark.createDataFrame([(2, "a", 7, "x")], "doc_id long, text string, toxic int, score string")
    assert score_toxicity(clash, odd).columns == ["doc_id", "held_out", "score", "predicted", "sentences"]


def test_equal_sentences_are_computed_once(monkeypatch):
    """Most sentences have no chosen feature at all; a step's work follows the distinct ones, and the fit is that of all of them."""
    known = numbers("awful fine")
    sizes, logaddexp = [], np.logaddexp
    monkeypatch.setattr(toxicity_module.np, "logaddexp", lambda a, b: sizes.append(np.size(b)) or logaddexp(a, b))
    none = np.zeros(0, np.int64)
    bags = [[none] * (i % 7) + [numbers("awful" if i % 3 == 0 else "fine")] * 2 for i in range(300)]
    labels = np.array([i % 3 == 0 for i in range(300)], int)
    model = fit_noisy_or(bags, labels, known)
    assert max(sizes) == 3
    clean = [sum(-logaddexp(0, model.bias + sum(model.weights[f] for f in s)) for s in bag) for bag in bags]
    assert all((c < np.log(0.5)) == y for c, y in zip(clean, labels, strict=True))
    assert model.score("awful. x. y")[0] > 0.5 > model.score("fine. x. y")[0]
