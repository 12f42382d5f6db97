import math
import random
from collections import Counter, defaultdict

import numpy as np
from loamgraph.llm import quality_kn
from loamgraph.llm.quality_kn import classify_quality, discounts, drop_low_quality, packed_ngrams, train
from pyspark.sql import functions as F


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney over characters, written as its recursion."""
    tables = {order: Counter(("\x02" * (order - 1) + t)[i : i + order] for t in texts for i in range(len(t)))}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    size = len(tables[1]) + 1
    offs = {k: discounts([sum(c == n for c in t.values()) for n in (1, 2, 3, 4)]) for k, t in tables.items()}
    sums = {k: defaultdict(list) for k in tables}
    for k, t in tables.items():
        for g, c in t.items():
            sums[k][g[:-1]].append(c)

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / size
        seen = sums[k].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        off = lambda c: offs[k][min(c, 3) - 1]
        own = tables[k][gram]
        return (own - off(own) if own else 0) / sum(seen) + sum(map(off, seen)) / sum(seen) * p(gram[1:])

    return lambda text: [math.log(p(("\x02" * (order - 1) + text)[i : i + order])) for i in range(len(text))]


def test_probabilities_against_brute_force(documents):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdé 🙂\uf642", weights=[9, 5, 3, 2, 1, 4, 2, 2], k=rng.randrange(1, 60))) for _ in range(80)]
    for order in (2, 4):
        model, want = train(documents(texts).select("text"), order), brute_model(texts, order)
        for text in [*texts[:20], "zz top", "é", "abc漢d", "a🙂b\U0001f9ffc", "\ud800"]:
            assert np.allclose(model.log_probs(text), want(text))


def test_ngrams_of_any_text():
    letters = np.array([ord("a"), ord("b"), ord("🙂")], np.uint32)
    assert packed_ngrams("ab", letters, 2).tolist() == [2 << 16 | 3, 3 << 16 | 4]
    assert len(packed_ngrams("", letters, 4)) == 0 and packed_ngrams("🙂\uf642", letters, 1).tolist() == [5, 1]


def test_held_out_separation(spark):
    """Documents of which neither the model nor the thresholds have seen a label."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = classify_quality(docs, labels.where(~out)).join(labels.where(out), "doc_id").collect()
    good = [r.keep for r in rows if r.quality == 1]
    bad = [r.keep for r in rows if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.25, (np.mean(good), np.mean(bad), len(good), len(bad))


def test_thresholds_and_decisions_against_brute_force(spark, documents, monkeypatch):
    """Every step by itself: who is trusted, who the model is for, its perplexities, quantiles per language, and who is kept."""
    monkeypatch.setattr(quality_kn, "LEAST_PER_LANG", 20)
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcd ", weights=rng.choice([[9, 5, 3, 2, 4], [1, 1, 9, 9, 1]]), k=rng.randrange(1, 40))) for _ in range(300)] + ["", None]
    langs = [rng.choice(["x", "y", "rare" if i < 20 else "y", None]) for i in range(len(texts))]
    frame = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string")
    marks = [(i, int(rng.random() < 0.7)) for i in range(len(texts)) if rng.random() < 0.9]
    labels = spark.createDataFrame([*marks, (5, 0), (None, 1)], "doc_id long, quality int")
    hashes = {r.doc_id: r.h for r in frame.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    trusted = {i for i, q in marks if q} - {5}
    for_model = {i for i in trusted if hashes[i] % 2 == 0}
    typed = brute_model([texts[i] for i in sorted(for_model) if texts[i]], 4)
    all_logs = [p for i in sorted(for_model) for p in typed(texts[i] or "")]
    typical = sum(all_logs) / len(all_logs)

    def perplexity(text):
        logs = typed(text or "")
        return math.exp(-(sum(logs) + quality_kn.PRIOR_CHARS * typical) / (len(logs) + quality_kn.PRIOR_CHARS)) if logs else math.inf

    held = {i: perplexity(texts[i]) for i in trusted - for_model if texts[i]}
    quantile = lambda values: sorted(values)[math.ceil(quality_kn.KEPT_SHARE * len(values)) - 1]
    groups = {g: [p for i, p in held.items() if langs[i] == g] for g in ("x", "y", "rare")}
    limits = {g: quantile(v) for g, v in groups.items() if len(v) >= 20}
    assert len(limits) >= 2 and "rare" not in limits
    for r in classify_quality(frame, labels).collect():
        want, limit = perplexity(texts[r.doc_id]), limits.get(langs[r.doc_id], quantile(held.values()))
        assert math.isclose(r.perplexity, want, rel_tol=1e-9) and math.isclose(r.threshold, limit, rel_tol=1e-9)
        assert r.keep == (r.perplexity <= r.threshold and want < math.inf)


def test_the_sample_is_bounded_in_characters(spark, documents, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_kn, "TRAIN_CHARS", 100)
    monkeypatch.setattr(quality_kn, "train", lambda texts: seen.append(texts.collect()) or train(texts))
    docs = documents(["x" * 60] * 40)
    classify_quality(docs, spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")).count()
    assert len(seen[0]) == 1


def test_the_model_is_of_all_trusted_documents(spark, documents):
    """More of them than any bound that fit had: a letter that only one has is known wherever that one comes by hash."""
    n = 9000
    texts = [f"a{chr(0x4E00 + i)}" for i in range(n)]
    labels = spark.createDataFrame([(i, 1) for i in range(n)], "doc_id long, quality int")
    docs = documents(texts)
    half = {chr(0x4E00 + r.doc_id) for r in docs.where(F.xxhash64("doc_id") % 2 == 0).select("doc_id").collect()}
    assert len(half) > 4000
    model, _, _ = quality_kn.fit(docs, labels)
    assert {chr(c) for c in model.alphabet} == half | {"a"}


def test_counts_by_parts_are_those_of_the_whole(documents, monkeypatch):
    texts = documents(["abc abd", "", "abc", "é" * 30, "abd abc"]).select("text")
    whole = train(texts, 3)
    monkeypatch.setattr(quality_kn, "COUNTED", 4)
    parts = train(texts, 3)
    assert all(np.array_equal(a, b) for a, b in zip(whole.ngrams, parts.ngrams, strict=True))
    assert all(np.allclose(a, b) for a, b in zip(whole.log_p, parts.log_p, strict=True))


def test_filter_and_odd_tables(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = documents(["some text", "", None, "x" * 100_000, "some text"], [1, 2, 3, None, 1])
    kept = drop_low_quality(docs, none)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1]
    assert classify_quality(documents([]), none).count() == 0
    odd = spark.createDataFrame([(None, 1), (1, None), (1, 1), (9, 1)], "doc_id long, quality int")
    clash = docs.selectExpr("*", "'t' as threshold", "1 as keep", "2 as gram")
    assert classify_quality(clash, odd).count() == 5
    left = drop_low_quality(clash, odd)
    assert left.columns == clash.columns and {r.threshold for r in left.collect()} == {"t"}
    assert drop_low_quality(clash.selectExpr("doc_id", "text", "cast(null as string) lang"), odd).columns == ["doc_id", "text", "lang"]
