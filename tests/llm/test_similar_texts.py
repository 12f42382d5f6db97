import random
from itertools import combinations

import corpus_pipeline
from loamgraph.llm.rare_shingles import shingle_set
from loamgraph.llm.similar_texts import drop_similar, similar_documents
from test_simhash_dedup import brute_components, brute_fingerprint


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or 10 * len(a & b) >= 8 * len(a | b)


def edited_texts(n=150, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    line = " ".join(rng.choices(vocabulary, k=20))
    bases = [rng.choices(vocabulary, k=rng.choice([3, 6, 60, 150])) for _ in range(n // 3)]
    texts = ["", None, " \t", "only", "Only", "a b c", "é É"]
    for i in range(n):
        words = list(bases[i % len(bases)])
        for _ in range(rng.choice([0, 1, 1, 2, 3]) if len(words) > 50 else 0):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    return [f"{line} {t}" if t and i % 3 == 0 else t for i, t in enumerate(texts)]


def groups(texts):
    sets = {i: brute_shingles(t) for i, t in enumerate(texts)}
    return brute_components([p for p in combinations(sets, 2) if similar(sets[p[0]], sets[p[1]])], sets)


def test_components_against_brute_force_jaccard(documents):
    texts = edited_texts()
    label = groups(texts)
    assert len(set(label.values())) < len(texts) - 20
    assert {r.doc_id: r.component_id for r in similar_documents(documents(texts)).collect()} == label


def test_stage_drops_what_radius_three_leaves(spark, documents):
    rng = random.Random(2)
    words = [f"v{rng.randrange(10_000)}" for _ in range(200)]
    other = list(words)
    for at in (40, 90, 140):
        other[at] = "new"
    a, b = " ".join(words), " ".join(other)
    assert similar(brute_shingles(a), brute_shingles(b))
    assert (brute_fingerprint(a) ^ brute_fingerprint(b)).bit_count() > 3
    docs = documents([a, b, "q r s t u v"])
    kept = corpus_pipeline.without_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_one_row_of_each_group_stays(spark, documents):
    """Whatever repeats: ids, rows, ids of different texts, and rows without an id."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, "a"), (3, "a"), (3, "b"), (5, "b"), (4, "a"), (None, "a"), (None, "c"), (None, "c"), (7, long), (8, f"{long} more"), (8, "d"), (9, None), (10, ""), (11, "e"), (11, "e")]
    docs = documents([t for _, t in rows], [i for i, _ in rows]).selectExpr("*", "map('k', doc_id) AS class", "1 AS component", "2 AS `a.b`")
    kept = drop_similar(docs)
    assert kept.columns == docs.columns
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in kept.collect())
    assert got == [(-1, "c"), (3, "a"), (3, "b"), (7, long), (8, "d"), (9, ""), (11, "e")]


def test_odd_tables(documents):
    assert similar_documents(documents([])).count() == 0
    assert sorted(r.doc_id or -1 for r in drop_similar(documents(["a", "a", "a", "z"], [4, 5, None, None])).collect()) == [-1, 4]
    for n in (0, 1, 4, 5, 9):
        assert len(shingle_set(" ".join(map(str, range(n))), 5)) == min(n, max(1, n - 4))
