import hashlib
import random

import numpy as np
from loamgraph.llm.phrases import borders, fingerprint, fingerprint_documents, fingerprints, levels, likeness


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n))


def phrase_starts(names):
    return np.flatnonzero(borders(names, np.array([len(names)])))


def test_texts_parsed_together_or_alone():
    rng = random.Random(8)
    texts = [words(rng, rng.choice([0, 1, 2, 60])) for _ in range(80)] + ["", "a", "ab", "aaaa", "é漢🙂", "a" * 5000, "ab" * 3000]
    rng.shuffle(texts)
    assert fingerprints(texts) == [fingerprint(t) for t in texts]
    assert fingerprints([]) == []


def test_borders_depend_on_neighbours_only():
    rng = np.random.default_rng(0)
    inner = rng.permutation(5000).astype(np.uint64)
    a, b = (np.concatenate([rng.permutation(n).astype(np.uint64) + np.uint64(9000), inner]) for n in (17, 401))
    one = set(phrase_starts(a) - 17)
    two = set(phrase_starts(b) - 401)
    assert {x for x in one if x > 12} == {x for x in two if x > 12}
    sizes = np.diff(phrase_starts(a))
    assert sizes.min() >= 2 and sizes.max() <= 16


def test_equal_substrings_share_interior_names():
    rng = random.Random(4)
    shared = words(rng, 300)
    a, b = (list(levels(words(rng, n) + shared + words(rng, n + 3))) for n in (10, 41))
    inner = list(levels(shared))
    for level in (1, 2, 3):
        want = set(inner[level][4:-4].tolist())
        assert want <= set(a[level].tolist()) and want <= set(b[level].tolist())


def test_likeness():
    rng = random.Random(5)
    text = words(rng, 500)
    other = words(rng, 500)
    edited = text[: len(text) * 2 // 3] + other[: len(text) // 3]
    assert likeness(fingerprint(text), fingerprint(text)) == 1
    assert 0.3 < likeness(fingerprint(text), fingerprint(edited)) < 0.8
    assert likeness(fingerprint(text), fingerprint(other)) < 0.1
    assert likeness(fingerprint(text), fingerprint("prefix of it " + text)) > 0.9
    assert likeness("", "") == 1 and likeness("", fingerprint("a")) == 0
    assert fingerprint("a") != fingerprint("b") and fingerprint("ab" * 9) != fingerprint("ab" * 10)
    assert fingerprint("a" * 10) != fingerprint("a" * 11)


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for (i, text), (_, following) in zip(order, [*order[1:], *order[:1]], strict=True):
        text, following = text or "", following or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        a, b, c = map(fingerprint, (text, edited, following))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    return sorted(out, key=repr)


def test_operator_against_brute_force(spark, documents):
    rng = random.Random(6)
    texts = [words(rng, rng.choice([1, 3, 200])) for _ in range(90)] + ["", None, "é漢🙂" * 20, "a" * 50_000]
    ids = rng.sample(range(-500, 10_000), 94)
    texts += ["same id", "same id", "same id too", "no id", None]
    ids += [7, 7, 7, None, None]
    docs = documents(texts, ids).repartition(5)
    got = sorted((tuple(r) for r in fingerprint_documents(docs).collect()), key=repr)
    assert got == brute(list(zip(ids, texts, strict=True)))


def test_odd_tables(spark, documents):
    assert fingerprint_documents(documents([])).count() == 0
    row = fingerprint_documents(documents(["some words of a text"])).first()
    assert row.near_next == 1
    clash = spark.createDataFrame([(1, "a b", 5, True)], "doc_id long, text string, span int, carried boolean")
    assert fingerprint_documents(clash).count() == 1
