import random
import re

import pytest
from loamgraph.llm import jaccard_join, rare_shingles
from loamgraph.llm.jaccard_join import jaccard_components


def sets(texts, width):
    out = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()})
    return out


def brute_force(rows, width=5, percent=80):
    own = sets([t for _, t in rows], width)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if own[i] and own[j] and 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted((-1 if d is None else d, len(own[i]), -1 if (c := least.get(root(i))) is None else c) for i, (d, _) in enumerate(rows))


def found(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def near(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        i = rng.randrange(len(words))
        words[i : i + 1] = rng.choice([[], [f"w{rng.randrange(999)}"], [words[i], f"w{rng.randrange(999)}"]])
    return " ".join(words)


@pytest.mark.parametrize("seed", range(3))
def test_same_as_brute_force(spark, documents, seed, monkeypatch):
    if seed == 1:  # many small buckets and flushes
        monkeypatch.setattr(rare_shingles, "FLUSH", 300)
        monkeypatch.setattr(rare_shingles, "BUCKET", 500)
    rng = random.Random(seed)
    line = lambda n, of=60: " ".join(f"w{rng.randrange(of)}" for _ in range(n))
    passages, texts = [line(30) for _ in range(3)], []
    for _ in range(12):
        base = line(rng.choice([4, 9, 40, 120]))
        texts += [near(rng, base, rng.randrange(6)) for _ in range(rng.randrange(1, 7))]
    # passages in texts that aren't alike, chains of edits, exact copies, short and odd texts
    texts += [f"{line(12)} {rng.choice(passages)} {line(rng.randrange(1, 25))}" for _ in range(25)]
    chain = line(100)
    for _ in range(8):
        texts.append(chain)
        chain = near(rng, chain, 3)
    texts += [texts[0], texts[0].upper(), "a b", "A  b", "b a", "", None, " \t", "É x", "é x", " ".join(passages), "spam " * 500]
    rows = [(None if i == 7 else i % 90, t) for i, t in enumerate(texts)]
    df = documents([t for _, t in rows], [i for i, _ in rows]).selectExpr("*", "1 AS class", "2 AS token", "3 AS n")
    assert found(jaccard_components(df)) == brute_force(rows)


def test_answers_derived_between_clusters(spark, documents, monkeypatch):
    """Two groups of near copies at the edge of similarity: leaders aren't linked, some of their followers are."""
    rng = random.Random(5)
    base = [f"x{i}" for i in range(200)]
    other = [*base[:175], *(f"y{i}" for i in range(25))]
    texts = [near(rng, " ".join(b), rng.randrange(2)) for b in (base, other) for _ in range(12)]
    texts += [" ".join([*base[: 200 - k], *other[200 - k :]]) for k in (5, 10)]
    pairs = []
    kept = jaccard_join._answers
    monkeypatch.setattr(jaccard_join, "_answers", lambda p, *a: pairs.append(p.count()) or kept(p, *a))
    rows = list(enumerate(texts))
    assert found(jaccard_components(documents(texts))) == brute_force(rows)
    assert pairs[0] < 12 * 12


@pytest.mark.parametrize(("width", "percent"), [(2, 50), (1, 100), (3, 90)])
def test_other_widths_and_similarities(spark, documents, width, percent):
    rng = random.Random(width)
    texts = [" ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(1, 15))) for _ in range(70)]
    assert found(jaccard_components(documents(texts), width, percent)) == brute_force(list(enumerate(texts)), width, percent)


def test_empty_and_wrong(spark, documents):
    assert jaccard_components(documents([])).count() == 0
    assert found(jaccard_components(documents(["", None]))) == [(0, 0, 0), (1, 0, 1)]
    with pytest.raises(ValueError):
        jaccard_components(documents(["a"]), percent=0)
