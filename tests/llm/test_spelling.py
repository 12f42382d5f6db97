import random
import re
import zlib
from collections import Counter

import pytest
from loamgraph.llm import spelling
from loamgraph.llm.spelling import Grams, near_pairs, spelling_variants

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def vocabulary(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    return {w: c for w, c in n.items() if c >= 2}


def brute_force(rows):
    n = vocabulary(rows)
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def edited(rng, word, letters):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i:], word[:i] + rng.choice(letters) + word[i + 1 :]])


@pytest.mark.parametrize("frequent", [1, 4, 64])
def test_pairs_are_all_found(spark, frequent):
    rng = random.Random(frequent)
    words, letters = set(), "abcé"
    for _ in range(60):
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(7, 14)))
        words |= {word, *(edited(rng, word, letters) for _ in range(6))}
    words = sorted(w for w in words if len(w) >= 7)
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = sorted((r.a, r.b) for r in near_pairs(df, frequent).collect())
    assert got == [(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)]


@pytest.mark.parametrize("seed", range(4))
def test_an_edit_affects_no_more_grams_than_told(seed):
    rng = random.Random(seed)
    letters = "abcd"
    corpus = ["".join(rng.choices(letters, [8, 4, 2, 1])[0] for _ in range(rng.randrange(7, 15))) for _ in range(400)]
    counts = Counter(g for w in corpus for g in {w[p : p + q] for q in range(spelling.SHORTEST, spelling.LONGEST + 1) for p in range(len(w) - q + 1)})
    for frequent in (3, 20, 60):
        grams = Grams({g: c for g, c in counts.items() if c > frequent})
        told = 0
        for word in corpus:
            own = grams.of(word)
            kept = grams.kept(word, own)
            told += kept > 0
            for _ in range(10):
                other = edited(rng, word, letters)
                shared = Counter(g for _, g in own) & Counter(g for _, g in grams.of(other))
                assert sum(shared.values()) >= kept, (word, other)
                (a, more), (b, others) = grams.signature(word), grams.signature(other)
                assert more and others or any(g == h and abs(p - q) <= 1 for p, g in a for q, h in b)
        assert told > 0


def test_frequent_grams_are_bounded(spark):
    df = spark.createDataFrame([(f"word{i:05d}", 2) for i in range(300)], "word string, n long")
    every = spelling.frequent_grams(df, 5)
    few = spelling.frequent_grams(df, 5, most=20)
    assert every["word0"] == 300 and 0 < len(few) <= 20 and all(every[g] == n for g, n in few.items())
    assert all(g[:-1] in few for g in few if len(g) > spelling.SHORTEST)
    pairs = {tuple(r) for r in near_pairs(df, 5).collect()}
    assert pairs == {tuple(r) for r in near_pairs(df, 5, most=20).collect()} and len(pairs) > 1000


def test_same_as_brute_force(spark, documents):
    rng = random.Random(9)
    common = ["nationality", "étéétéés", "remarkable", "IRONICally", "abcdefgh"]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.8 else edited(rng, rng.choice(common), "aeé") for _ in range(60)) for _ in range(40)]
    texts += ["short words", "", None, "abcdefg1abcdefg abcdefg", "x" * 5000, "x" * 5000, texts[0]]
    ids = [*range(len(texts) - 1), None]
    df = documents(texts, ids).selectExpr("*", "1 AS word", "2 AS n", "3 AS gram")
    rows = list(zip(ids, texts, strict=True))
    want = brute_force(rows)
    assert found(spelling_variants(df)) == want and any(r[1] for r in want)


def test_chains_of_forms(spark, documents):
    texts = [f"{w} " * n for w, n in (("aaaaaaaaa", 2), ("aaaaaaaab", 30), ("aaaaaaabb", 400), ("aaaaaabbb", 5000))]
    rows = list(enumerate(texts))
    assert found(spelling_variants(documents(texts))) == brute_force(rows)


def test_empty(spark, documents):
    assert spelling_variants(documents([])).count() == 0 == spelling_variants(documents([None, "", "a b c"])).count()
