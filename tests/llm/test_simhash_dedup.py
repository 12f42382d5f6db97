import random
from itertools import combinations

import xxhash
from loamgraph.operators.components import connected_components
from loamgraph.llm.simhash_dedup import drop_near_duplicates, fingerprint, links, near_duplicates


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(pairs, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def texts_with_copies(n=120, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            words = rng.choice(texts).split()
            if rng.random() < 0.7:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = rng.choices(vocabulary, k=rng.choice([1, 2, 5, 300]))
        texts.append(" ".join(words))
    return texts


def test_fingerprint_against_brute_force():
    odd = ["", " \t\n", "A", "A b", "A b C\x0bd e", "É é É", "x " * 70_000, None]
    for text in odd + texts_with_copies(40):
        assert fingerprint(text) == brute_fingerprint(text)


def test_near_duplicates_against_brute_force(documents):
    texts = [*texts_with_copies(), "", None, "  ", "only", "only"]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in near_duplicates(documents(texts)).collect()}
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    near = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    label = brute_components(near, prints)
    assert got == {i: (prints[i], label[i]) for i in prints}
    assert len(set(label.values())) < len(texts) - 20


def test_links_cover_every_distance(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(20)]
    prints = {p ^ sum(1 << b for b in rng.sample(range(63), k)) for p in base for k in range(6)} | set(base)
    frame = spark.createDataFrame([(p,) for p in prints], "simhash long")
    got = {(r.a, r.b) for r in links(frame).collect()}
    assert got == {(min(a, b), max(a, b)) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 3}


def test_components_of_paths_stars_and_odd_rows(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 140)]
    rows = [*path, *star, (5, 5), (None, 3), (7, None), *path[:5], (101, 100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "a int, b int"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100)}


def test_odd_tables(spark, documents):
    assert near_duplicates(documents([])).count() == 0
    rows = near_duplicates(documents(["a b c", "a b c", "a b c", "z"], [4, 4, None, None])).collect()
    assert len(rows) == 4
    assert [r.component_id for r in rows].count(4) == 3
    clash = spark.createDataFrame([(1, "a", 2, 3)], "doc_id long, text string, simhash int, component_id int")
    assert near_duplicates(clash).columns == ["doc_id", "fingerprint", "component_id"]


def test_one_document_of_each_group_stays(documents):
    docs = documents(["a b c d", "q r s t u", "a b c d", "A  B c d", None, ""])
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 4]


def test_one_row_of_repeated_and_nameless_rows_stays(spark, documents):
    docs = documents(["a b c d"] * 5 + ["q r s"] * 2, [4, 4, None, None, 7, None, None])
    assert sorted(((r.doc_id, r.text) for r in drop_near_duplicates(docs).collect()), key=repr) == [(4, "a b c d"), (None, "q r s")]
    clash = spark.createDataFrame([(1, "a", 2, "x"), (1, "a", 3, "y")], "doc_id long, text string, __near_print int, `a.b` string")
    assert drop_near_duplicates(clash).columns == clash.columns and drop_near_duplicates(clash).count() == 1
