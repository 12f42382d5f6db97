import random
import re
from collections import Counter

from loamgraph.llm.license_scan import LEAST_SCORE, TEMPLATES, license_digest, license_word_idf, scan_licenses, words_of

PHRASES = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for label, p in PHRASES.items() for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(words), len(places), min(starts, default=None), max(starts, default=None), labels


def test_base_places_against_brute_force(documents):
    rng = random.Random(2)
    bag = ["cc", "BY", "by", "General", "public", "license", "all", "rights", "reserved", "é", "x"]
    texts = ["", None, "É à ÀÉ", "CC-BY", "cc\nby cc by.by", "all rights reserved " * 4000]
    texts += [rng.choice([" ", "-", ", "]).join(rng.choices(bag, k=rng.randrange(30))) for _ in range(300)]
    got = {r.doc_id: r for r in license_digest(scan_licenses(documents(texts))).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text
        assert set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} and 0 <= r.score <= 1
        assert r.score == 1 or not r.n_base


def test_labels_of_the_method(documents):
    texts = [
        "x This work is licensed under the GNU General Public License, version 3. y",
        "Released under the MIT License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under the Apache License, Version 2.0.",
        "the apache license of versions; mit and license; general license public",
        "Permission is hereby granted, free of charge, to any person",
    ]
    got = {r.doc_id: r for r in license_digest(scan_licenses(documents(texts))).collect()}
    assert [got[i].labels for i in range(6)] == ["gpl,gpl-3.0", "mit", "cc-by,cc-by-nc", "apache-2.0", "", "mit"]
    assert got[4].score == 0 and 0.5 <= got[5].score < 1


def brute_matches(words, idf, templates, least):
    """Every template at every start, word by word."""
    out = set()
    for t in templates:
        want = words_of(t.text)
        for start in range(-len(want), len(words)):
            there = [0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(want)]
            keys = [(next(i for i in range(len(want)) if want[i : i + len(k)] == k), k) for k in map(words_of, t.keys)]
            if not all(all(there[i : i + len(k)]) for i, k in keys):
                continue
            score = sum(idf[w] for w, hit in zip(want, there, strict=True) if hit) / sum(idf[w] for w in want)
            if min(score, 1.0) >= least:
                hits = [start + i for i, hit in enumerate(there) if hit]
                out.add((t.label, hits[0], hits[-1] + 1, round(min(score, 1.0), 9), t.base))
    return out


def test_labels_and_scores_against_brute_force(documents):
    rng = random.Random(7)
    texts = []
    for _ in range(120):
        words = []
        for _ in range(rng.randrange(4)):
            part = words_of(rng.choice(TEMPLATES).text)
            cut = rng.choice([0, 0, rng.randrange(len(part))])
            part = part[cut:] if rng.random() < 0.5 else part[: len(part) - cut]
            for _ in range(rng.choice([0, 0, 1, 3])):
                part[rng.randrange(len(part))] = rng.choice([b"x", b"license", b"software"])
            words += part + rng.choices([b"the", b"of", b"filler"], k=rng.randrange(4))
        texts.append(b" ".join(words).decode())
    texts += ["", None, "the software " * 3000 + TEMPLATES[-1].text]
    docs = documents(texts)
    idf, seen = license_word_idf(docs), Counter()
    scanned = {r.doc_id: r for r in scan_licenses(docs).collect()}
    digests = {r.doc_id: r for r in license_digest(scan_licenses(docs)).collect()}
    for i, text in enumerate(texts):
        want = brute_matches(words_of(text or ""), idf, TEMPLATES, LEAST_SCORE)
        assert {(m.label, m.start, m.stop, round(m.score, 9), m.base) for m in scanned[i].matches} == want
        assert digests[i].labels == ",".join(sorted({m[0] for m in want})) and round(digests[i].score, 9) == max((m[3] for m in want), default=0)
        seen.update(m[0] for m in want)
    assert len(seen) > 8 and seen["mit"] > 5


def test_idf_covers_all_rows(documents):
    idf = license_word_idf(documents(["license license"] * 8 + ["mit"]))
    assert idf[b"license"] < idf[b"mit"] < idf[b"apache"]


def test_odd_tables(spark, documents):
    assert license_digest(scan_licenses(documents([]))).count() == 0
    rows = license_digest(scan_licenses(documents(["cc by", "cc by"], [None, None]))).collect()
    assert [(r.doc_id, r.n_base) for r in rows] == [(None, 1)] * 2
    clash = spark.createDataFrame([(1, "cc by", 3, "z")], "doc_id long, text string, n_words int, matches string")
    assert license_digest(scan_licenses(clash)).first().n_base == 1
