import math
import random
from collections import Counter

import pytest
from loamgraph.llm import lm_scoring
from loamgraph.llm.lm_scoring import stupid_backoff


def tokens(text):
    return (text or "").encode().lower().split()


def grams(words, order):
    return Counter(tuple(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1))


def brute(docs, counted=None, order=3, alpha=0.4):
    """Each word by the longest n-gram that is in the other documents, looked up one after the other."""
    everything = Counter()
    for t in (t for _, t in docs) if counted is None else counted:
        everything.update(grams(tokens(t), order))
    out = []
    for i, text in docs:
        words, known = tokens(text), Counter(everything)
        if counted is None:
            known.subtract(grams(words, order))
        total = sum(n for g, n in known.items() if len(g) == 1)
        sum_ = 0.0
        for at in range(len(words)):
            longest = min(order, at + 1)
            for k in range(longest, 1, -1):
                gram = tuple(words[at - k + 1 : at + 1])
                if known[gram]:
                    sum_ += (longest - k) * math.log(alpha) + math.log(known[gram] / known[gram[:-1]])
                    break
            else:
                n = known[tuple(words[at : at + 1])]
                sum_ += (longest - 1) * math.log(alpha) + math.log(n / total if n else 1 / (total + 1))
        out.append((i, len(words), round(sum_, 6) + 0.0, round(sum_ / len(words), 6) + 0.0 if words else None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_tokens, round(r.log_score, 6) + 0.0, r.score if r.score is None else round(r.score, 6) + 0.0) for r in df.collect()), key=repr)


def texts(seed, n=150):
    rng = random.Random(seed)
    rare = [f"w{i}" for i in range(300)]
    pick = lambda: rng.choice(["the", "of", "The", rng.choice(rare)])
    made = [rng.choice([" ", "\n"]).join(pick() for _ in range(rng.choice([1, 2, 3, 30]))) for _ in range(n)]
    return [*made, "", None, " \t", "the of " * 3000, "of of of of", "of of of of", made[0], made[0]]


@pytest.mark.parametrize("hot_share", [0.0005, 0.05, 0.25, 1e9])
def test_own_counts_against_brute_force(documents, monkeypatch, hot_share):
    monkeypatch.setattr(lm_scoring, "HOT_SHARE", hot_share)
    rows = texts(1)
    assert rows_of(stupid_backoff(documents(rows))) == brute(list(enumerate(rows)))


@pytest.mark.parametrize("order", [2, 3, 4, 5])
@pytest.mark.parametrize("hot_share", [0.01, 1e9])
def test_other_counts_against_brute_force(documents, monkeypatch, hot_share, order):
    monkeypatch.setattr(lm_scoring, "HOT_SHARE", hot_share)
    rows, other = texts(2, 60), texts(3, 60)
    assert rows_of(stupid_backoff(documents(rows), documents(other), order)) == brute(list(enumerate(rows)), other, order)


def test_orders_on_own_counts(documents):
    rows = texts(5, 60)
    for order in (2, 4):
        assert rows_of(stupid_backoff(documents(rows), order=order)) == brute(list(enumerate(rows)), order=order)


def test_factor_matters(documents):
    rows = texts(6, 60)
    assert rows_of(stupid_backoff(documents(rows), alpha=0.1)) == brute(list(enumerate(rows)), alpha=0.1)
    assert brute(list(enumerate(rows)), alpha=0.1) != brute(list(enumerate(rows)))


def test_small_chunks(documents, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 50)
    monkeypatch.setattr(lm_scoring, "LARGEST", 1000)
    monkeypatch.setattr(lm_scoring, "CHUNK_ROWS", 7)
    rows = [*texts(4), "x" * 5000, "a " + "y" * 3000 + " a", "x" * 5000]
    assert rows_of(stupid_backoff(documents(rows))) == brute(list(enumerate(rows)))


def test_texts_that_are_there_twice_score_high(documents):
    rows = [" ".join(f"{i}-{j}" for j in range(50)) for i in range(20)]
    scores = {r.doc_id: r.score for r in stupid_backoff(documents([*rows, rows[3]])).collect()}
    assert scores[3] == scores[20] and scores[3] > max(s for i, s in scores.items() if i not in (3, 20)) + 3


def test_odd_tables(spark, documents):
    assert stupid_backoff(documents([])).count() == 0
    rows = ["a", None, "a", "b b"]
    want = brute(list(zip([None, None, 5, 5], rows, strict=True)))
    assert rows_of(stupid_backoff(documents(rows, [None, None, 5, 5]))) == want
    assert rows_of(stupid_backoff(documents(["a b"]), documents([]))) == [(0, 2, round(math.log(0.4), 6), round(math.log(0.4) / 2, 6))]
    clash = spark.createDataFrame([(1, "a b", 2, "x")], "doc_id long, text string, row int, first string")
    assert stupid_backoff(clash).columns == ["doc_id", "n_tokens", "log_score", "score"]
