"""Toxicity by multiple-instance learning: sentence scores, noisy-or per document."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, text_or_empty

#: About so many labelled documents, and so many of their characters, are fitted by one task; a model is the mean of all tasks' ones.
TRAIN_DOCS, TRAIN_CHARS = 6000, 40_000_000
#: Documents of either label that a task has at least on average, even if it then has more in all.
LEAST_LABEL = 50
#: Features that a model has at most: those that tell the labels of all documents apart best.
FEATURES = 2000
#: Features in fewer documents than this are passed over.
LEAST_DOCS = 4
#: Labels of so many documents at most are sent to where texts are read.
BROADCAST_IDS = 4_000_000
STEPS, RATE, L1, FIRST_BIAS = 300, 0.1, 3e-5, -6.0
#: Words whose weight a worker remembers; it starts anew beyond them.
REMEMBERED = 1 << 19
#: Words whose features a worker remembers while it learns.
FEW_WORDS = 1 << 16
#: Features of documents that a worker counts at once.
COUNTED = 1 << 21
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: The same words, much faster, where there is nothing of ``OTHER``.
RUN = re.compile(r"\w+")
OTHER = re.compile(r"[\d_]")


def words_of(text: str) -> Callable[[str], list[str]]:
    """What finds the words of lower-cased parts of ``text``."""
    return (WORD if OTHER.search(text) else RUN).findall


def features(word: str) -> list[int]:
    """Numbers of a word's features: the word, and its beginnings of two to six letters."""
    return [zlib.crc32(x.encode()) for x in (f"{word}$", *(word[:k] for k in range(2, min(len(word), 7))))]


class Remembered(dict):
    """Values of words, each computed when it is first asked for; beyond ``most`` it starts anew."""

    def __init__(self, value: Callable[[str], object], most: int):
        super().__init__()
        self.value, self.most = value, most

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        found = self[word] = self.value(word)
        return found


@dataclass
class Model:
    """Weights of features; a sentence's score is the logistic of the bias and the weights of its
    distinct words' features."""

    bias: float
    weights: dict[int, float]
    _known: Remembered | None = field(default=None, repr=False, compare=False)

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and its sentences as start, stop, score. No sentence scores 0."""
        if self._known is None:
            self._known = Remembered(self.word_weight, REMEMBERED)
        weight, words = self._known.__getitem__, words_of(text)
        spans = [(*m.span(), sum(map(weight, set(words(m[0].lower()))))) for m in SENTENCE.finditer(text)]
        if not spans:
            return 0.0, []
        logits = self.bias + np.array([s[2] for s in spans])
        clean = -np.logaddexp(0, logits)  # log of 1 - score
        marks = -np.expm1(clean)
        return float(-np.expm1(clean.sum())), [(i, j, p) for (i, j, _), p in zip(spans, marks.tolist(), strict=True)]


def fit_noisy_or(bags: list[list[np.ndarray]], labels: np.ndarray, chosen: np.ndarray) -> Model:
    """Fit weights of the ``chosen`` features to document labels: Adam on the noisy-or likelihood.

    bags: per document its sentences, each an array of feature numbers, all of them chosen ones.
    """
    chosen = np.sort(chosen)
    return _fit([Counter(np.sort(np.searchsorted(chosen, s)).astype("<i4").tobytes() for s in bag) for bag in bags], labels, chosen)


def _fit(bags: list[dict[bytes, int]], labels: np.ndarray, chosen: np.ndarray) -> Model:
    """``fit_noisy_or`` of sentences as places in the sorted ``chosen`` and how often a document has them. Sentences of the
    same features, most of all those without any, have one score: it is computed once, however many documents have them."""
    kept = [(bag, y) for bag, y in zip(bags, labels, strict=True) if bag]
    y = np.array([label for _, label in kept], float)
    if not len(chosen) or len(set(y)) < 2:
        share = float(np.mean(labels)) if len(labels) else 0.0
        return Model(float(np.log((share + 1e-3) / (1 - share + 1e-3))), {})
    numbers: dict[bytes, int] = {}
    which = np.array([numbers.setdefault(s, len(numbers)) for bag, _ in kept for s in bag])
    times = np.array([n for bag, _ in kept for n in bag.values()], float)
    place = np.frombuffer(b"".join(numbers), "<i4").astype(np.intp)
    owner = np.repeat(np.arange(len(numbers)), [len(s) // 4 for s in numbers])
    sizes = [len(bag) for bag, _ in kept]
    starts, of_doc = np.cumsum([0, *sizes])[:-1], np.repeat(np.arange(len(kept)), sizes)

    params = np.append(np.zeros(len(chosen)), FIRST_BIAS)
    mean, var = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        logits = params[-1] + np.bincount(owner, params[place], len(numbers))
        clean = np.add.reduceat(-np.logaddexp(0, logits)[which] * times, starts)
        toxic = np.maximum(-np.expm1(clean), 1e-9)
        asked = np.where(y > 0, -np.exp(clean) / toxic, 1.0)[of_doc] * times
        pull = np.bincount(which, asked, len(numbers)) / (1 + np.exp(-logits)) / len(y)
        grad = np.append(np.bincount(place, pull[owner], len(chosen)) + L1 * np.sign(params[:-1]), pull.sum())
        mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
        params -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-8)
    return Model(float(params[-1]), {int(f): float(v) for f, v in zip(chosen, params, strict=False)})


def choose_features(marked: DataFrame, most: int = FEATURES) -> np.ndarray:
    """Numbers of the ``most`` features whose document frequencies differ most, in standard
    deviations, between the toxic and the other documents of ``marked`` (text, toxic)."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Remembered(lambda word: array("I", features(word)).tobytes(), FEW_WORDS)
        parts, labels, n = [], [], 0
        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"].to_pylist(), strict=True):
                text = text.as_py()
                parts.append(b"".join(map(own.__getitem__, set(words_of(text)(text.lower())))))
                labels.append(label)
                n += len(parts[-1]) // 4
                if n >= COUNTED:
                    yield told(parts, labels)
                    parts, labels, n = [], [], 0
        yield told(parts, labels)

    def told(parts: list[bytes], labels: list[int]) -> pa.RecordBatch:
        """(feature, n, n_toxic): a feature counts once for a document; it has a row for each label."""
        doc = np.repeat(np.arange(len(parts)), [len(p) // 4 for p in parts])
        pairs = np.unique(doc << 32 | np.frombuffer(b"".join(parts), np.uintc).astype(np.int64))
        toxic = np.array(labels, np.int64)[pairs >> 32]
        rows, n = np.unique((pairs & 0xFFFFFFFF) << 1 | toxic, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(rows >> 1), pa.array(n), pa.array(n * (rows & 1))], ["feature", "n", "n_toxic"])

    totals = marked.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    if not 0 < totals.t < totals.n:
        return np.zeros(0, np.int64)
    n, t = float(totals.n), float(totals.t)
    share = F.col("n") / n
    apart = F.col("n_toxic") / t - (F.col("n") - F.col("n_toxic")) / (n - t)
    score = F.abs(apart) / F.sqrt(share * (1 - share) * (1 / t + 1 / (n - t)) + 1e-12)
    rows = (
        marked.mapInArrow(counted, "feature long, n long, n_toxic long")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
        .where(F.col("n") >= LEAST_DOCS)
        .orderBy(score.desc(), "feature")
        .limit(most)
        .collect()
    )
    return np.array([r.feature for r in rows], np.int64)


def _shards(marked: DataFrame, train_docs: int) -> tuple[int, int, int]:
    """How many tasks fit ``marked`` (text, toxic), how many documents there are, and how many toxic ones."""
    sums = marked.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("chars")).first()
    wanted = max(-(-sums.n // train_docs), -(-sums.chars // TRAIN_CHARS))
    return max(1, min(wanted, min(sums.t, sums.n - sums.t) // LEAST_LABEL)), sums.n, sums.t


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit a model to all documents of ``docs`` (doc_id, text) that ``labels``
    (doc_id, toxic) marks. Null ids and labels are passed over; a repeated id is toxic if any row is.

    Features are chosen over all of them. Documents are dealt by their text to shards of about ``train_docs``; a task fits
    a shard, and the model is the mean of the shards' parameters, weighted by their documents (parameter mixing).
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    few = marks.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marked = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(marks) if few else marks, "doc_id").select("text", "toxic")
    n_shards, n, toxic = _shards(marked, train_docs)
    chosen = choose_features(marked)
    if not len(chosen):
        return fit_noisy_or([[]] * min(n, 1), np.array([toxic / n] if n else []), chosen)

    chosen = np.sort(chosen)

    def bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {int(f): i for i, f in enumerate(chosen)}
        own = Remembered(lambda word: [place[f] for f in features(word) if f in place], FEW_WORDS)
        for batch in batches:
            sentences, times = [], []
            for text in batch["text"]:
                text = text.as_py()
                words = words_of(text)
                bag = Counter(tuple(sorted(chain.from_iterable(map(own.__getitem__, set(words(s.lower())))))) for s in SENTENCE.findall(text))
                bag = sorted(bag.items())
                sentences.append([np.array(s, "<i4").tobytes() for s, _ in bag])
                times.append([n for _, n in bag])
            columns = [batch["shard"], batch["toxic"], pa.array(sentences, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "toxic", "sentences", "times"])

    def fitted(rows: pa.Table) -> pa.Table:
        """(shard, n, bias, weights) of one shard's rows."""
        ordered = sorted(zip(rows["sentences"].to_pylist(), rows["times"].to_pylist(), rows["toxic"].to_pylist(), strict=True))
        model = _fit([dict(zip(s, n, strict=True)) for s, n, _ in ordered], np.array([t for *_, t in ordered]), chosen)
        weights = [model.weights.get(int(f), 0.0) for f in chosen]
        return pa.table({"shard": rows["shard"][:1], "n": [rows.num_rows], "bias": [model.bias], "weights": [weights]})

    dealt = marked.select(F.pmod(F.xxhash64("text"), F.lit(n_shards)).cast("int").alias("shard"), "toxic", "text")
    rows = dealt.mapInArrow(bags, "shard int, toxic int, sentences array<binary>, times array<int>")
    parts = cut(rows.groupBy("shard").applyInArrow(fitted, "shard int, n long, bias double, weights array<double>"))
    each = parts.select("shard", F.posexplode(F.concat("weights", F.array("bias"))).alias("at", "value"), "n")
    # in the shards' order, as sums of floating-point numbers depend on it
    ordered = F.array_sort(F.collect_list(F.struct("shard", "value", "n")))
    total = F.aggregate(ordered, F.lit(0.0), lambda sum_, x: sum_ + x["value"] * x["n"])
    means = [r.mean for r in each.groupBy("at").agg((total / F.sum("n")).alias("mean")).orderBy("at").collect()]
    return Model(means[-1], {int(f): w for f, w in zip(chosen, means[:-1], strict=True)})


def toxicity(model: Model, spans: bool = False) -> Column:
    """A column for documents with ``text``: the score, or a struct of score and the sentences that
    reach one half, as start, stop (in characters), score. A null text is empty and scores 0."""
    span = T.StructType().add("start", T.IntegerType()).add("stop", T.IntegerType()).add("score", T.DoubleType())
    located = T.StructType().add("score", T.DoubleType()).add("sentences", T.ArrayType(span))

    def with_spans(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            done = [model.score(t) for t in texts]
            found = [[{"start": i, "stop": j, "score": p} for i, j, p in s if p >= 0.5] for _, s in done]
            yield pd.DataFrame({"score": [d[0] for d in done], "sentences": found})

    def alone(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([model.score(t)[0] for t in texts], dtype=float)

    return (F.pandas_udf(with_spans, located) if spans else F.pandas_udf(alone, T.DoubleType()))(text_or_empty())


def held_out() -> Column:
    """Rows that no label is learnt from: crc32 of the doc_id's text is divisible by five."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted, sentences) for every row of ``docs`` (doc_id, text, ...).

    The model is fitted to rows that aren't held out; predicted is 1 where the score is one half or
    more; sentences are those that score one half or more by themselves, as start, stop (in characters), score. Texts are
    the only input of a score: equal texts have equal scores, empty and null ones 0. A text of any length is scored whole.
    Repeated rows and null ids stay (a null id isn't held out); no labels give one base score to all sentences; no rows
    give no rows; other columns are ignored.
    """
    model = train(docs.where(~held_out()), labels.where(~held_out()), train_docs)
    rows = docs.select("doc_id", held_out().alias("held_out"), toxicity(model, spans=True).alias("located"))
    return rows.select("doc_id", "held_out", "located.score", (F.col("located.score") >= 0.5).cast("int").alias("predicted"), "located.sentences")


def drop_toxic(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``docs``, all columns, without the documents that score one half or more."""
    model = train(docs.where(~held_out()), labels.where(~held_out()), train_docs)
    return docs.where(toxicity(model) < 0.5)
