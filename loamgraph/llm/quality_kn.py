"""Quality classification by an interpolated modified Kneser-Ney model of character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, text_or_empty

#: N-grams are packed into 64 bits, 16 a character, so the order is 4 at most.
ORDER = 4
#: A caller may bound the trusted documents that the model is fitted on to those with the least hashes of doc_id, and their
#: characters, of which the first document may have more; none is left out as it stands.
TRAIN_DOCS: int | None = None
TRAIN_CHARS: int | None = None
#: A task counts so many n-grams at a time.
COUNTED = 1 << 20
#: Characters that a model tells apart, the most frequent ones of the texts that it is fitted on; all others are one.
ALPHABET = (1 << 16) - 3
#: The share of the held-out trusted documents of a language that its threshold keeps.
KEPT_SHARE = 0.99
#: Characters of typical text that are added to each document, so that short ones aren't judged by chance.
PRIOR_CHARS = 50
#: Languages with fewer held-out trusted documents take the threshold of all of them.
LEAST_PER_LANG = 50
#: Ids of so many trusted documents at most, and thresholds of so many languages, are sent to where texts are read.
BROADCAST_IDS, BROADCAST_LANGS = 4_000_000, 20_000
#: Numbers of a character that isn't in the alphabet, and of what is before the first one.
OTHER, START = 1, 2
MASK = [0, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFFFFFF]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def packed_ngrams(text: str, alphabet: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram ending at each character: 16 low bits a character, the last one lowest. A character's number is its
    place in the sorted ``alphabet``, from 3 on."""
    points = code_points(text)
    at = np.minimum(np.searchsorted(alphabet, points), max(0, len(alphabet) - 1))
    known = alphabet[at] == points if len(alphabet) else np.zeros(len(points), bool)
    codes = np.where(known, at + 3, OTHER).astype(np.uint64)
    codes = np.concatenate([np.full(order - 1, START, np.uint64), codes])
    n = len(codes) - order + 1
    out = np.zeros(n, np.uint64)
    for i in range(order):
        out = (out << np.uint64(16)) | codes[i : i + n]
    return out


@dataclass
class Model:
    """Tables of each order k, in [k - 1]: sorted n-grams with their log probabilities, and sorted
    contexts with the log weights that they give to the order below."""

    ngrams: list[np.ndarray]
    log_p: list[np.ndarray]
    contexts: list[np.ndarray]
    log_weight: list[np.ndarray]
    log_unseen: float
    alphabet: np.ndarray
    typical: float = 0.0  #: mean log probability of a character of the texts fitted to

    def log_probs(self, text: str) -> np.ndarray:
        grams = packed_ngrams(text, self.alphabet, len(self.ngrams))
        out, todo, start = np.zeros(len(grams)), np.arange(len(grams)), np.zeros(len(grams))
        for k in range(len(self.ngrams), 0, -1):
            own = grams[todo] & np.uint64(MASK[k]) if k < len(MASK) else grams[todo]
            at = np.minimum(np.searchsorted(self.ngrams[k - 1], own), len(self.ngrams[k - 1]) - 1)
            hit = self.ngrams[k - 1][at] == own
            out[todo[hit]] = start[hit] + self.log_p[k - 1][at[hit]]
            todo, start, context = todo[~hit], start[~hit], own[~hit] >> np.uint64(16)
            at = np.minimum(np.searchsorted(self.contexts[k - 1], context), len(self.contexts[k - 1]) - 1)
            start = start + np.where(self.contexts[k - 1][at] == context, self.log_weight[k - 1][at], 0.0)
        out[todo] = start + self.log_unseen
        return out

    def perplexity(self, text: str) -> float:
        """Per character, with PRIOR_CHARS typical ones; infinite for the empty text, which shows no quality."""
        if not text:
            return float("inf")
        known = self.log_probs(text)
        return float(np.exp(-(known.sum() + PRIOR_CHARS * self.typical) / (len(known) + PRIOR_CHARS)))


def _tallied(parts: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct values of ``parts`` and how often each is there, by about COUNTED values; the first ones may come again."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= COUNTED:
            yield np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
    if size:
        yield np.unique(np.concatenate(held), return_counts=True)


def _alphabet(texts: DataFrame) -> np.ndarray:
    """The sorted code points of ``texts`` (text), the ALPHABET most frequent ones."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for points, n in _tallied(code_points(t.as_py()) for batch in batches for t in batch["text"]):
            yield pa.RecordBatch.from_arrays([pa.array(points.astype(np.int64)), pa.array(n)], ["point", "n"])

    counts = texts.mapInArrow(counted, "point long, n long").groupBy("point").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r.point for r in counts.orderBy(F.desc("n"), "point").limit(ALPHABET).collect()], np.uint32))


def _counts(texts: DataFrame, alphabet: np.ndarray, order: int) -> DataFrame:
    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _tallied(packed_ngrams(t.as_py(), alphabet, order) for batch in batches for t in batch["text"]):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["gram", "n"])

    return texts.mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2, 3 or more, from how many n-grams have counts 1 to 4."""
    n1, n2, n3, n4 = counts
    if not all(counts):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True)]


def _column(df: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    table = df.select(key, value).toArrow()
    keys, values = table[key].to_numpy().view(np.uint64), table[value].to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def train(texts: DataFrame, order: int = ORDER) -> Model:
    """Fit a model to all of ``texts`` (text), which are read twice, by joins of count tables.

    Counts of the highest order are those of the texts; lower orders count in how many contexts an
    n-gram continues. Each order's counts meet their contexts' sums and the order below by joins
    that shard both sides by the n-gram's hash.
    """
    alphabet = _alphabet(texts)
    tables = {order: cut(_counts(texts, alphabet, order))}
    for k in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit(MASK[k]))
        tables[k] = cut(tables[k + 1].groupBy(suffix.alias("gram")).agg(F.count("*").alias("n")))
    below, ngrams, log_p, contexts, log_weight = None, [], [], [], []
    size = tables[1].count() + 1
    if size == 1:
        none = np.array([np.uint64(0xFFFFFFFFFFFFFFFF)])
        return Model([none] * order, [np.zeros(1)] * order, [none] * order, [np.zeros(1)] * order, -np.log(2), alphabet)
    unseen = 0.0
    for k in range(1, order + 1):
        tally = tables[k].agg(*(F.count_if(F.col("n") == c).alias(f"n{c}") for c in (1, 2, 3, 4))).first()
        d = discounts(list(tally))
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        own = tables[k].withColumn("context", F.shiftrightunsigned("gram", 16)).withColumn("off", off)
        sums = own.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("weight"))
        joined = own.join(sums, "context").withColumn("direct", (F.col("n") - F.col("off")) / F.col("total"))
        if below is None:
            p = joined.withColumn("p", F.col("direct") + F.col("weight") / size)
            unseen = float(np.log(sums.first().weight / size))
        else:
            suffix = F.col("gram").bitwiseAND(F.lit(MASK[k - 1]))
            p = joined.join(below, suffix == F.col("lower")).withColumn("p", F.col("direct") + F.col("weight") * F.col("p_lower"))
        p = cut(p.select("gram", "p", "n"))
        below = p.select(F.col("gram").alias("lower"), F.col("p").alias("p_lower"))
        for keep_key, keep_value, (keys, values) in (
            (ngrams, log_p, _column(p, "gram", "p")),
            (contexts, log_weight, _column(sums, "context", "weight")),
        ):
            keep_key.append(keys)
            keep_value.append(np.log(values))
    typical = p.agg((F.sum(F.col("n") * F.log("p")) / F.sum("n")).alias("t")).first().t
    # the lowest order's weight is already part of what an unseen character gets
    log_weight[0] = np.zeros_like(log_weight[0])
    return Model(ngrams, log_p, contexts, log_weight, unseen, alphabet, typical)


def perplexity(model: Model, spark) -> Column:
    """A column for documents with ``text``: perplexity per character, infinite if null or empty."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([shared.value.perplexity(t) for t in texts], dtype=float)

    return scored(text_or_empty())


def _few(ids: DataFrame) -> DataFrame:
    """``ids`` with the hint that they are few where they are."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _bounded(texts: DataFrame, ids: DataFrame, train_docs: int | None) -> DataFrame:
    """The rows of ``texts`` of the least ``ids`` (doc_id, hash) within the bounds."""
    most_docs, most_chars = (2**62 if most is None else most for most in (train_docs, TRAIN_CHARS))
    chosen = ids if train_docs is None else ids.orderBy("hash", "doc_id").limit(train_docs)
    upto = Window.orderBy("hash", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)  # over what a caller has bounded
    rows = texts.join(chosen, "doc_id").withColumns({"_chars": F.sum(F.length("text")).over(upto), "_nth": F.count("*").over(upto)})
    return cut(rows.where((F.col("_nth") == 1) | (F.col("_nth") <= most_docs) & (F.col("_chars") <= most_chars)).select("text"))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int | None = TRAIN_DOCS) -> tuple[Model, DataFrame, float]:
    """The model, a table (lang, threshold) and the threshold for all other languages.

    Trusted are documents that ``labels`` (doc_id, quality) gives quality 1. All of one half of them, by hash,
    are for the model, unless ``train_docs`` bounds them; perplexities of all of the other half
    give each language's threshold, so that it holds for texts the model hasn't seen.
    """
    trusted = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .where("quality = 1")
        .withColumn("hash", F.xxhash64("doc_id"))
        .withColumn("for_model", F.col("hash") % 2 == 0)
    )
    spark, texts = docs.sparkSession, docs.select("doc_id", "lang", text_or_empty().alias("text"))
    chosen = cut(trusted.where("for_model").select("doc_id", "hash"))
    if train_docs is None and TRAIN_CHARS is None:
        model = train(texts.join(_few(chosen.select("doc_id")), "doc_id", "left_semi").select("text"))
    else:
        model = train(_bounded(texts, chosen, train_docs))
    ids = cut(trusted.where("not for_model").select("doc_id"))
    held = texts.where((F.xxhash64("doc_id") % 2 != 0) & (F.col("text") != "")).join(_few(ids), "doc_id", "left_semi")
    scores = cut(held.select("lang", perplexity(model, spark).alias("perplexity")))
    quantile = F.percentile_approx("perplexity", KEPT_SHARE, 10_000)
    overall = scores.agg(quantile.alias("q")).first().q
    per_lang = cut(
        scores.where("lang is not null")
        .groupBy("lang")
        .agg(quantile.alias("threshold"), F.count("*").alias("n"))
        .where(F.col("n") >= LEAST_PER_LANG)
        .select("lang", "threshold")
    )
    return model, per_lang, float("inf") if overall is None else overall


def _with_threshold(docs: DataFrame, per_lang: DataFrame, overall: float, name: str) -> DataFrame:
    few = per_lang.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS
    key = f"{name}_lang"
    known = per_lang.select(F.col("lang").alias(key), F.col("threshold").alias(name))
    joined = docs.join(F.broadcast(known) if few else known, F.col("lang") == F.col(key), "left").drop(key)
    return joined.withColumn(name, F.coalesce(name, F.lit(overall)))


def classify_quality(docs: DataFrame, labels: DataFrame, train_docs: int | None = TRAIN_DOCS) -> DataFrame:
    """(doc_id, perplexity, threshold, keep) of every row of ``docs`` (doc_id, text, lang, ...).

    keep: the perplexity per character isn't above its language's threshold. Empty and null texts
    have infinite perplexity and aren't kept. Null and rare languages take the threshold of all
    trusted documents; without trusted documents all texts that aren't empty are kept. Repeated
    rows and null ids are scored like any other; other columns are ignored.
    """
    model, per_lang, overall = fit(docs, labels, train_docs)
    rows = docs.select("doc_id", "lang", perplexity(model, docs.sparkSession).alias("perplexity"))
    keep = (F.col("perplexity") <= F.col("threshold")) & (F.col("perplexity") < float("inf"))
    return _with_threshold(rows, per_lang, overall, "threshold").select("doc_id", "perplexity", "threshold", keep.alias("keep"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, train_docs: int | None = TRAIN_DOCS) -> DataFrame:
    """``docs``, all columns as they are, without the rows that ``classify_quality`` doesn't keep."""
    model, per_lang, overall = fit(docs, labels, train_docs)
    threshold, score = "__quality_threshold", perplexity(model, docs.sparkSession)
    while {threshold, f"{threshold}_lang"} & {c.lower() for c in docs.columns}:
        threshold += "_"
    rows = _with_threshold(docs, per_lang, overall, threshold)
    return rows.where((score <= F.col(threshold)) & (text_or_empty() != "")).drop(threshold)
