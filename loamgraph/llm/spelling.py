"""Spelling variants by a variable-length gram index: grams are pruned by frequency, words are decomposed into the grams
that are left, and how many of these one edit can affect tells which lists have to be merged."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words have so many code points, and occurrences, at least.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One run in DAMAGE, by its hash, loses a code point.
DAMAGE = 31
#: A form has at least so many times the occurrences of its variant.
RATIO = 10
#: Lengths of grams.
SHORTEST, LONGEST = 2, 5
#: Grams of more words than this are frequent: they go on to longer grams, and lists of longer ones aren't merged.
FREQUENT = 64
#: Frequent grams that are told to all tasks; if there are more, only the more frequent ones are, and grams stay shorter.
MOST_GRAMS = 400_000


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the distinct words of ``docs`` (doc_id, text) and their occurrences. Runs of letters in lower case; of
    those whose hash says so a code point is left out. Counts combine before the shuffle."""
    # a run shorter than a word can't become one: the expression passes over it
    runs = F.regexp_extract_all(text_or_empty(), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    rows = rows.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % DAMAGE == 0, damaged).otherwise(F.col("run"))
    counts = rows.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def frequent_grams(vocabulary: DataFrame, frequent: int = FREQUENT, most: int = MOST_GRAMS) -> dict[str, int]:
    """The grams that more than ``frequent`` words have, with how many; all that begin one are among them. Of more than
    ``most``, those of more words, by powers of two, so that what is sent to tasks is bounded."""
    length = F.length("word")
    grams = F.flatten(F.transform(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda q: F.transform(F.sequence(F.lit(1), length - q + 1), lambda p: F.col("word").substr(p, q))))
    counts = vocabulary.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    counts = cut(counts.where(F.col("n") > frequent))
    steps = {r.step: r.of for r in counts.groupBy(F.floor(F.log2("n")).alias("step")).agg(F.count("*").alias("of")).collect()}
    least, total = frequent, 0
    for step in sorted(steps, reverse=True):
        total += steps[step]
        if total > most:
            least = max(frequent, (1 << (step + 1)) - 1)
            break
    kept = counts.where(F.col("n") > least).toArrow()
    return dict(zip(kept["gram"].to_pylist(), kept["n"].to_pylist(), strict=True))


class Grams:
    """Decomposition of words into variable-length grams under a set of frequent ones."""

    def __init__(self, frequent: dict[str, int]):
        self.frequent = frequent
        #: What a gram has behind its first code points: only such a beginning of what follows an edit can be swallowed.
        self.tails = {g[i:] for g in frequent for i in range(1, len(g) - SHORTEST + 1)}

    def of(self, word: str) -> list[tuple[int, str]]:
        """The grams (place, gram) of a word: from each place on the shortest gram that isn't frequent, or the longest
        there is, but none that lies within an earlier one."""
        out, reached = [], 0
        for p in range(len(word) - SHORTEST + 1):
            q = SHORTEST
            while q < LONGEST and p + q < len(word) and word[p : p + q] in self.frequent:
                q += 1
            if p + q > reached:
                out.append((p, word[p : p + q]))
                reached = p + q
        return out

    def _swallowed(self, start: str) -> bool:
        """Whether a gram that begins in or before an edit may end behind ``start``, what follows the edit: it would
        be a frequent gram and one more code point, so its last but one is the end of a frequent gram."""
        return len(start) <= SHORTEST or start[:-1] in self.tails

    def kept(self, word: str, grams: list[tuple[int, str]]) -> int:
        """How many of a word's grams a word one edit away has too, at least.

        An edit of code point i, or between i - 1 and i, affects the grams that hold it; those that end right before it
        and are frequent, as they go on to a longer one; and those behind it that a gram from before may swallow.
        """
        worst = 0
        for i in range(len(word) + 1):
            for behind in ((i,) if i == len(word) else (i, i + 1)):
                affected = 0
                for p, gram in grams:
                    end = p + len(gram)
                    if end <= i:
                        affected += end == i and len(gram) < LONGEST and gram in self.frequent
                    elif p >= behind:
                        affected += end - behind < LONGEST and self._swallowed(word[behind:end])
                    else:
                        affected += 1
                worst = max(worst, affected)
        return len(grams) - worst

    def signature(self, word: str) -> tuple[list[tuple[int, str]], bool]:
        """The places and grams of the lists to be merged: the rarest, so many that a word one edit away has one of them.
        And whether lists don't tell all: where an edit may affect all grams, or where one of the lists is long."""
        grams = self.of(word)
        kept = self.kept(word, grams)
        left, chosen = len(grams) - max(1, kept) + 1, set()
        for gram in sorted({g for _, g in grams}, key=lambda g: (self.frequent.get(g, 0), g)):
            if left <= 0:
                break
            chosen.add(gram)
            left -= sum(g == gram for _, g in grams)
        return [(p, g) for p, g in grams if g in chosen and g not in self.frequent], kept < 1 or any(g in self.frequent for g in chosen)


def decomposed(vocabulary: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """(word, n, at, gram): the lists of each word of ``vocabulary`` (word, n), and a row in which at and gram are null where
    lists don't tell all."""
    known = vocabulary.sparkSession.sparkContext.broadcast(frequent)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(known.value)
        for batch in batches:
            out = [[], [], [], []]
            for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True):
                listed, more = grams.signature(word)
                for at, gram in [*listed, *[(None, None)] * more]:
                    for column, value in zip(out, (word, n, at, gram), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["word", "n", "at", "gram"])

    return vocabulary.select("word", "n").mapInArrow(read, "word string, n long, at int, gram string")


def _pairs(rows: DataFrame, keys: list[str], also: Column | None = None) -> DataFrame:
    """Pairs (a, n_a, b, n_b), a < b, of words that meet in a key and are one edit apart."""
    left, right = (rows.select(*keys, *(F.col(c).alias(f"{c}_{end}") for c in rows.columns if c not in keys)) for end in "ab")
    close = (F.abs(F.length("word_a") - F.length("word_b")) <= 1) & (F.col("word_a") < F.col("word_b"))
    met = left.join(right, keys).where(close if also is None else close & also)
    near = met.where(F.levenshtein("word_a", "word_b", 1) == 1)
    return near.select(F.col("word_a").alias("a"), F.col("n_a"), F.col("word_b").alias("b"), F.col("n_b"))


def near_pairs(vocabulary: DataFrame, frequent: int = FREQUENT, most: int = MOST_GRAMS) -> DataFrame:
    """(a, n_a, b, n_b): pairs of words of ``vocabulary`` (word, n), a < b, one inserted, deleted or replaced code point apart.

    Words meet in lists of grams at places that differ by one at most. Those of which lists don't tell all, because one edit
    may affect all their grams or because one of their lists is longer than ``frequent``, also meet by what is left of them
    without a code point, and by themselves; there are no more than some thousand words one edit away from any.
    """
    lists = cut(decomposed(vocabulary, frequent_grams(vocabulary, frequent, most)))
    posts = lists.where("gram is not null")
    # no list is longer than the least count of what all tasks were told, but that may be above what is merged
    sized = cut(posts.withColumn("of", F.count("*").over(Window.partitionBy("gram"))))
    short = sized.where(F.col("of") <= 2 * frequent).drop("of")
    merged = _pairs(short, ["gram"], F.abs(F.col("at_a") - F.col("at_b")) <= 1)

    rest = lists.where("gram is null").select("word", "n").unionByName(sized.where(F.col("of") > 2 * frequent).select("word", "n").distinct())
    spots = F.sequence(F.lit(1), F.length("word"))
    without = F.transform(spots, lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))
    keyed = rest.select("word", "n", F.explode(F.array_distinct(F.concat(F.array("word"), without))).alias("key")).withColumn("key", F.xxhash64("key"))
    return merged.unionByName(_pairs(keyed, ["key"])).distinct()


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``docs`` (doc_id, text, ...).

    Words are runs of letters (A-Z and a-z, and U+00C0 to U+00FF) in lower case (A-Z only) with seven code points or more
    and two occurrences or more over all texts; a run whose CRC-32 with its doc_id is a multiple of 31 is counted without
    the code point that the CRC picks. n_near is the number of words one edit away; form the most frequent of them, the
    first in code-point order among equals, if it has ten times the occurrences, and form_n how many; root the last
    of the forms that follow each other, the word itself if it has none.

    Null and empty texts have no words, a null doc_id stands as empty text, repeated rows count again, other columns are
    ignored, and no words give no rows.
    """
    vocabulary = cut(words(docs))
    pairs = cut(near_pairs(vocabulary))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("word")))
    near = both.groupBy("a").agg(F.count("*").alias("n_near"), best.alias("best"), F.first("n_a").alias("n"))
    formed = F.when(-F.col("best.less") >= RATIO * F.col("n"), F.col("best"))
    near = cut(near.select(F.col("a").alias("word"), "n_near", formed.alias("best")))

    # a form has ten times the occurrences, so chains are short; each round follows twice as many links
    roots = near.where("best is not null").select("word", F.col("best.word").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        followed = cut(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        roots = followed.drop("moved")
        if not followed.where("moved").limit(1).count():
            break
    rows = vocabulary.join(near, "word", "left").join(roots, "word", "left")
    return rows.select(
        "word", F.col("best.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("best.less")).alias("form_n")
    )
