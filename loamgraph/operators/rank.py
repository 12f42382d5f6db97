"""Lexical ranking of nodes and documents, retrieval metrics and what lies behind losses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions import text as tx
from loamgraph.operators.shared import cut


def lexical_scores(candidates: DataFrame) -> DataFrame:
    """Adds score to ``candidates`` (query, name, content, ...)."""
    q, name, content = (tx.token_set(F.col(c)) for c in ("query", "name", "content"))
    return candidates.withColumns({"_q": q, "_n": name, "_c": content}).withColumn("score", tx.overlap_score(F.col("_q"), F.col("_n"), F.col("_c"))).drop("_q", "_n", "_c")


def lexical_search(queries: DataFrame, texts: DataFrame, title: str | None = None) -> DataFrame:
    """(query_id, id, score) for all pairs that share a word: ``queries`` (query_id, query), ``texts``
    (id, text, and a title column if named).

    Only words that a query has are exploded, and postings meet by word, so no pair without a word in
    common is formed; partial sums are taken before they are shuffled.
    """
    q = queries.select("query_id", tx.token_set(F.col("query")).alias("words")).where("size(words) > 0")
    terms = q.select("query_id", F.size("words").alias("n"), F.explode("words").alias("term"))
    vocabulary = terms.select("term").distinct()
    weights = [("text", 1)] + ([(title, 2)] if title else [])
    parts = [
        texts.select("id", F.explode(tx.token_set(F.col(c))).alias("term")).join(vocabulary, "term", "left_semi").withColumn("weight", F.lit(w))
        for c, w in weights
    ]
    found = reduce(DataFrame.unionAll, parts)
    return found.join(terms, "term").groupBy("query_id", "id").agg((F.sum("weight") / F.first("n")).alias("score"))


#: Texts that a query's first bound is taken from: so many of each of its rarest words, and so many in all, times the best asked for.
SEEDS = 4


def best_texts(queries: DataFrame, texts: DataFrame, top: int, title: str | None = None) -> DataFrame:
    """(query_id, id, score) of the ``top`` best of ``lexical_search`` for each query, ties by id, without forming the other pairs.

    A query's words are put in order of how many texts have them. A text whose rarest shared word stands at some place scores no more
    than all words from there on could give. So a few texts of the rarest words are scored first; the last of the best of those bounds
    the rest: postings of words from which on the bound can't be reached, the frequent ones, are never joined, and a text goes
    further only if what it has of the others, with all of those, reaches the bound. What is left is scored by its whole set of words. ``top`` beyond what a query's first texts give
    leaves no bound, and all its postings are joined.
    """
    q = queries.select("query_id", tx.token_set(F.col("query")).alias("words")).where("size(words) > 0")
    q = cut(q.groupBy("query_id").agg(F.min("words").alias("words")))
    terms = q.select("query_id", F.explode("words").alias("term"))
    vocabulary = terms.select("term").distinct()
    held = texts.select("id", tx.token_set(F.col("text")).alias("text"), (tx.token_set(F.col(title)) if title else F.array().cast("array<string>")).alias("title"))
    weighed = held.select("id", F.explode(F.array_union("text", "title")).alias("term"), "text", "title").select(
        "id", "term", (F.array_contains("text", F.col("term")).cast("int") + 2 * F.array_contains("title", F.col("term")).cast("int")).alias("weight")
    ) if title else held.select("id", F.explode("text").alias("term"), F.lit(1).alias("weight"))
    # rows per text, written once: its words that queries have, by weight
    words = cut(weighed.join(vocabulary, "term", "left_semi").groupBy("id").agg(F.collect_list(F.struct("term", "weight")).alias("terms")))
    postings = words.select("id", F.inline("terms"))
    sizes = postings.groupBy("term").agg(F.count("*").alias("held"), F.max("weight").alias("most"))
    rarest = Window.partitionBy("query_id").orderBy("held", "term")
    rest = Window.partitionBy("query_id").orderBy(F.desc("held"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    before = F.coalesce(F.sum("held").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cut(terms.join(sizes, "term").select("query_id", "term", F.sum("most").over(rest).alias("bound"), before.alias("before")))
    first = postings.withColumn("_nth", F.row_number().over(Window.partitionBy("term").orderBy("id"))).where(F.col("_nth") <= SEEDS * top)
    seeds = placed.where(F.col("before") < SEEDS * top).join(first, "term").select("query_id", "id").distinct()

    def scored(pairs: DataFrame) -> DataFrame:
        shared = [w * F.size(F.array_intersect("words", F.filter("terms", lambda t: t["weight"] == w)["term"])) for w in ((1, 2, 3) if title else (1,))]  # noqa: B023
        total = reduce(lambda a, b: a + b, shared).cast("long")
        return pairs.join(words, "id").join(q, "query_id").select("query_id", "id", total.alias("total"), F.size("words").alias("n"))

    best = Window.partitionBy("query_id").orderBy(F.desc("total"), "id")
    known = cut(scored(seeds).withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= top))
    last = known.where(F.col("_nth") == top).select("query_id", F.col("total").alias("least"), F.col("id").alias("last"))
    bounded = placed.join(last, "query_id", "left").withColumn("asked", F.col("least").isNull() | (F.col("bound") >= F.col("least")))
    unasked = bounded.groupBy("query_id").agg(F.coalesce(F.max(F.when(~F.col("asked"), F.col("bound"))), F.lit(0)).alias("rest"))
    tallied = bounded.where("asked").join(postings, "term").groupBy("query_id", "id").agg(F.sum("weight").alias("got"))
    reach = F.col("got") + F.col("rest")
    within = F.col("least").isNull() | (reach > F.col("least")) | ((reach == F.col("least")) & (F.col("id") <= F.col("last")))
    pairs = tallied.join(unasked, "query_id").join(last, "query_id", "left").where(within).select("query_id", "id")
    ranked = scored(pairs).withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= top)
    return ranked.select("query_id", "id", (F.col("total") / F.col("n")).alias("score"))


#: Inner words of a passage that it is looked up by, at most.
KEY_WORDS = 4


def passage_docs(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, doc_id) of ``texts`` (doc_id, text) that contain a passage of ``passages`` (query_id, passage).

    A text that contains a passage has all its words but the first and last whole, so the two meet by the hash of up to
    KEY_WORDS of these; only ids and hashes are exploded, and texts are fetched for what meets. Passages of one or two
    words have no inner word: those, a stated set of queries, are held against all texts.
    """
    key = lambda words: F.xxhash64(F.concat_ws(" ", words))
    split = passages.select("query_id", "passage", F.split("passage", " ").alias("w")).withColumn("width", F.least(F.lit(KEY_WORDS), F.size("w") - 2))
    items = split.where("width > 0").select("query_id", "passage", "width", key(F.slice("w", F.lit(2), F.col("width"))).alias("key"))
    words = F.col("words")
    parts = []
    for width in sorted(r.width for r in items.select("width").distinct().collect()):
        windows = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: key(F.slice(words, i, width)))  # noqa: B023
        keys = texts.select("doc_id", F.split("text", " ").alias("words")).where(F.size("words") >= width).select("doc_id", F.explode(F.array_distinct(windows)).alias("key"))
        wanted = items.where(F.col("width") == width)
        parts.append(keys.join(wanted.select("key").distinct(), "key", "left_semi").join(wanted.select("query_id", "passage", "key"), "key").select("query_id", "passage", "doc_id"))
    short = split.where("width <= 0").select("query_id", "passage")
    held = texts.join(short, F.col("text").contains(F.col("passage"))).select("query_id", "doc_id") if short.limit(1).count() else None
    if not parts:
        return texts.join(passages.limit(0), F.lit(False)).select("query_id", "doc_id") if held is None else held.distinct()
    met = reduce(DataFrame.unionByName, parts).distinct().join(texts, "doc_id").where(F.col("text").contains(F.col("passage"))).select("query_id", "doc_id")
    return (met if held is None else met.unionByName(held)).distinct()


def rerank(scored: DataFrame, top: int | None = None, least: float = 0.0, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``scored`` (keys, pos, score, ...) by falling score, then pos; None keeps all, 0 none."""
    kept = scored.where(F.col("score") >= least)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "pos")))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def docs_from_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes (query_id, pos, name, content, sources array) turned round: per document its texts in
    order, and where it was first seen: (query_id, doc_id, body, first_pos, first_at)."""
    body = F.concat_ws(" ", F.expr("nullif(name, '')"), F.expr("nullif(content, '')"))
    rows = nodes.select("query_id", "pos", body.alias("body"), F.posexplode("sources").alias("at", "doc_id")).where("doc_id <> ''")
    texts = F.array_sort(F.collect_list(F.when(F.col("body") != "", F.struct("pos", "at", "body"))))
    return rows.groupBy("query_id", "doc_id").agg(
        F.array_join(F.transform(texts, lambda t: t["body"]), " ").alias("body"), F.min(F.struct("pos", "at")).alias("first")
    ).select("query_id", "doc_id", "body", F.col("first.pos").alias("first_pos"), F.col("first.at").alias("first_at"))


def ranked_docs(nodes: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank): documents in the order in which the ranked nodes first name them."""
    docs = docs_from_nodes(nodes)
    return docs.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("first_pos", "first_at")).alias("rank"))


def doc_rerank(queries: DataFrame, nodes: DataFrame, top: int | None = None, least: float = 0.0) -> DataFrame:
    """Documents behind the nodes of each query by words shared with title and texts."""
    docs = docs_from_nodes(nodes).join(queries, "query_id")
    scored = lexical_scores(docs.select("query_id", "doc_id", "query", F.col("doc_id").alias("name"), F.col("body").alias("content"), "first_pos", "first_at"))
    order = Window.partitionBy("query_id").orderBy("first_pos", "first_at")
    return rerank(scored.withColumn("pos", F.row_number().over(order)), top, least).select("query_id", "doc_id", "score", "rank")


def counterfactual_rerank(queries: DataFrame, ranked: DataFrame, texts: DataFrame) -> DataFrame:
    """What ``ranked`` (query_id, doc_id, rank) would be if its documents were scored by ``texts``
    (doc_id, title, body): adds score and new_rank. No document comes or goes; one without a text scores
    0, ties keep their order."""
    name, title = F.col("doc_id"), F.coalesce("title", F.lit(""))
    content = F.concat_ws(" ", title, F.coalesce("body", F.lit("")))
    joined = ranked.join(queries, "query_id").join(texts.select(name, title.alias("name"), content.alias("content")), "doc_id", "left")
    scored = lexical_scores(joined).withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return scored.select("query_id", "doc_id", "rank", "score", F.row_number().over(order).alias("new_rank"))


def choice_rerank(ranked: DataFrame, answers: DataFrame) -> DataFrame:
    """``ranked`` (query_id, doc_id, rank) with the documents that an answer (query_id, raw) names in
    front, in its order; the others follow as they were."""
    most = ranked.groupBy("query_id").agg(F.max("rank").alias("most"))
    picks = answers.join(most, "query_id").select("query_id", F.posexplode(tx.ranked_indices(F.col("raw"), F.col("most"))).alias("pick", "at"))
    joined = ranked.join(picks.withColumn("rank", F.col("at") + 1).drop("at"), ["query_id", "rank"], "left")
    return joined.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("pick"), "rank")).alias("rank"))


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (2, 4, 10)) -> DataFrame:
    """Hit, recall, average precision and reciprocal rank at each k, as means per type and overall.

    ranked: query_id, doc_id, rank; gold: query_id, doc_id; queries: query_id, type. Queries without
    gold have zero everywhere, null_query ones aren't counted.
    """
    hits = ranked.join(gold.distinct(), ["query_id", "doc_id"])
    hits = hits.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    sizes = gold.distinct().groupBy("query_id").agg(F.count("*").alias("gold"))
    per_query = queries.where("type <> 'null_query'").join(sizes, "query_id", "left").join(hits.select("query_id", "rank", "nth"), "query_id", "left")
    within = lambda k, value: F.when(F.col("rank") <= k, value)
    sums = [
        e
        for k in ks
        for e in (
            F.coalesce(F.count(within(k, 1)), F.lit(0)).alias(f"n{k}"),
            F.coalesce(F.sum(within(k, F.col("nth") / F.col("rank"))), F.lit(0.0)).alias(f"p{k}"),
            F.coalesce(F.max(within(k, 1 / F.col("rank"))), F.lit(0.0)).alias(f"r{k}"),
        )
    ]
    per_query = per_query.groupBy("query_id", "type").agg(F.coalesce(F.max("gold"), F.lit(0)).alias("gold"), *sums)
    safe = F.greatest(F.col("gold"), F.lit(1))
    rounded = lambda e, name: F.round(F.avg(e), 6).alias(name)
    means = [
        m
        for k in ks
        for m in (
            rounded(F.when(F.col(f"n{k}") > 0, 1.0).otherwise(0.0), f"hit_{k}"),
            rounded(F.col(f"n{k}") / safe, f"recall_{k}"),
            rounded(F.col(f"p{k}") / F.least(safe, F.lit(k)), f"map_{k}"),
            rounded(F.col(f"r{k}"), f"mrr_{k}"),
        )
    ]
    return per_query.cube("type").agg(F.count("*").alias("n"), *means).withColumn("type", F.coalesce("type", F.lit("overall")))


def null_query_docs(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """How many queries have no answer, and how many documents came for one on average."""
    none = queries.where("type = 'null_query'").join(ranked.groupBy("query_id").agg(F.count("*").alias("docs")), "query_id", "left")
    return none.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(F.coalesce("docs", F.lit(0))), F.lit(0.0)), 6).alias("avg_docs"))


def gold_ranks(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank, bucket) of every gold document; rank is null where it wasn't found."""
    joined = gold.distinct().join(ranked.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    rank = F.col("rank")
    bucket: Column = F.when(rank.isNull(), "miss").when(rank <= 10, "top10").when(rank <= 50, "11-50").when(rank <= 100, "51-100").otherwise("100+")
    return joined.withColumn("bucket", bucket)


def rank_loss(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """What any rank would give against the first ten: means over queries with gold."""
    per_query = gold_ranks(ranked, gold).groupBy("query_id").agg(
        F.count("*").alias("gold"), F.count("rank").alias("any"), F.count_if(F.col("rank") <= 10).alias("ten")
    )
    share = lambda c: F.round(F.avg(F.col(c) / F.col("gold")), 6)
    hit = lambda c: F.round(F.avg((F.col(c) > 0).cast("double")), 6)
    return per_query.agg(
        F.count("*").alias("n"), hit("any").alias("reached"), share("any").alias("recall_any"), hit("ten").alias("hit_10"), share("ten").alias("recall_10")
    )


def reached(touched: DataFrame, gold: DataFrame) -> DataFrame:
    """Per query with gold: how many of its documents are among all that ``touched`` (query_id, doc_id)
    names, at whatever rank, and their share (query_id, gold, found, reached, recall)."""
    met = gold.distinct().join(touched.select("query_id", "doc_id", F.lit(1).alias("hit")).distinct(), ["query_id", "doc_id"], "left")
    sums = met.groupBy("query_id").agg(F.count("*").alias("gold"), F.count("hit").alias("found"))
    return sums.withColumns({"reached": F.col("found") > 0, "recall": F.col("found") / F.col("gold")})


def extraction_metrics(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """Precision, recall and F1 of extracted names (sample, name) by exact match."""
    right = extracted.join(expected.distinct(), ["sample", "name"], "left_semi")
    counted = [(right, "right"), (expected, "want"), (extracted, "got")]
    parts = [df.select(*(F.lit(int(n == name)).alias(n) for _, n in counted)) for df, name in counted]
    counts = reduce(DataFrame.unionAll, parts).agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for _, n in counted))
    p = F.when(F.col("got") > 0, F.col("right") / F.col("got")).otherwise(0.0)
    r = F.when(F.col("want") > 0, F.col("right") / F.col("want")).otherwise(0.0)
    return counts.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def trace_totals(calls: DataFrame) -> DataFrame:
    """Tokens per chat (conv_id, tokens): null if any call's count is null."""
    return calls.groupBy("conv_id").agg(F.when(F.count("*") == F.count("tokens"), F.sum("tokens")).alias("total_tokens"))
