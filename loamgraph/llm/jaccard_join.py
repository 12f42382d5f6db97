"""Exact Jaccard join of shingle sets by set relations: lists of an index are skipped by blocks of size and position, and
what is known of one set answers for the sets that are much like it."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, freeing_shuffles, remove_folder, shared_folder, text_or_empty
from .rare_shingles import PARITY, Index, rare_index, sets_of
from loamgraph.operators.components import connected_components

SHINGLE_WORDS = 5
#: The least similarity, in percent: sizes are compared in whole numbers.
PERCENT = 80
#: Rounds in which sets look for a leader. More make fewer and larger clusters; links are found with any.
ROUNDS = 2
#: Rounds in which sets of lists that have several components are compared with one of another component, at most.
BRIDGES = 3
#: Lists of more places than this compare parities before pairs leave them.
LONG = 32
#: Of a set's places so many are looked at for lists in which two sets met before.
EARLIER = 64
ENDS = ("a", "b")


def _enough(both: Column, sizes: Column, percent: int) -> Column:
    """Whether sets with ``both`` in common, of so many shingles together, are similar enough."""
    return both * (100 + percent) >= sizes * percent


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with sizes n_a, n_b, what they have in common, and what b has more (added) and less (lost) than a."""
    left, right = sets.toDF("a", "left"), sets.toDF("b", "right")
    met = pairs.join(right, "b").join(left, "a")
    sizes = {"n_a": F.size("left"), "n_b": F.size("right"), "added": F.array_except("right", "left"), "lost": F.array_except("left", "right")}
    return met.withColumns(sizes).withColumn("both", F.col("n_b") - F.size("added")).drop("left", "right")


def _led(posts: DataFrame, sets: DataFrame, leaders: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``leaders`` (class, leader) after a round, and the links found in it: (a, b, n_b, added, lost), a the leader.

    A set without followers that leads itself asks the least leader of its lists. It follows if they are similar enough
    and that one goes on leading.
    """
    listed = posts.join(leaders, "class")
    tops = listed.groupBy("token").agg(F.min("leader").alias("top"), F.max("leader").alias("last")).where("top < last").drop("last")
    asked = listed.join(tops, "token").where("leader = class").groupBy("class").agg(F.min("top").alias("a")).where("a < class")
    busy = leaders.where("leader <> class").select(F.col("leader").alias("class")).distinct()
    pairs = asked.join(busy, "class", "left_anti").select("a", F.col("class").alias("b"))
    found = cut(_overlaps(pairs, sets).where(_enough(F.col("both"), F.col("n_a") + F.col("n_b"), percent)).select("a", "b", "n_b", "added", "lost"))
    follows = found.join(found.select(F.col("b").alias("a")), "a", "left_anti").select(F.col("b").alias("class"), F.col("a").alias("to"))
    return cut(leaders.join(follows, "class", "left").select("class", F.coalesce("to", "leader").alias("leader"))), found


def _clusters(members: DataFrame) -> DataFrame:
    """(leader, n_members, most, least): how many there are, the most that one has beyond its leader, the smallest size."""
    return members.groupBy("leader").agg(F.count("*").alias("n_members"), F.max(F.size("added")).alias("most"), F.min("n").alias("least"))


def _bridged(posts: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """``links`` (a, b) with more of them between components: each round, a set asks one of another component that a list of
    its has, another one each time. The time goes by sets, not pairs, and most components that belong together meet."""
    left = posts.select("token", "class")
    for turn in range(BRIDGES):
        parts = connected_components(links, *ENDS).toDF("class", "component")
        placed = left.join(parts, "class", "left").withColumn("component", F.coalesce("component", "class"))
        head = F.struct(F.xxhash64("component", F.lit(turn)).alias("order"), F.xxhash64("class", F.lit(turn)).alias("nth"), "component", "class")
        ends = placed.groupBy("token").agg(F.min(head).alias("low"), F.max(head).alias("high")).where("low.component <> high.component")
        listed = cut(placed.join(ends, "token"))
        left = listed.select("token", "class")
        other = F.when(F.col("component") == F.col("low.component"), F.col("high.class")).otherwise(F.col("low.class"))
        asked = listed.select("class", F.xxhash64("token", F.lit(turn)).alias("order"), other.alias("other")).groupBy("class").agg(F.min_by("other", "order").alias("other"))
        pairs = asked.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()
        found = cut(_overlaps(pairs, sets).where(_enough(F.col("both"), F.col("n_a") + F.col("n_b"), percent)).select(*ENDS))
        if found.isEmpty():
            break
        links = cut(links.unionByName(found))
    return links


def _odd_bits(end_a: str, end_b: str) -> Column:
    """The bits in which two parities differ: no more than the shingles in which their sets do."""
    return reduce(Column.__add__, (F.bit_count(F.get(end_a, i).bitwiseXOR(F.get(end_b, i))) for i in range(PARITY // 64)))


def _leader_pairs(posts: DataFrame, members: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of leaders in different components of whose clusters two sets may be similar, as far as their places
    in a list tell.

    Lists are cut into blocks by size and by place. Sets that meet first after i and j of m_a and m_b can have no more in
    common than min(m_a - i, m_b - j); blocks without one that this allows them are passed over, then clusters. Lists of
    more than LONG places also compare parities in the join, and pass over sets that met in an earlier list, so that
    pairs that may be similar leave it, and once.
    """
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(max(1.05, 100 / percent))))
    listed = posts.join(members.select("class", "leader"), "class").join(parts, "leader").withColumns({"size": size, "place": F.floor(F.log2(F.col("at") + 1.0)), "after": F.col("m") - F.col("at")})
    mixed = listed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), (F.count("*") > LONG).alias("long")).where("low < high").select("token", "long")
    block = ["token", "size", "place"]
    entries = cut(listed.join(mixed, "token").groupBy(*block, "long", "leader", "component").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("after").alias("after"), F.min("at").alias("at")))
    may = _enough(F.least("after_a", "after_b"), F.col("least_a") + F.col("least_b"), percent)
    sized = (F.col("least_a") * percent <= F.col("most_b") * 100) & (F.col("least_b") * percent <= F.col("most_a") * 100)
    named = lambda df, end, keys=("token",): df.select(*keys, *(F.col(c).alias(f"{c}_{end}") for c in df.columns if c not in keys))
    blocks = entries.groupBy(*block).agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("after").alias("after"), F.count("*").alias("of"))
    own = F.struct("size_a", "place_a").eqNullSafe(F.struct("size_b", "place_b"))
    met = named(blocks, "a").join(named(blocks, "b"), "token").where(sized & may & (~own | (F.col("of_a") > 1)))
    kept = entries.join(met.select("token", F.col("size_a").alias("size"), F.col("place_a").alias("place")).distinct(), block, "left_semi").drop("size", "place")
    other = (F.col("component_a") != F.col("component_b")) & (F.col("leader_a") < F.col("leader_b"))

    apart = members.groupBy("leader").agg(F.max(F.size("added") + F.size("lost")).alias("apart"), F.count("*").alias("of"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"])
    first = posts.where(F.col("at") < EARLIER).groupBy(F.col("class").alias("leader")).agg(ordered.alias("first"))
    sketches = sets.select(F.col("class").alias("leader"), "odd").join(apart, "leader").join(first, "leader")
    # of a leader with followers it isn't known which of them has met
    earlier = F.when(F.col("of") == 1, F.slice("first", 1, F.least(F.col("at"), F.lit(EARLIER)))).otherwise(F.slice("first", 1, 0))
    long = kept.where("long").join(sketches, "leader").withColumn("earlier", earlier).drop("of", "first", "at", "long")
    differ = _odd_bits("odd_a", "odd_b") - F.col("apart_a") - F.col("apart_b")
    alike = (differ * (100 + percent) <= (F.col("most_a") + F.col("most_b")) * (100 - percent)) & ~F.arrays_overlap("earlier_a", "earlier_b")
    found = [named(rows, "a").join(named(rows, "b"), "token").where(other & sized & may & also) for rows, also in ((kept.where("not long").drop("at", "long"), F.lit(True)), (long, alike))]
    return found[0].select("leader_a", "leader_b").unionByName(found[1].select("leader_a", "leader_b")).toDF(*ENDS).distinct()


def _answers(pairs: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the clusters of leader ``pairs`` (a, b).

    Leaders are compared by their sets. What a member has in common with the other leader follows from its own leader's
    answer and the few shingles in which they differ, and what two members have from that; clusters and members that
    can't be similar enough, with all that they have beyond their leaders, are passed over unread.
    """
    clusters = _clusters(members)
    sides = {end: clusters.select(*(F.col(c).alias(end if c == "leader" else f"{c}_{end}") for c in clusters.columns)) for end in ENDS}
    known = _overlaps(pairs, sets).select("a", "b", "n_a", "n_b", "both").join(sides["a"], "a").join(sides["b"], "b")
    known = cut(known.where(_enough(F.col("both") + F.col("most_a") + F.col("most_b"), F.col("least_a") + F.col("least_b"), percent)))
    direct = _enough(F.col("both"), F.col("n_a") + F.col("n_b"), percent)
    links = known.where(direct).select(*ENDS)

    rest = known.where(~direct & (F.col("n_members_a") + F.col("n_members_b") > 2))
    derived = {}
    for own, other in (ENDS, ENDS[::-1]):
        mine = members.select(F.col("leader").alias(own), F.col("class").alias("class"), F.col("n").alias("n"), "added", "lost")
        met = rest.select(*ENDS, "both", f"most_{other}", f"least_{other}").join(mine, own).join(sets.toDF(other, "set"), other)
        shared = F.col("both") + F.size(F.array_intersect("added", "set")) - F.size(F.array_intersect("lost", "set"))
        met = met.withColumn("shared", shared).where(_enough(F.col("shared") + F.col(f"most_{other}"), F.col("n") + F.col(f"least_{other}"), percent))
        derived[own] = met.select(*ENDS, *(F.col(c).alias(f"{c}_{own}") for c in ("class", "n", "added", "lost", "shared")))
    within = [_enough(F.col(f"shared_{own}") + F.size(f"added_{other}"), F.col("n_a") + F.col("n_b"), percent) for own, other in (ENDS, ENDS[::-1])]
    both = derived["a"].drop("lost_a").join(derived["b"], list(ENDS)).where(reduce(Column.__and__, within))
    read = both.select("class_a", "class_b", "n_a", "n_b", "shared_a", "added_b", "lost_b").join(sets.toDF("class_a", "set"), "class_a")
    shared = F.col("shared_a") + F.size(F.array_intersect("added_b", "set")) - F.size(F.array_intersect("lost_b", "set"))
    more = read.where(_enough(shared, F.col("n_a") + F.col("n_b"), percent)).select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    return links.unionByName(more).distinct()


def linked_classes(index: Index, docs: DataFrame, width: int, percent: int, candidates: DataFrame | None = None) -> DataFrame:
    """Links (a, b) of classes that connect whatever sets of the index are similar enough. ``candidates`` (a, b), pairs of
    the index's classes that are compared first, spare other comparisons. Sets are written to the shared folder for the
    classes that the index has, and removed."""
    spark = docs.sparkSession
    posts = index.posts
    own = posts.where("at = 0").select("class", "n")
    firsts = index.rows.join(own.select("class"), "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    folder = f"{shared_folder(spark)}/sets-{uuid.uuid4().hex}"
    sets_of(docs, cut(firsts), width).write.parquet(folder)
    known = spark.read.schema("class long, shingles array<long>, odd array<long>").parquet(folder)
    sets = known.drop("odd")

    leaders = own.select("class", F.col("class").alias("leader"))
    links = []
    for _ in range(ROUNDS):
        leaders, found = _led(posts, sets, leaders, percent)
        links.append(found)
    followed = reduce(DataFrame.unionByName, links).select(F.col("a").alias("leader"), F.col("b").alias("class"), "added", "lost")
    none = F.array().cast("array<long>")
    followers = leaders.where("leader <> class").join(followed, ["leader", "class"]).dropDuplicates(["class"])
    heads = leaders.where("leader = class").select("leader", "class", none.alias("added"), none.alias("lost"))
    members = cut(followers.unionByName(heads).join(own, "class"))
    if candidates is not None:
        links.append(_overlaps(candidates, sets).where(_enough(F.col("both"), F.col("n_a") + F.col("n_b"), percent)))
    first = reduce(DataFrame.unionByName, [x.select(*ENDS) for x in links])
    first = _bridged(posts, sets, cut(first.distinct()), percent)
    parts = connected_components(first, *ENDS).toDF("leader", "component")
    parts = cut(leaders.select("leader").distinct().join(parts, "leader", "left").select("leader", F.coalesce("component", "leader").alias("component")))
    pairs = cut(_leader_pairs(posts, members, parts, known.drop("shingles"), percent))
    result = cut(first.unionByName(_answers(pairs, members, sets, percent)))
    remove_folder(spark, folder)
    return result


def components_of(index: Index, links: DataFrame) -> DataFrame:
    """(doc_id, n, component_id): the smallest doc_id that each document reaches by ``links`` between classes; documents of
    one class reach each other, but for empty ones, which reach nothing. Null ids are passed over."""
    classes = index.rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("first_id"))
    parts = connected_components(links, *ENDS).toDF("class", "component")
    owned = classes.join(parts, "class", "left").withColumn("component", F.coalesce("component", "class"))
    ids = owned.join(owned.groupBy("component").agg(F.min("first_id").alias("component_id")), "component").select("class", "component_id")
    found = index.rows.where("n > 0").join(ids, "class").select("doc_id", "n", "component_id")
    return found.unionByName(index.rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def jaccard_components(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text, ...).

    A document's set has its distinct shingles of ``width`` words, A-Z in lower case; with fewer words its one shingle is
    the whole sequence. Documents whose sets have a Jaccard similarity of ``percent`` or more are linked; component_id is
    the smallest doc_id reachable by links, its own included. Null and blank texts have no shingles and no links. Rows
    that repeat a doc_id are documents of their own; null ids are passed over as component_id unless there is no other.
    Other columns are ignored, an empty table gives no rows, and texts are read whole whatever their length.

    Distinct sets only are compared: with sets that others follow as leaders first, then with one of another component at
    a time, and then, where components are left apart, by pairs of leaders, from whose answers those of their followers are
    derived. No link between components is missed.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1..100")
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    with freeing_shuffles(docs.sparkSession):
        index = rare_index(docs, width, percent)
        links = linked_classes(index, docs, width, percent)
        found = components_of(index, links)
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
