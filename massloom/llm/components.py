"""Connected components, and exact linking within buckets by hubs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.llm.workspace import Workspace, small


def components(work: Workspace, edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id in edges (a, b).

    Rounds of taking the smallest label among neighbours and then the label's own label; each round
    is a written table. Long chains halve, so rounds grow with the logarithm of the diameter.
    """
    both = work.save(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    label = work.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "label")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("i")).agg(F.min("c").alias("near"))
        # a vote for my own label too: the label moves to what my neighbours have found
        step = label.join(near, F.col("id") == F.col("i")).select("id", "component", F.least("component", "near").alias("best"))
        step = work.save(step, "step")
        vote = step.groupBy(F.col("component").alias("v")).agg(F.min("best").alias("voted"))
        moved = step.join(vote, F.col("component") == F.col("v")).select("id", "component", F.least("best", "voted").alias("best"))
        jump = moved.select(F.col("id").alias("j"), F.col("best").alias("jumped"))
        after = moved.join(jump, F.col("best") == F.col("j"), "left").select("id", F.col("component").alias("old"), F.least("best", F.coalesce("jumped", "best")).alias("component"))
        after = work.save(after, "label")
        changed = after.where("old <> component").limit(1).count()
        work.drop(label, step)
        label = after.drop("old")
        label._massloom_path = after._massloom_path
        if not changed:
            work.drop(both)
            return label


def merged(work: Workspace, label: DataFrame, edges: DataFrame) -> DataFrame:
    """label (id, component) with the components that edges (a, b) link made one; only those that an edge touches are gone through in rounds."""
    of = {x: label.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab"}
    between = edges.join(of["a"], "a", "left").join(of["b"], "b", "left").select(*(F.coalesce(f"of_{x}", x).alias(x) for x in "ab"))
    top = components(work, between)
    known = label.select("id", "component").union(edges.select("a", "a").union(edges.select("b", "b")).distinct().toDF("id", "component").join(label, "id", "left_anti"))
    moved = known.join(top.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    out = work.save(moved.select("id", F.coalesce("to", "component").alias("component")), "label")
    work.drop(top)
    return out


def link_in_buckets(
    work: Workspace,
    members: DataFrame,
    traits: DataFrame | None,
    possible: Callable[[str, str], Column],
    links: Callable[[DataFrame], DataFrame],
    kind: str = "long",
    most_buckets: int = 1_000_000,
) -> DataFrame:
    """Components of the links between ids that share a bucket, without writing out all pairs of a bucket.

    members: bucket, id (distinct, of the SQL type `kind`).
    traits: id and columns that `possible` reads; joined only to ids that share a bucket.
    possible: a cheap condition that every linked pair meets, given the prefixes of its two sides' columns.
    links: keeps those of the pairs (a, b) that are linked.
    Rounds are those of `meet_hubs`, the first hub being the bucket's least id.
    Up to `most_buckets` keys of larger buckets are broadcast (8 bytes each); more are joined by shuffle.
    """
    several = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("n > 1")
    several = work.save(several, "several")
    # most such buckets have two ids, which are known then; only for larger ones are the members asked again
    active = several.where("n = 2").select("bucket", F.explode(F.array("lo", "hi")).alias("id"))
    active = active.unionAll(members.join(small(several.where("n > 2").select("bucket"), most_buckets), "bucket"))
    if traits is not None:
        active = active.join(traits, "id")
    active = work.save(active, "active")
    work.drop(several)
    label = meet_hubs(work, active, None, possible, links)
    if label is None:
        label = members.sparkSession.createDataFrame([], f"id {kind}, component {kind}")
    return label


def meet_hubs(
    work: Workspace,
    active: DataFrame,
    label: DataFrame | None,
    possible: Callable[[str, str], Column],
    links: Callable[[DataFrame], DataFrame],
    turns: tuple[str | int, ...] = ("least", 32, "rest"),
    once: bool = False,
) -> DataFrame | None:
    """Components of the links between ids that share a bucket and of those in label; active (a written table): bucket, id, and what `possible` reads.

    In each round some ids of a bucket, its hubs, are held against the bucket's other ids that are not
    known to be in the hub's component yet. A hub has then met everyone it needs to and leaves the bucket; a bucket
    is done when its ids are all in one component. So each linked pair of a bucket ends in one component, as if
    all pairs had been compared, while a group of n near copies costs about n comparisons. The hubs of a turn are the "least" id, or about so many of all ids
    (those whose hash lies below their number's share, so that no task sorts a bucket, and buckets that share ids share hubs): most are in the
    bucket's largest component, and meet only the few ids that are not. At last, for the "rest", all that are still outside of the least component are hubs.
    once: two ids that share many buckets meet in the first of them only, for which each id carries the list of its buckets.
    """
    carried = [c for c in active.columns if c not in ("bucket", "id")]
    for turn in turns:
        if not active.limit(1).count():
            break
        own = active.withColumn("component", F.col("id"))
        if label is not None:
            own = active.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
            own = work.save(own, "own")
        state = own.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("many")).where("lo <> hi")
        share = F.xxhash64("id") / F.lit(2.0**64) + 0.5  # of the ids, those before this one
        hub = share * F.col("many") < turn if isinstance(turn, int) else {"least": F.col("id") == F.col("lo"), "rest": F.col("component") != F.col("lo")}[turn]
        open_ = work.save(own.join(state.drop("hi"), "bucket").withColumn("hub", hub).drop("lo", "many"), "open")
        sides, first_of_all = open_, F.lit(True)
        if once:
            lists = open_.groupBy("id").agg(F.collect_list("bucket").alias("buckets"), F.collect_list(F.when(F.col("hub"), F.col("bucket"))).alias("as_hub"))
            sides = work.save(open_.join(lists, "id"), "sides")
            first_of_all = F.array_min(F.array_intersect("buckets", "hub_as_hub")) == F.col("bucket")
        first = sides.where("hub").select(F.col("bucket").alias("hub_bucket"), *(F.col(c).alias(f"hub_{c}") for c in ("id", "component", *carried, *(["as_hub"] if once else []))))
        # two hubs of a bucket meet once
        on = (F.col("bucket") == F.col("hub_bucket")) & (F.col("component") != F.col("hub_component")) & (~F.col("hub") | (F.col("id") > F.col("hub_id")))
        pairs = sides.join(first, on & possible("", "hub_") & first_of_all).select(F.least("id", "hub_id").alias("a"), F.greatest("id", "hub_id").alias("b"))
        pairs = work.save(pairs.distinct(), "pairs")
        found = work.save(links(pairs).select("a", "b"), "found")
        work.drop(active, own, pairs, *([sides] if once else []))
        active = open_.where("not hub").select(*active.columns)
        active._massloom_path = open_._massloom_path
        if found.limit(1).count():
            before, label = label, components(work, found) if label is None else merged(work, label, found)
            if before is not None:
                work.drop(before)
    work.drop(active)
    return label
