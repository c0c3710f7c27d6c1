"""Seeds to subgraph: six ways of growing, for any number of questions at once.

Everything is keyed by ``query_id``. ``seeds`` has query_id, node_id, similarity; grown
sets have query_id, node_id, hop. A set never exceeds ``max_nodes`` per question, which
is the operator's own limit and the proven size of the tables joined in each round.
Where the original order is arbitrary, nodes are taken by (hop, id) or by
(centrality, id).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarweave.fixed_values import GRAPH_WEIGHT, HYBRID_SHARES, METADATA_WEIGHT, NODE_TYPE_WEIGHTS, VECTOR_WEIGHT
from scholarweave.operators import vectors
from scholarweave.operators.graph_stats import both_directions
from scholarweave.operators.ranking import group_rank, top_per_group
from scholarweave.session import durable, rounds

MAX_NODES, MAX_EDGES, MAX_HOPS, TOP_K, THRESHOLD = 200, 500, 3, 20, 0.5


def choose_strategy(complexity: Column, query_type: Column, search_mode: Column) -> Column:
    """Strategy from the analysis; without an analysis (nulls) it is hybrid."""
    by_type = {
        "citation_analysis": "local", "collaboration_analysis": "community", "trend_analysis": "temporal",
        "similarity_analysis": "semantic", "comprehensive_analysis": "global",
    }
    out = F.when(complexity == "simple", "local").when(complexity == "exploratory", "global")
    for kind, strategy in by_type.items():
        out = out.when(query_type == kind, strategy)
    return out.when(search_mode == "local", "local").when(search_mode == "global", "global").otherwise("hybrid")


def neighbours(edges: DataFrame, distinct: bool = True) -> DataFrame:
    """Distinct (node_id, neighbour) of the multigraph, direction ignored, for reuse over rounds.

    Growing drops repeated pairs itself: without ``distinct`` stored edges are only scanned, not shuffled.
    """
    pairs = both_directions(edges.select("src", "dst").filter("src <> dst")).select(F.col("node").alias("node_id"), "neighbour")
    return pairs.distinct() if distinct else pairs


def _start(seeds: DataFrame) -> DataFrame:
    return seeds.select("query_id", "node_id").distinct().withColumn("hop", F.lit(0))


def _room(members: DataFrame, limit: Column | int) -> DataFrame:
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return members.groupBy("query_id").agg(F.count("*").alias("_have")).select("query_id", (limit - F.col("_have")).alias("_room")).filter("_room > 0")


def _take(candidates: DataFrame, members: DataFrame, order: list[Column], max_nodes: int, limit: Column | int | None = None) -> DataFrame:
    """Candidates that fit into what is left of each question's budget, in order."""
    ranked = top_per_group(candidates, ["query_id"], order, max_nodes, "_rank")
    return ranked.join(_room(members, max_nodes if limit is None else limit), "query_id").filter("_rank <= _room").drop("_rank", "_room")


def listed(pairs: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """(key, ids, copies): the first ``most`` distinct values of each key, in order, and how often each stands there.

    A question takes the first new nodes that its budget has room for, and what it has and what it has room for are ``most`` together. So a node's neighbours
    beyond the first ``most`` are never taken, and a hub's list is as long as that of others.
    """
    counted = pairs.groupBy(key, value).agg(F.count("*").cast("int").alias("_n"))
    first = top_per_group(counted, [key], [F.asc(value)], most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(value, "_n"))).alias("_l"))
    return first.select(key, F.col(f"_l.{value}").alias("ids"), F.col("_l._n").alias("copies"))


def _near(frontier: DataFrame, lists: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """(query_id, value, copies) of the lists of a question's ``frontier``, without those behind the end of any list of ``most``, which alone fills the budget."""
    known = frontier.select("query_id", key)
    ends = known.join(lists.select(key, F.when(F.size("ids") >= most, F.get("ids", F.lit(most - 1))).alias("_last")), key).groupBy("query_id").agg(F.min("_last").alias("_end"))
    near = F.filter(F.arrays_zip("ids", "copies"), lambda x: F.col("_end").isNull() | x["ids"].isNull() | (x["ids"] <= F.col("_end")))
    return known.join(lists, key).join(ends, "query_id").select("query_id", F.inline(near).alias(value, "copies"))


def _reached(frontier: DataFrame, lists: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """Distinct (query_id, value) of ``_near``."""
    return _near(frontier, lists, key, value, most).select("query_id", value).distinct()


def _repeated(frontier: DataFrame, lists: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """(query_id, value) of ``_near``, each as often as it stands there; more than ``most`` are never taken."""
    found = _near(frontier, lists, key, value, most).groupBy("query_id", value).agg(F.sum("copies").alias("_n"))
    return found.select("query_id", F.explode(F.array_repeat(value, F.least("_n", F.lit(most)).cast("int"))).alias(value))


def _lists(around: DataFrame, frontier: DataFrame, most: int) -> DataFrame:
    """Lists of neighbours; made for the nodes of ``frontier`` if ``around`` has pairs."""
    if "ids" in around.columns:
        return around
    return listed(around.join(frontier.select("node_id").distinct(), "node_id", "left_semi"), "node_id", "neighbour", most)


def expand_local(seeds: DataFrame, around: DataFrame, max_nodes: int = MAX_NODES, max_hops: int = MAX_HOPS) -> DataFrame:
    """Breadth first; the last hop that fits is cut by id (a hard limit). ``around``: pairs, or ``listed`` neighbours (node_id, ids), at least ``max_nodes`` where a node has as many."""
    members = durable(_start(seeds))
    frontier = members
    for hop in range(1, max_hops + 1):
        open_queries = _room(members, max_nodes).select("query_id")
        growing = frontier.join(open_queries, "query_id", "left_semi")
        reached = _reached(growing, _lists(around, growing, max_nodes), "node_id", "_near", max_nodes).select("query_id", F.col("_near").alias("node_id"))
        reached = reached.join(members.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
        frontier = durable(_take(reached, members, [F.asc("node_id")], max_nodes).select("query_id", "node_id", F.lit(hop).alias("hop")))
        if frontier.isEmpty():
            break
        members = durable(members.unionByName(frontier))
    return members


@dataclass(frozen=True)
class Ranked:
    """Nodes in the order of falling centrality (node_id, centrality, place), and, if they are made for all nodes, ``listed`` places of neighbours: all (node_id, ids), and those after the node (place, ids)."""

    placed: DataFrame
    near: DataFrame | None = None
    later: DataFrame | None = None


def place(centrality: DataFrame) -> DataFrame:
    """(node_id, centrality, place), stored."""
    known = centrality.select("node_id", "centrality").distinct()
    return durable(group_rank(known, [], ["centrality", "node_id"], "place", descending=["centrality"]).select("node_id", "centrality", F.col("place").cast("int").alias("place")))


def _placed_pairs(around: DataFrame, placed: DataFrame) -> DataFrame:
    """(node_id, to) with the place of the neighbour."""
    return around.join(placed.select(F.col("node_id").alias("neighbour"), F.col("place").alias("to")), "neighbour").select("node_id", "to")


def _later_lists(pairs: DataFrame, placed: DataFrame, most: int) -> DataFrame:
    return listed(pairs.join(placed.select("node_id", "place"), "node_id").filter(F.col("to") > F.col("place")), "place", "to", most)


def ranked_neighbours(around: DataFrame, centrality: DataFrame, most: int = MAX_NODES) -> Ranked:
    """What ``expand_global`` looks up, made once for all nodes and stored."""
    placed = place(centrality)
    pairs = durable(_placed_pairs(around, placed))
    return Ranked(placed, durable(listed(pairs, "node_id", "to", most)), durable(_later_lists(pairs, placed, most)))


def expand_global(seeds: DataFrame, around: DataFrame, centrality: DataFrame, max_nodes: int = MAX_NODES, always: float = 0.1, max_rounds: int | None = None, ranked: Ranked | None = None) -> DataFrame:
    """One pass over nodes by falling centrality: a node joins if it is very central or
    touches a node that is already in.

    The pass is sequential by definition, but its result is the smallest fixed point of
    "in if always, or adjacent to a seed, or adjacent to an earlier node that is in".
    Rounds of joins find it; only the first ``max_nodes`` of each question are kept per
    round, since a later node can never push an earlier one out, and only nodes that came in with
    the round before bring new ones. It fails if ``max_rounds`` are not enough. ``ranked`` has the lists of all
    nodes; without it ``around`` (pairs) is looked through for those that are needed.
    """
    start = durable(_start(seeds))
    placed = ranked.placed if ranked else place(centrality)
    order = [F.asc("to")]
    held = durable(start.join(placed, "node_id").select("query_id", F.col("place").alias("to")))
    # every question starts from the same at most max_nodes central nodes
    central = placed.filter((F.col("place") <= max_nodes) & (F.col("centrality") > always)).select(F.array_agg("place")).scalar()
    free = start.select("query_id").distinct().select("query_id", F.explode(central).alias("to"))
    near = ranked.near if ranked else listed(_placed_pairs(around.join(start.select("node_id").distinct(), "node_id", "left_semi"), placed), "node_id", "to", max_nodes)
    touching = _reached(start, near, "node_id", "to", max_nodes)
    base = free.unionByName(touching).distinct().join(held, ["query_id", "to"], "left_anti")
    added = fresh = durable(_take(base, start, order, max_nodes).select("query_id", "to"))
    for _ in rounds(max_rounds):
        if ranked:
            later = ranked.later
        else:
            wanted = placed.join(fresh.select(F.col("to").alias("place")).distinct(), "place", "left_semi")
            later = _later_lists(_placed_pairs(around.join(wanted.select("node_id"), "node_id", "left_semi"), placed), placed, max_nodes)
        # a full question takes only what comes before its last node
        last = added.groupBy("query_id").agg(F.count("*").alias("_n"), F.max("to").alias("_last")).join(_room(start, max_nodes), "query_id")
        last = last.select("query_id", F.when(F.col("_n") >= F.col("_room"), F.col("_last")).alias("_last"))
        come = fresh.withColumnRenamed("to", "place").join(later, "place").join(last, "query_id")
        come = come.select("query_id", F.explode(F.filter("ids", lambda x: F.col("_last").isNull() | (x < F.col("_last")))).alias("to")).distinct()
        come = come.join(held, ["query_id", "to"], "left_anti").join(added, ["query_id", "to"], "left_anti")
        pool = added.withColumn("_new", F.lit(False)).unionByName(come.withColumn("_new", F.lit(True)))
        taken = durable(_take(pool, start, order, max_nodes).select("query_id", "to", "_new"))
        added, fresh = taken.select("query_id", "to"), taken.filter("_new").select("query_id", "to")
        if fresh.isEmpty():
            break
    found = added.join(placed.select(F.col("place").alias("to"), "node_id"), "to")
    return start.unionByName(found.select("query_id", "node_id", F.lit(1).alias("hop")))


def expand_community(seeds: DataFrame, labels: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """All nodes of the seeds' communities (id, community), by id up to the limit."""
    start = _start(seeds)
    wanted = start.join(labels.select(F.col("id").alias("node_id"), "community"), "node_id").select("query_id", "community").distinct()
    lists = listed(labels.join(wanted.select("community").distinct(), "community", "left_semi"), "community", "id", max_nodes)
    inside = _repeated(wanted, lists, "community", "id", max_nodes).select("query_id", F.col("id").alias("node_id"))
    fresh = inside.join(start.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    return start.unionByName(_take(fresh, start, [F.asc("node_id")], max_nodes).select("query_id", "node_id", F.lit(1).alias("hop")))


def expand_temporal(seeds: DataFrame, nodes: DataFrame, max_nodes: int = MAX_NODES, fallback: DataFrame | None = None) -> DataFrame:
    """Nodes whose year is near the seeds' years. Questions without a seed year grow locally over ``fallback``."""
    start = durable(_start(seeds))
    dated = nodes.filter(F.col("year").isNotNull()).select(F.col("id").alias("node_id"), "year")
    span = start.join(dated, "node_id").groupBy("query_id").agg(F.min("year").alias("low"), F.max("year").alias("high"))
    window = F.greatest(F.lit(3), F.col("high") - F.col("low") + 2)
    years = span.select("query_id", F.explode(F.sequence(F.col("low") - window, F.col("high") + window)).alias("year"))
    inside = _repeated(years, listed(dated, "year", "node_id", max_nodes), "year", "node_id", max_nodes)
    fresh = inside.join(start.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    grown = start.unionByName(_take(fresh, start, [F.asc("node_id")], max_nodes).select("query_id", "node_id", F.lit(1).alias("hop")))
    undated = seeds.join(span.select("query_id"), "query_id", "left_anti")
    if fallback is None:
        return grown
    return grown.join(span.select("query_id"), "query_id", "left_semi").unionByName(expand_local(undated, fallback, max_nodes))


def expand_semantic(seeds: DataFrame, store: DataFrame, max_nodes: int = MAX_NODES, threshold: float = THRESHOLD, fallback: DataFrame | None = None) -> DataFrame:
    """Nodes similar to the mean of the seeds' vectors. Questions without a vector grow locally."""
    start = durable(_start(seeds))
    known = start.select("query_id", "node_id").join(store.select("node_id", "embedding"), "node_id")
    means = durable(vectors.mean_vector(known, ["query_id"]))
    found = vectors.search(store, means, max_nodes, min_similarity=threshold)
    fresh = found.join(start.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    grown = start.unionByName(
        _take(fresh, start, [F.asc("rank")], max_nodes).select("query_id", "node_id", F.lit(1).alias("hop"))
    )
    if fallback is None:
        return grown
    blind = seeds.join(means.select("query_id"), "query_id", "left_anti")
    return grown.join(means.select("query_id"), "query_id", "left_semi").unionByName(expand_local(blind, fallback, max_nodes))


def expand_hybrid(seeds: DataFrame, around: DataFrame, store: DataFrame, centrality: DataFrame, max_nodes: int = MAX_NODES, max_hops: int = MAX_HOPS, threshold: float = THRESHOLD, ranked: Ranked | None = None) -> DataFrame:
    """Local, then semantic, then global growth, each within its share of the free budget. With ``ranked``, ``around`` may be ``listed`` neighbours."""
    current = durable(_start(seeds).withColumn("step", F.lit(0)))
    free = current.groupBy("query_id").agg((F.lit(max_nodes) - F.count("*")).alias("_free"))
    run: dict[str, Callable[[DataFrame], DataFrame]] = {
        "local": lambda s: expand_local(s, around, max_nodes, max_hops),
        "semantic": lambda s: expand_semantic(s, store, max_nodes, threshold, fallback=around),
        "global": lambda s: expand_global(s, around, centrality, max_nodes, ranked=ranked),
    }
    for step, (name, share) in enumerate(HYBRID_SHARES, 1):
        grown = run[name](current.select("query_id", "node_id"))
        fresh = grown.select("query_id", "node_id", "hop").join(current.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
        budget = free.select("query_id", F.floor(F.col("_free") * share).alias("_budget"))
        first = top_per_group(fresh, ["query_id"], [F.asc("hop"), F.asc("node_id")], max_nodes, "_rank")
        kept = first.join(budget, "query_id").filter("_rank <= _budget").select("query_id", "node_id", "hop", F.lit(step).alias("step"))
        current = durable(current.unionByName(kept))
    return current


def expansion_path(members: DataFrame, step: str = "hop") -> DataFrame:
    """(query_id, step, added_nodes, total_nodes): how each question's set grew."""
    added = members.groupBy("query_id", step).agg(F.count("*").alias("added_nodes"))
    upto = Window.partitionBy("query_id").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return added.withColumn("total_nodes", F.sum("added_nodes").over(upto))  # a handful of steps per question


def induced_edges(members: DataFrame, edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """Edges with both ends in a question's set, the first ``max_edges`` by (src, dst, type)."""
    ends = members.select("query_id", "node_id")
    inside = edges.join(ends.withColumnRenamed("node_id", "src"), "src").join(
        ends.withColumnRenamed("node_id", "dst"), ["query_id", "dst"]
    )
    return top_per_group(inside, ["query_id"], [F.asc("src"), F.asc("dst"), F.asc("edge_type")], max_edges, "edge_no")


def simple_undirected(edges: DataFrame) -> DataFrame:
    """A question's subgraph as a simple undirected graph."""
    return edges.select("query_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def relevance(members: DataFrame, nodes: DataFrame, seeds: DataFrame, centrality: DataFrame | None = None) -> DataFrame:
    """(query_id, node_id, node_type, similarity, relevance) of every node in a set."""
    weight = None
    for kind, value in NODE_TYPE_WEIGHTS.items():
        weight = F.when(F.col("node_type") == kind, value) if weight is None else weight.when(F.col("node_type") == kind, value)
    rows = members.select("query_id", "node_id").join(nodes.select(F.col("id").alias("node_id"), "node_type"), "node_id")
    rows = rows.join(seeds.select("query_id", "node_id", "similarity"), ["query_id", "node_id"], "left")
    central = F.lit(0.0)
    if centrality is not None:
        rows, central = rows.join(centrality.select("node_id", "centrality"), "node_id", "left"), F.coalesce("centrality", F.lit(0.0))
    score = F.coalesce("similarity", F.lit(0.0)) * VECTOR_WEIGHT + weight.otherwise(0.5) * METADATA_WEIGHT + central * GRAPH_WEIGHT
    return rows.select("query_id", "node_id", "node_type", "similarity", F.least(F.lit(1.0), score).alias("relevance"))


def confidence(scored: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, total_nodes, confidence); zero without seeds or nodes."""
    found = seeds.groupBy("query_id").agg(F.avg("similarity").alias("_sim"))
    sized = scored.groupBy("query_id").agg(F.count("*").alias("total_nodes"), F.avg("relevance").alias("_rel"))
    n = F.col("total_nodes")
    size_factor = F.when(n < 5, 0.7).when(n > 100, 0.8).otherwise(1.0)
    value = F.least(F.lit(1.0), F.col("_sim") * 0.4 + F.col("_rel") * 0.4 + size_factor * 0.2)
    return sized.join(found, "query_id", "left").select("query_id", "total_nodes", F.coalesce(value, F.lit(0.0)).alias("confidence"))
