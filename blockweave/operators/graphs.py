"""Graph construction on edge lists: merging, node removal, bricks, brick-haplotype graphs, bounded paths.

DataFrame functions only, but for the replay of one tree sequence, whose trees follow each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockweave.functions.scalars import odds, rule_one, rule_two
from blockweave.operators import bricks
from blockweave.operators.joins import mutations_to_bricks
from blockweave.operators.lineage import cut
from blockweave.operators.ordering import numbered


def round_weights(edges: DataFrame, digits: int = 4) -> DataFrame:
    """Weights rounded half to even."""
    return edges.withColumn("weight", F.bround("weight", digits))


def undirected_minimum(edges: DataFrame) -> DataFrame:
    """One edge (smaller, larger) a pair, with the least weight of either direction."""
    return edges.groupBy(F.least("from", "to").alias("from"), F.greatest("from", "to").alias("to")).agg(F.min("weight").alias("weight"))


def last_edge_wins(*graphs: DataFrame) -> DataFrame:
    """Union of graphs in which an edge of a later one replaces the same edge of an earlier one."""
    out = None
    for rank, g in enumerate(graphs):
        part = g.select("from", "to", "weight", F.lit(rank).alias("_rank"))
        out = part if out is None else out.union(part)
    return out.groupBy("from", "to").agg(F.max_by("weight", "_rank").alias("weight"))


#: Tasks over which the ways through a removed node are dealt.
WAYS = 64


def remove_node(edges: DataFrame, node: int, path_threshold: float) -> DataFrame:
    """Edges without a node. A way through it that is at most the threshold becomes an edge, or shortens one; every other edge stays as it is.

    Of repeated edges the last counts, by ``row_nr`` if there is one, else in the order in which they are read.
    """
    at = edges if "row_nr" in edges.columns else edges.withColumn("row_nr", F.monotonically_increasing_id())
    one = cut(at.groupBy("from", "to").agg(F.max_by("weight", "row_nr").alias("weight")))
    into = one.where((F.col("to") == node) & (F.col("from") != node)).select(F.col("from").alias("a"), F.col("weight").alias("wa"), F.pmod(F.xxhash64("from"), F.lit(WAYS)).cast("long").alias("way"))
    out = one.where((F.col("from") == node) & (F.col("to") != node)).select(F.col("to").alias("b"), F.col("weight").alias("wb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WAYS - 1).cast("long"))).alias("way"))
    made = into.join(out, "way").where("a <> b").select(F.col("a").alias("from"), F.col("b").alias("to"), (F.col("wa") + F.col("wb")).alias("new"))
    kept = one.where((F.col("from") != node) & (F.col("to") != node))
    shorter = F.least("weight", "new")
    weight = F.when(F.col("new").isNotNull() & (shorter <= path_threshold), shorter).otherwise(F.col("weight"))
    return kept.join(made, ["from", "to"], "full").select("from", "to", weight.alias("weight")).where("weight is not null")


#: Places of a brick's vertices: 8 * id + place.
UP_BEFORE, UP_AFTER, DOWN_BEFORE, DOWN_AFTER, OUT, UTURN, HAPLO_BEFORE, HAPLO_AFTER = range(8)


def vertex(brick: Column, place: int) -> Column:
    return brick * 8 + place


def haplotype(node: Column) -> Column:
    """Number of a haplotype node in reduced graphs, below zero; its own inverse."""
    return -node - 1


def brick_rule_edges(events: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """Weighted brick pairs of parent and child (rule one) and of siblings (rule two) below a threshold.

    events: focal_brick, parent_brick (nullable), sibling_bricks; frequency: brick, frequency.
    """
    f = lambda name: frequency.select(F.col("brick").alias(name), F.col("frequency").alias(f"f_{name}"))
    up = events.where("parent_brick is not null").select(F.col("focal_brick").alias("a"), F.col("parent_brick").alias("b"), F.lit(1).alias("rule"))
    across = events.select(F.col("focal_brick").alias("a"), F.explode("sibling_bricks").alias("b"), F.lit(2).alias("rule"))
    pairs = up.union(across).join(f("a"), "a").join(f("b"), "b")
    weight = F.when(F.col("rule") == 1, rule_one(F.col("f_a"), F.col("f_b"))).otherwise(rule_two(F.col("f_a"), F.col("f_b")))
    return pairs.select(F.col("a").alias("from"), F.col("b").alias("to"), "rule", weight.alias("weight")).where(F.col("weight") < threshold)


# ---- graph of bricks and haplotypes


def _edge(a: str, place_a: int | Column, b: str, place_b: int | Column, when: Column | None = None) -> Column:
    row = F.struct((F.col(a) * 8 + place_a).cast("int").alias("from"), (F.col(b) * 8 + place_b).cast("int").alias("to"))
    return F.when(when, row) if when is not None else row


def brick_haplotype_graph(bricks: DataFrame, events: DataFrame, labelled: DataFrame, threshold: float | None = None, make_siblings: bool = False) -> DataFrame:
    """Edges (from, to, weight) between the vertices of bricks and haplotypes, below ``threshold``.

    bricks: brick, child, frequency (between 0 and 1); events: event (order), focal_brick, parent_brick
    (nullable), child_bricks and sibling_bricks (arrays); labelled: brick, those with a mutation. Parent and child bricks are tied
    by rule one, siblings, where asked for, by rule two unless the focal brick is too rare for the threshold. Of repeated edges the
    last one holds. Each event is exploded by itself; odds come by equi joins.
    """
    if labelled.join(bricks, "brick", "left_anti").take(1):
        raise ValueError("a labelled brick is not among the bricks")
    wrong = F.assert_true((F.col("frequency") > 0) & (F.col("frequency") < 1), F.lit("a brick's frequency must lie between 0 and 1"))
    marks = bricks.join(labelled.select("brick", F.lit(True).alias("labelled")).distinct(), "brick", "left").withColumn("_ok", wrong).where("_ok is null")
    known = marks.select("brick", "child", F.coalesce("labelled", F.lit(False)).alias("labelled"), odds(F.col("frequency")).alias("odds"))
    side = lambda x: known.select(F.col("brick").alias(x), F.col("odds").alias(f"odds_{x}"), F.col("labelled").alias(f"has_{x}"))
    after = lambda x: F.col(f"has_{x}").cast("int")

    own = known.withColumnsRenamed({"brick": "b", "child": "h", "labelled": "has_b"})
    zero = own.select(F.lit(-1).alias("event"), F.lit(0).alias("step"), F.lit(0.0).alias("weight"), F.explode(F.array_compact(F.array(_edge("b", DOWN_BEFORE, "h", after("b") + HAPLO_BEFORE), _edge("b", DOWN_AFTER, "h", HAPLO_AFTER), _edge("b", OUT, "h", HAPLO_BEFORE, F.col("has_b"))))).alias("e"))

    below = events.select("event", F.posexplode("child_bricks").alias("step", "c"), F.col("focal_brick").alias("p"))
    above = events.where("parent_brick is not null").select("event", F.lit(1_000_000).alias("step"), F.col("focal_brick").alias("c"), F.col("parent_brick").alias("p"))
    kin = below.unionByName(above).join(side("p"), "p").join(side("c"), "c")
    siblings = F.lit(make_siblings)
    one = [
        _edge("c", UP_AFTER, "p", UP_AFTER), _edge("p", DOWN_AFTER, "c", DOWN_AFTER), _edge("c", UP_BEFORE, "p", after("c") + UP_BEFORE), _edge("p", DOWN_BEFORE, "c", after("p") + DOWN_BEFORE),
        _edge("p", OUT, "c", DOWN_BEFORE, F.col("has_p")), _edge("p", UTURN, "c", DOWN_BEFORE, F.col("has_p") & siblings), _edge("c", OUT, "p", UP_BEFORE, F.col("has_c")),
        _edge("c", OUT, "p", UTURN, F.col("has_c") & F.col("has_p") & siblings), _edge("c", UP_BEFORE, "p", UTURN, ~F.col("has_c") & F.col("has_p") & siblings),
    ]
    first = kin.select("event", "step", rule_one(F.col("odds_p") / (1 + F.col("odds_p")), F.col("odds_c") / (1 + F.col("odds_c"))).alias("weight"), F.explode(F.array_compact(F.array(*one))).alias("e"))
    rows = zero.unionByName(first)
    if make_siblings:
        gated = events.join(side("focal_brick"), "focal_brick")
        if threshold is not None:
            gated = gated.where(-F.log(F.col("odds_focal_brick") * F.col("odds_focal_brick")) < threshold)
        left = gated.select("event", F.explode("sibling_bricks").alias("l"), "sibling_bricks")
        pairs = left.select("event", "l", F.explode("sibling_bricks").alias("r")).where("l <> r").join(side("l"), "l").join(side("r"), "r")  # siblings of one edge only
        two = [_edge("l", UP_AFTER, "r", DOWN_AFTER), _edge("l", UP_BEFORE, "r", after("l") + DOWN_BEFORE), _edge("l", OUT, "r", DOWN_BEFORE, F.col("has_l"))]
        rows = rows.unionByName(pairs.select("event", F.lit(2_000_000).alias("step"), F.abs(F.log(F.col("odds_l") * F.col("odds_r"))).alias("weight"), F.explode(F.array_compact(F.array(*two))).alias("e")))
    if threshold is not None:
        rows = rows.where(F.col("weight") < threshold)
    return rows.select("event", "step", "weight", "e.*").groupBy("from", "to").agg(F.max_by("weight", F.struct("event", "step")).alias("weight"))


# ---- bounded shortest paths


def bounded_paths(edges: DataFrame, sources: DataFrame, cutoff: float, may_pass: Callable[[Column], Column], may_reach: Callable[[Column, Column], Column], max_rounds: int = 1000) -> DataFrame:
    """(source, vertex, distance) of the shortest paths of at most ``cutoff`` from each source.

    ``may_pass`` says which vertices a path may run through, ``may_reach`` (source, vertex) which it may touch at all.
    All sources move at once: a round joins the distances that have become shorter with the edges and keeps
    minima, so work is spread by vertex and no graph has to fit into a task. Weights must not be negative.
    """
    checked = F.assert_true(F.col("weight") >= 0, F.lit("edge weights must not be negative"))
    out = edges.withColumn("_ok", checked).where("_ok is null").select(F.col("from").alias("vertex"), F.col("to").alias("next"), F.col("weight").alias("step"))
    out = cut(out)
    best = sources.select("source", F.col("source").alias("vertex"), F.lit(0.0).alias("distance"))
    front = best
    for k in range(max_rounds):
        moving = front if k == 0 else front.where(may_pass(F.col("vertex")))
        tried = moving.join(out, "vertex").select("source", F.col("next").alias("vertex"), (F.col("distance") + F.col("step")).alias("distance"))
        tried = tried.where((F.col("distance") <= cutoff) & (F.col("vertex") != F.col("source")) & may_reach(F.col("source"), F.col("vertex"))).groupBy("source", "vertex").agg(F.min("distance").alias("new"))
        both = cut(best.join(tried, ["source", "vertex"], "full").select("source", "vertex", F.least("distance", "new").alias("distance"), F.coalesce(F.col("new") < F.col("distance"), F.col("distance").isNull()).alias("moved")))
        best, front = both.drop("moved"), both.where("moved").drop("moved")
        if not front.take(1):
            return best
    raise RuntimeError(f"paths have not settled after {max_rounds} rounds")


def reduce_graph(edges: DataFrame, bricks_to_mutations: DataFrame, cutoff: float, targets: DataFrame | None = None) -> DataFrame:
    """Edges between mutations, and from mutations to haplotypes, by paths of at most ``cutoff`` from the out vertices.

    edges: brick-haplotype graph, of repeated ones the last (by ``row_nr`` if there is one); bricks_to_mutations: brick, mutation (its first).
    A brick is met when one of its before vertices is reached and none of its after vertices; ``targets`` (brick) names those that may be met, without it all.
    """
    if "row_nr" in edges.columns:
        edges = edges.groupBy("from", "to").agg(F.max_by("weight", "row_nr").alias("weight"))
    out = F.lit(OUT)
    sources = edges.select(F.explode(F.array("from", "to")).alias("source")).where(F.pmod("source", F.lit(8)) == out).where("source >= 0").distinct()
    names = bricks_to_mutations.groupBy("brick").agg(F.min("mutation").alias("mutation"))
    unnamed = sources.select(F.floor(F.col("source") / 8).alias("brick")).join(names, "brick", "left_anti")
    if unnamed.take(1):
        raise ValueError("an out vertex belongs to a brick without a mutation")
    own = lambda s, v: (F.floor(s / 8) != F.floor(v / 8)) | (F.pmod(v, F.lit(8)) > F.lit(UTURN))  # noqa: E731  not the source's own vertices
    reached = bounded_paths(edges, sources, cutoff, lambda v: F.lit(True), own).where("vertex <> source")
    place, brick = F.pmod("vertex", F.lit(8)), F.floor(F.col("vertex") / 8)
    cells = reached.groupBy("source", brick.alias("brick")).agg(
        F.min(F.when(place.isin(UP_BEFORE, DOWN_BEFORE), F.col("distance"))).alias("before"),
        F.max(place.isin(UP_AFTER, DOWN_AFTER)).alias("after"),
        F.min(F.when(place == HAPLO_BEFORE, F.col("distance"))).alias("haplo_before"),
        F.max(place == HAPLO_AFTER).alias("haplo_after"),
    )
    cells = cells.join(names.withColumnsRenamed({"brick": "sb", "mutation": "a"}), F.floor(F.col("source") / 8) == F.col("sb"))
    named = names if targets is None else names.join(targets.select("brick"), "brick", "left_semi")
    met = cells.where("before is not null and not after").join(named.withColumnRenamed("mutation", "b"), "brick").select("a", "b", F.col("before").alias("weight"))
    haplo = cells.where("haplo_before is not null and not haplo_after").select("a", haplotype(F.col("brick")).alias("b"), F.col("haplo_before").alias("weight"))
    every = met.union(met.select("b", "a", "weight")).union(haplo)
    return every.groupBy(F.col("a").cast("int").alias("from"), F.col("b").cast("int").alias("to")).agg(F.min("weight").alias("weight"))


def finalise_graph(first: DataFrame, second: DataFrame, groups: DataFrame, cutoff: float) -> DataFrame:
    """Undirected edges of mutation groups from two reduced graphs: those of the first both ways, then those of the second.

    Haplotype nodes fall away: two mutations get the shortest path that runs through haplotypes only, if it is at
    most ``cutoff`` and shorter than their edge. As partial paths are never longer than whole ones, this is what removing the
    haplotypes one by one gives, in any order. groups: group, mutation (its first).
    """
    both = last_edge_wins(first, first.select(F.col("to").alias("from"), F.col("from").alias("to"), "weight"), second)
    both = cut(both)
    direct = both.where("`from` >= 0 and `to` >= 0")
    ends = both.where("`from` >= 0 and `to` < 0").select(F.col("from").alias("source")).distinct()
    # the first step goes to a haplotype only: a direct edge is no path through haplotypes
    through = both.where("`from` < 0 or `to` < 0")
    paths = bounded_paths(through, ends, cutoff, lambda v: v < 0, lambda s, v: F.lit(True)).where("vertex >= 0 and vertex <> source")
    every = direct.unionByName(paths.select(F.col("source").alias("from"), F.col("vertex").alias("to"), F.col("distance").alias("weight")))
    number = lambda x: groups.groupBy(F.col("mutation").alias(x)).agg(F.min("group").alias(f"group_{x}"))
    named = every.join(number("from"), "from", "left").join(number("to"), "to", "left")
    known = F.assert_true(F.col("group_from").isNotNull() & F.col("group_to").isNotNull(), F.lit("a mutation of the graph has no group"))
    named = named.withColumn("_ok", known).where("_ok is null and group_from <> group_to")
    return undirected_minimum(named.select(F.col("group_from").alias("from"), F.col("group_to").alias("to"), "weight"))


def make_graph(bricks: DataFrame, events: DataFrame, bricks_to_mutations: DataFrame, path_threshold: float, edge_threshold: float | None = None) -> DataFrame:
    """Graph of mutation groups from bricks: with and without siblings, each reduced, then brought together.

    bricks_to_mutations: group, brick, mutation (the group's first).
    """
    labelled = bricks_to_mutations.select("brick").distinct()
    reduced = [reduce_graph(brick_haplotype_graph(bricks, events, labelled, edge_threshold, s), bricks_to_mutations, path_threshold) for s in (False, True)]
    return finalise_graph(*reduced, bricks_to_mutations, path_threshold)


def snplist(groups: DataFrame, mutations: DataFrame) -> DataFrame:
    """Mutations with the index of their group; -1 without one. groups: group, mutations (array). A mutation in two groups is an error."""
    placed = groups.select(F.col("group").alias("index"), F.explode("mutations").alias("mutation"))
    counted = placed.groupBy("mutation").agg(F.min("index").alias("index"), F.countDistinct("index").alias("n"))
    checked = counted.withColumn("_ok", F.assert_true(F.col("n") == 1, F.concat(F.lit("two groups hold mutation "), F.col("mutation").cast("string")))).where("_ok is null")
    return mutations.join(checked.select("mutation", "index"), "mutation", "left").withColumn("index", F.coalesce("index", F.lit(-1)).cast("int"))


def mutation_groups(mutations: DataFrame, edges: DataFrame) -> DataFrame:
    """(group, brick, mutation, mutations) of the bricks that carry mutations, in order of their first mutation by position and number."""
    placed = cut(mutations_to_bricks(mutations, edges))
    # bricks are numbered without their lists
    firsts = placed.groupBy("brick").agg(F.min(F.struct("position", "mutation")).alias("first")).select("brick", "first.*")
    order = numbered(firsts, ["position", "mutation"], "group").select(F.col("group").cast("int").alias("group"), "brick", "mutation")
    lists = placed.groupBy("brick").agg(F.array_sort(F.collect_list(F.struct("position", "mutation"))).alias("m"))
    return order.join(lists, "brick").select("group", "brick", "mutation", F.transform("m", lambda x: x["mutation"]).alias("mutations"))


# ---- bricks from tree sequences


TREE_TABLES = "ts_id string, kind string, transition int, left double, right double, parent int, child int, old_parent int, time double, n int"


def tree_rows(ts_id: str, spark: SparkSession, initial: DataFrame, transitions: DataFrame, edges_out: DataFrame, edges_in: DataFrame, node_state: DataFrame, num_samples: int) -> DataFrame:
    """The tables of one tree sequence as rows of TREE_TABLES, checked: whole intervals, ids not below zero."""
    names = [f.split()[0] for f in TREE_TABLES.split(", ")]
    types = dict(f.split() for f in TREE_TABLES.split(", "))

    def part(df: DataFrame, kind: str, **cols: str) -> DataFrame:
        given = {"ts_id": F.lit(ts_id), "kind": F.lit(kind), **{k: F.col(v) for k, v in cols.items()}}
        return df.select(*[given.get(n, F.lit(None)).cast(types[n]).alias(n) for n in names])

    edge = {"left": "left", "right": "right", "parent": "parent", "child": "child"}
    out = part(initial, "initial", **edge).union(part(transitions, "transition", transition="transition", left="left")).union(part(edges_out, "out", transition="transition", child="child")).union(part(edges_in, "in", transition="transition", **edge))
    out = out.union(part(node_state, "state", transition="transition", child="node", old_parent="prev_parent", parent="curr_parent", time="time", n="curr_num_samples"))
    out = out.union(spark.createDataFrame([(num_samples,)], "n int").select(*[{"ts_id": F.lit(ts_id), "kind": F.lit("samples"), "n": F.col("n")}.get(n, F.lit(None)).cast(types[n]).alias(n) for n in names]))
    fine = F.when(F.col("kind").isin("initial", "in"), (F.col("left") < F.col("right")) & (F.col("parent") >= 0) & (F.col("child") >= 0)).when(F.col("kind") == "state", (F.col("child") >= 0) & (F.col("n") >= 0)).when(F.col("kind") == "out", F.col("child") >= 0).when(F.col("kind") == "samples", F.col("n") > 0).otherwise(F.col("left").isNotNull())
    return out.withColumn("_ok", F.assert_true(F.coalesce(fine, F.lit(False)), F.lit("a row of the tree tables is not valid"))).where("_ok is null").drop("_ok")


def brick_edges(trees: DataFrame, threshold: float = 0.0, window_edges: int = bricks.WINDOW_EDGES) -> DataFrame:
    """(ts_id, brick, left, right, parent, child) of tree sequences given as rows of TREE_TABLES.

    An edge is cut where its child's way to the old and to the new ancestors of an edge that begins there parts, if more than ``threshold`` of
    the samples lie below that edge. Windows of neighbouring trees run in parallel.
    """
    state = trees.where("kind = 'state'")
    counts = state.select("ts_id", "transition", "child", "n")
    edges = trees.where("kind in ('initial', 'in')").select("ts_id", "transition", "left", "right", "parent", "child").join(counts, ["ts_id", "transition", "child"], "left").drop("transition")
    nodes = state.groupBy("ts_id", F.col("child").alias("node")).agg(F.max("time").alias("time")).withColumn("is_sample", F.lit(False))
    totals = trees.where("kind = 'samples'").select("ts_id", F.col("n").alias("total"))
    return bricks.cut_edges(edges, bricks.window_places(edges, nodes, totals, threshold, window_edges))


def brick_shares(edges: DataFrame, samples: DataFrame, window_edges: int = bricks.WINDOW_EDGES) -> DataFrame:
    """(ts_id, brick, parent, child, frequency): the share of samples below each brick where it begins.

    edges: ts_id, brick, left, right, parent, child; samples: ts_id, node. Counts of samples are kept up to date from tree to tree: an edge that
    comes or goes changes those above it.
    """
    marked = samples.select("ts_id", "node").distinct().select("ts_id", "node", F.lit(0.0).alias("time"), F.lit(True).alias("is_sample"))
    total = samples.groupBy("ts_id").agg(F.countDistinct("node").alias("total"))
    given = edges.select("ts_id", "left", "right", "parent", "child").withColumn("n", F.lit(None).cast("int"))
    begun = bricks.window_places(given, marked, total, None, window_edges).select("ts_id", "child", F.col("at").alias("left"), "n")
    rows = edges.join(begun, ["ts_id", "child", "left"]).join(F.broadcast(total), "ts_id")  # one row a sequence
    return rows.select("ts_id", "brick", "parent", "child", (F.col("n") / F.col("total")).alias("frequency"))


def brick_events(edges: DataFrame, samples: DataFrame, window_edges: int = bricks.WINDOW_EDGES) -> tuple[DataFrame, DataFrame]:
    """Bricks with their shares (``brick_shares``) and events of bricked edges.

    An event stands for each brick where it begins: its parent brick (none at the root), its children's and its siblings' bricks, those longest there first.
    """
    return brick_shares(edges, samples, window_edges), bricks.family_events(edges)


def thin_graph(edges: DataFrame, missing: DataFrame) -> DataFrame:
    """A weighted graph without the ``missing`` nodes (node), whose neighbours are tied through them.

    Weights are similarities up to 1; as lengths they are 1/w - 1. Two nodes that stay get the shorter of their edge and
    of the ways through missing nodes only, which is what taking these out one by one gives.
    """
    gone = missing.select("node", F.lit(True).alias("gone")).distinct()
    both = edges.where("`from` <> `to`").select("from", "to", "weight")
    both = both.union(both.select(F.col("to").alias("from"), F.col("from").alias("to"), "weight"))
    for end in ("from", "to"):  # numbers of missing nodes become negative
        both = both.join(gone.withColumnRenamed("node", end), end, "left").withColumn(end, F.when(F.col("gone"), haplotype(F.col(end))).otherwise(F.col(end))).drop("gone")
    lengths = both.select("from", "to", (1 / F.col("weight") - 1).alias("weight")).groupBy("from", "to").agg(F.min("weight").alias("weight"))
    lengths = cut(lengths)
    ends = lengths.where("`from` >= 0 and `to` < 0").select(F.col("from").alias("source")).distinct()
    ways = bounded_paths(lengths.where("`from` < 0 or `to` < 0"), ends, float("inf"), lambda v: v < 0, lambda s, v: F.lit(True)).where("vertex >= 0 and vertex <> source")
    every = lengths.where("`from` >= 0 and `to` >= 0").unionByName(ways.select(F.col("source").alias("from"), F.col("vertex").alias("to"), F.col("distance").alias("weight")))
    return undirected_minimum(every).select("from", "to", (1 / (F.col("weight") + 1)).alias("weight"))


def prune_sites(mutations: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """Mutations (mutation, site) whose frequency (mutation, frequency) is at least ``threshold`` away from 0 and 1. A site with two mutations is an error."""
    once = F.assert_true(F.count(F.lit(1)).over(Window.partitionBy("site")) == 1, F.concat(F.lit("several mutations at site "), F.col("site").cast("string")))
    kept = frequency.where(F.col("frequency").between(threshold, 1 - threshold)).select("mutation")
    return mutations.withColumn("_ok", once).where("_ok is null").drop("_ok").join(kept, "mutation", "left_semi")


def brick_identities(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """(brick, identity): neighbouring edges of one child with the same leaves below are one brick, named by its first edge.

    leaves: brick, leaves (sorted array). Stretches are found along the positions of each child.
    """
    along = Window.partitionBy("child").orderBy("left")
    same = (F.lag("leaves").over(along) == F.col("leaves")) & (F.lag("right").over(along) == F.col("left"))
    marked = edges.join(leaves, "brick").withColumn("run", F.sum(F.coalesce((~same).cast("int"), F.lit(1))).over(along))
    return marked.select("brick", F.first("brick").over(Window.partitionBy("child", "run").orderBy("left")).alias("identity"))


def graph_from_trees(trees: DataFrame, samples: DataFrame, mutations: DataFrame, path_threshold: float, edge_threshold: float | None = None, recombination_threshold: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Edges of mutation groups, and the mutations with their group's index, of one tree sequence (rows of TREE_TABLES).

    samples: node; mutations: mutation, position, node.
    """
    return graph_from_bricks(cut(brick_edges(trees, recombination_threshold)), samples, mutations, path_threshold, edge_threshold)


def graph_from_tree_sequence(edges: DataFrame, nodes: DataFrame, samples: DataFrame, mutations: DataFrame, path_threshold: float, edge_threshold: float | None = None, recombination_threshold: float = 0.0, window_edges: int = bricks.WINDOW_EDGES) -> tuple[DataFrame, DataFrame]:
    """As ``graph_from_trees`` from the edges (left, right, parent, child) and nodes (node, time) themselves: counts of samples are found on the way."""
    one = F.lit("all").alias("ts_id")
    marked = nodes.join(samples.select("node").distinct().withColumn("is_sample", F.lit(True)), "node", "left").select(one, "node", "time", F.coalesce("is_sample", F.lit(False)).alias("is_sample"))
    totals = samples.agg(F.countDistinct("node").alias("total")).select(one, "total")
    given = edges.select(one, "left", "right", "parent", "child", F.lit(None).cast("int").alias("n"))
    return graph_from_bricks(cut(bricks.cut_edges(given, bricks.window_places(given, marked, totals, recombination_threshold, window_edges))), samples, mutations, path_threshold, edge_threshold)


def graph_from_bricks(edges: DataFrame, samples: DataFrame, mutations: DataFrame, path_threshold: float, edge_threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges of mutation groups, and the mutations with their group's index, of one sequence's bricked edges."""
    named = samples.join(edges.select("ts_id").distinct(), how="cross")  # one tree sequence
    shares, events = brick_events(edges, named.select("ts_id", "node"))
    groups = cut(mutation_groups(mutations, edges))
    inner = shares.where("frequency > 0 and frequency < 1")
    return make_graph(cut(inner), cut(events), groups, path_threshold, edge_threshold), snplist(groups, mutations)
