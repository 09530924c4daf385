"""Bricks of tree sequences, window by window.

A tree sequence is cut into windows of neighbouring trees. A window's task gets the edges that touch it, among them those that cross its
left border: they are the tree there. It goes through its own trees only, keeps parents and sample counts up to date along the paths that
change, and yields where edges have to be cut and how many samples lie below a node where an edge begins. Edges are then cut by a
range join with these places, whichever windows they cross. So a long sequence is the work of many tasks, and none holds more
than a tree and a window.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockweave.operators.joins import range_join
from blockweave.operators.lineage import cut
from blockweave.operators.ordering import last_before, numbered

#: Edges that begin in a window.
WINDOW_EDGES = 100_000
PLACES = "ts_id string, child int, at double, n int, is_cut boolean"


def tree_windows(edges: DataFrame, size: int = WINDOW_EDGES) -> DataFrame:
    """Edges (ts_id, left, right, ...) repeated for each window that they touch, with window, lower and upper (null: the end).

    A window begins where every ``size``-th edge does; it has at least twice as many edges as the largest first tree, so that trees at
    borders don't outweigh what happens between them. An edge that ends where a window begins touches it.
    """
    first = edges.join(edges.groupBy("ts_id").agg(F.min("left").alias("left")), ["ts_id", "left"], "left_semi").groupBy("ts_id").count().agg(F.max("count")).first()[0] or 0
    lefts = edges.groupBy("ts_id", "left").agg(F.count(F.lit(1)).alias("begin"))
    within = Window.partitionBy("ts_id").orderBy("left").rowsBetween(Window.unboundedPreceding, -1)  # one row a breakpoint
    window = (F.coalesce(F.sum("begin").over(within), F.lit(0)) / max(size, 2 * first)).cast("long")
    borders = cut(lefts.withColumn("window", window).groupBy("ts_id", "window").agg(F.min("left").alias("lower")))
    upper = F.lead("lower").over(Window.partitionBy("ts_id").orderBy("window"))
    spans = borders.withColumn("upper", upper)
    marks = borders.select("ts_id", F.col("lower").alias("at"), F.lit(0).alias("point"), "window")
    ends = edges.select("ts_id", F.explode(F.array("left", "right")).alias("at")).distinct().select("ts_id", "at", F.lit(1).alias("point"), F.lit(None).cast("long").alias("window"))
    place = cut(last_before(marks.unionByName(ends), ["ts_id", "at", "point"], F.col("window"), "in_window").where("point = 1").select("ts_id", "at", "in_window"))
    both = edges.join(place.withColumnsRenamed({"at": "left", "in_window": "_from"}), ["ts_id", "left"]).join(place.withColumnsRenamed({"at": "right", "in_window": "_to"}), ["ts_id", "right"])
    return both.withColumn("window", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to").join(F.broadcast(spans) if spans.count() <= 50_000 else spans, ["ts_id", "window"])


def _changes(pdf: pd.DataFrame, threshold: float | None) -> Iterator[tuple[int, float, int, bool]]:
    """(node, place, samples below it, cut or begin) of one window. Without a threshold nothing is cut."""
    lower, upper = pdf["lower"].iloc[0], pdf["upper"].iloc[0]
    upper = float("inf") if pd.isna(upper) else upper
    start, total = pdf["start"].iloc[0], pdf["total"].iloc[0]
    parent: dict[int, int] = {}
    time: dict[int, float] = {}
    count: defaultdict[int, int] = defaultdict(int)
    came, went = defaultdict(list), defaultdict(list)
    cols = ("left", "right", "parent", "child", "parent_time", "child_time", "parent_sample", "child_sample", "n")
    for left, right, p, c, pt, ct, ps, cs, n in pdf.sort_values(["left", "right", "parent", "child"])[list(cols)].itertuples(index=False):
        time[p], time[c] = pt, ct
        count[p], count[c] = max(count[p], ps), max(count[c], cs)
        if left < lower:
            parent[c] = p
        elif left < upper:
            came[left].append((p, c, n))
        if lower <= right < upper:
            went[right].append(c)
    waiting = defaultdict(int)  # children still to be counted
    for p in parent.values():
        waiting[p] += 1
    ready = [c for c in parent if not waiting[c]]
    while ready:
        c = ready.pop()
        p = parent.get(c, -1)
        if p != -1:
            count[p] += count[c]
            waiting[p] -= 1
            if not waiting[p]:
                ready.append(p)

    def carry(node: int, change: int) -> None:
        while node != -1:
            count[node] += change
            node = parent.get(node, -1)

    for at in sorted({*came, *went}):
        before: dict[int, int] = {}
        for c in went.get(at, ()):
            before[c] = parent.pop(c)
            carry(before[c], -count[c])
        for p, c, _ in came.get(at, ()):
            before.setdefault(c, -1)
            parent[c] = p
            carry(p, count[c])
        for p, c, n in came.get(at, ()):
            yield c, at, count[c], False
            if threshold is None or at == start or (count[c] if pd.isna(n) else n) / total <= threshold:
                continue
            new, old = p, before[c]
            while new != old and -1 not in (new, old):
                if time[old] < time[new]:  # the younger one goes up; at equal times the new one
                    yield old, at, count[old], True
                    old = before.get(old, parent.get(old, -1))
                else:
                    yield new, at, count[new], True
                    new = parent.get(new, -1)


def window_places(edges: DataFrame, nodes: DataFrame, totals: DataFrame, threshold: float | None, size: int = WINDOW_EDGES) -> DataFrame:
    """Rows of PLACES: where edges begin, and where the way from a child to its old and its new ancestors makes a cut.

    edges: ts_id, left, right, parent, child, n (samples below the child where it begins, or null to count them); nodes: ts_id, node, time,
    is_sample; totals: ts_id, total (samples).
    """
    side = lambda end: nodes.select("ts_id", F.col("node").alias(end), F.col("time").alias(f"{end}_time"), F.col("is_sample").cast("int").alias(f"{end}_sample"))
    known = edges.join(side("parent"), ["ts_id", "parent"], "left").join(side("child"), ["ts_id", "child"], "left").fillna(0, ["parent_sample", "child_sample"]).fillna(0.0, ["parent_time", "child_time"])
    starts = edges.groupBy("ts_id").agg(F.min("left").alias("start")).join(totals, "ts_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(list(_changes(pdf, threshold)), columns=["child", "at", "n", "is_cut"])
        out.insert(0, "ts_id", pdf["ts_id"].iloc[0])
        return out

    return tree_windows(cut(known), size).join(F.broadcast(starts), "ts_id").groupBy("ts_id", "window").applyInPandas(run, PLACES)


def cut_edges(edges: DataFrame, places: DataFrame) -> DataFrame:
    """(ts_id, brick, left, right, parent, child): edges cut at the places inside them that their child has; numbered by place within a sequence."""
    named = cut(edges.select("ts_id", "left", "right", "parent", "child").withColumn("edge", F.monotonically_increasing_id()))
    points = places.where("is_cut").select(F.struct("ts_id", "child").alias("chrom"), F.col("at").alias("pos")).distinct()
    ranges = named.select(F.struct("ts_id", "child").alias("chrom"), F.col("left").alias("start"), F.col("right").alias("end"), "edge")
    inside = range_join(points, ranges).where("pos > start").select("edge", F.col("pos").alias("at"))
    along = Window.partitionBy("edge").orderBy("at")
    pieces = named.select("edge", F.col("left").alias("at")).union(inside).withColumn("next", F.lead("at").over(along))
    whole = pieces.join(named, "edge").select("ts_id", F.col("at").alias("left"), F.coalesce("next", "right").alias("right"), "parent", "child")
    order = numbered(whole, ["ts_id", "left", "right", "parent", "child"], "nr")
    begin = order.groupBy("ts_id").agg(F.min("nr").alias("begin"))
    return order.join(F.broadcast(begin), "ts_id").select("ts_id", (F.col("nr") - F.col("begin")).cast("int").alias("brick"), "left", "right", "parent", "child")  # one row a sequence


def families(bricks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events without their lists (ts_id, event, focal_brick, parent_brick, parent, child, left), and the lists: the bricks below a node at a place.

    lists: ts_id, node, at, bricks (those longest there first). Siblings that begin at one place have one list, which is made once; ``with_lists`` puts
    lists to events. Bricks meet by range joins in which a node takes the chromosome's place: work follows the families, not bricks by intervals.
    """
    kept = cut(bricks.select("ts_id", "brick", "left", "right", "parent", "child"))
    at = lambda *nodes: kept.select("ts_id", F.explode(F.array(*nodes)).alias("node"), F.col("left").alias("pos")).distinct().select(F.struct("ts_id", "node").alias("chrom"), "pos", "ts_id", "node")
    held = lambda node: kept.select(F.struct("ts_id", node).alias("chrom"), F.col("left").alias("start"), F.col("right").alias("end"), F.col("brick").alias("other"))
    found = range_join(at("parent", "child"), held("parent")).groupBy("ts_id", "node", "pos").agg(F.array_sort(F.collect_list(F.struct("start", "other"))).alias("x"))
    lists = cut(found.select("ts_id", "node", F.col("pos").alias("at"), F.transform("x", lambda x: x["other"]).alias("bricks")))
    above = range_join(at("parent"), held("child")).select("ts_id", F.col("node").alias("parent"), F.col("pos").alias("left"), F.col("other").alias("parent_brick"))
    order = numbered(kept.join(above, ["ts_id", "parent", "left"], "left").drop("right"), ["ts_id", "left", "brick"], "nr")
    begin = order.groupBy("ts_id").agg(F.min("nr").alias("begin"))
    return order.join(F.broadcast(begin), "ts_id").select("ts_id", (F.col("nr") - F.col("begin")).cast("int").alias("event"), F.col("brick").alias("focal_brick"), "parent_brick", "parent", "child", "left"), lists


def with_lists(events: DataFrame, lists: DataFrame) -> DataFrame:
    """Events of ``families`` with child_bricks and sibling_bricks; null where a list is empty. Only a list a family is shuffled, not one a brick."""
    for node, name in (("child", "child_bricks"), ("parent", "sibling_bricks")):
        events = events.join(lists.select("ts_id", F.col("node").alias(node), F.col("at").alias("left"), F.col("bricks").alias(name)), ["ts_id", node, "left"], "left")
    return events.select("ts_id", "event", "focal_brick", "parent_brick", "child_bricks", "sibling_bricks")


def family_events(bricks: DataFrame) -> DataFrame:
    """ts_id, event, focal_brick, parent_brick, child_bricks and sibling_bricks of each brick, as they are where it begins."""
    none = F.array().cast("array<int>")
    lists = [F.coalesce(c, none).alias(c) for c in ("child_bricks", "sibling_bricks")]
    return with_lists(*families(bricks)).select("ts_id", "event", "focal_brick", "parent_brick", *lists)
