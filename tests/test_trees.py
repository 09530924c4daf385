"""Tree sequences: files, bricks by windows and events against plain versions that go through all trees."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.operators import bricks, graphs
from blockweave.plans import registry
from blockweave.plans import trees as tree_queries  # noqa: F401  registers its queries
from blockweave.sources import trees as T

EDGES = "ts_id string, left double, right double, parent int, child int, n int"


def made_sequence(seed, samples=6, inner=6, breaks=14):
    """Random trees in which a few nodes get other, older parents at each breakpoint."""
    rng = np.random.default_rng(seed)
    n = samples + inner
    time = np.concatenate([np.zeros(samples), np.sort(rng.integers(1, 5, inner)).astype(float)])  # with ties
    time[-1] = 9.0
    older = {c: [p for p in range(n) if time[p] > time[c]] for c in range(n - 1)}
    parent = {c: int(rng.choice(older[c])) for c in range(n - 1)}
    at, open_, edges, all_trees = 0.0, {}, [], []
    points = np.cumsum(rng.integers(1, 4, breaks)) * 1.5
    for k, end in enumerate(points):
        if k:
            for c in rng.choice(n - 1, int(rng.integers(1, 4)), replace=False).tolist():
                parent[c] = int(rng.choice(older[c]))
        for c, p in parent.items():
            if c in open_ and open_[c][1] != p:
                edges.append((open_[c][0], at, open_[c][1], c))
                del open_[c]
            open_.setdefault(c, (at, p))
        all_trees.append((at, float(end), dict(parent)))
        at = float(end)
    edges += [(left, at, p, c) for c, (left, p) in open_.items()]
    return time, list(range(samples)), sorted(edges), all_trees


def below(tree, samples):
    count = dict.fromkeys(range(50), 0)
    for s in samples:
        node = s
        while node != -1:
            count[node] += 1
            node = tree.get(node, -1)
    return count


def plain_bricks(time, samples, edges, all_trees, threshold):
    now, done = {c: [a, b, p] for a, b, p, c in edges if a == 0}, []
    for (_, _, old_tree), (at, _, tree) in zip(all_trees, all_trees[1:], strict=False):
        for c, (a, b, p) in list(now.items()):
            if b == at:
                done.append((a, b, p, c))
                del now[c]
        count = below(tree, samples)
        come = [(a, b, p, c) for a, b, p, c in edges if a == at]
        for a, b, p, c in come:
            now[c] = [a, b, p]
            if count[c] / len(samples) <= threshold:
                continue
            new, old = p, old_tree.get(c, -1)
            while new != old and -1 not in (new, old):
                moved = old if time[old] < time[new] else new
                if moved in now and now[moved][0] < at < now[moved][1]:
                    done.append((now[moved][0], at, now[moved][2], moved))
                    now[moved][0] = at
                if moved == old:
                    old = old_tree.get(old, -1)
                else:
                    new = tree.get(new, -1)
    return sorted(done + [(a, b, p, c) for c, (a, b, p) in now.items()])


def frames(spark, sequences):
    rows = [(f"s{k}", *e, None) for k, (_, _, edges, _) in enumerate(sequences) for e in edges]
    nodes = [(f"s{k}", i, float(t), i in samples) for k, (time, samples, _, _) in enumerate(sequences) for i, t in enumerate(time)]
    totals = [(f"s{k}", len(s[1])) for k, s in enumerate(sequences)]
    return spark.createDataFrame(rows, EDGES).repartition(3), spark.createDataFrame(nodes, "ts_id string, node int, time double, is_sample boolean"), spark.createDataFrame(totals, "ts_id string, total int")


@pytest.mark.parametrize("size,threshold", [(5, 0.0), (5, 0.4), (10_000, 0.0)])
def test_bricks_by_windows_equal_the_sequential_ones(spark, size, threshold):
    sequences = [made_sequence(k) for k in range(3)]
    edges, nodes, totals = frames(spark, sequences)
    if size == 5:  # windows smaller than a tree
        assert bricks.tree_windows(edges, 5).select("ts_id", "window").distinct().count() >= 3
    got = bricks.cut_edges(edges, bricks.window_places(edges, nodes, totals, threshold, size)).collect()
    for k, s in enumerate(sequences):
        own = sorted((r.brick, r.left, r.right, r.parent, r.child) for r in got if r.ts_id == f"s{k}")
        assert [r[1:] for r in own] == plain_bricks(*s, threshold) and [r[0] for r in own] == list(range(len(own)))
        assert threshold or len(own) > len(s[2])  # some are cut


def test_many_windows_of_one_sequence(spark):
    one = made_sequence(11, samples=4, inner=3, breaks=140)
    edges, nodes, totals = frames(spark, [one])
    assert bricks.tree_windows(edges, 1).select("window").distinct().count() >= 10
    got = bricks.cut_edges(edges, bricks.window_places(edges, nodes, totals, 0.0, 1)).orderBy("brick").collect()
    assert [(r.left, r.right, r.parent, r.child) for r in got] == plain_bricks(*one, 0.0)


def test_events_and_shares(spark):
    time, samples, edges, all_trees = made_sequence(5, breaks=30)
    cut = plain_bricks(time, samples, edges, all_trees, 0.0)
    rows = spark.createDataFrame([("x", k, *e) for k, e in enumerate(cut)], "ts_id string, brick int, left double, right double, parent int, child int")
    shares, events = graphs.brick_events(rows, spark.createDataFrame([("x", s) for s in samples], "ts_id string, node int"), 1)
    shares, events = {r.brick: r.frequency for r in shares.collect()}, {r.focal_brick: r for r in events.collect()}
    for k, (left, _, parent, child) in enumerate(cut):
        tree = next(t for a, b, t in all_trees if a <= left < b)
        assert shares[k] == below(tree, samples)[child] / len(samples)
        here = [(e, a) for e, (a, b, _, _) in enumerate(cut) if a <= left < b]
        by = lambda end, node: [e for a, e in sorted((a, e) for e, a in here if cut[e][end] == node)]
        assert events[k].parent_brick == next(iter(by(3, parent)), None)
        assert events[k].child_bricks == by(2, child) and events[k].sibling_bricks == by(2, parent)
    assert [events[k].event for k in sorted(events, key=lambda k: (cut[k][0], k))] == list(range(len(cut)))


# ---- files


def container(arrays):
    """fixed: header, descriptors in the order of the names, names, arrays at multiples of 8"""
    names = sorted(arrays)
    at = 64 + 64 * len(names)
    keys, table, body = b"", b"", b""
    for n in names:
        keys += n.encode()
    place = at + len(keys)
    key_at = at
    for n in names:
        a = arrays[n]
        pad = -(place + len(body)) % 8
        body += b"\0" * pad
        table += struct.pack("<B7xQQQQ24x", T.TYPES.index(a.dtype.newbyteorder("<").str.replace("|", "<")), key_at, len(n), place + len(body), len(a))
        key_at += len(n)
        body += a.tobytes()
    size = place + len(body)
    return struct.pack("<8sHHIQ40x", T.MAGIC, 1, 0, len(names), size) + table + keys + body


def as_file(path, time, samples, edges, mutations):
    """mutations: (site position, node, ancestral, derived)"""
    text = lambda values: (np.frombuffer("".join(values).encode(), np.int8), np.cumsum([0, *map(lambda v: len(v.encode()), values)]).astype(np.uint32))
    ancestral, ancestral_at = text([m[2] for m in mutations])
    derived, derived_at = text([m[3] for m in mutations])
    left, right, parent, child = zip(*edges, strict=True)
    raw = container({
        "format/name": np.frombuffer(b"tskit.trees", np.int8), "sequence_length": np.array([max(right)]), "nodes/time": np.array(time), "nodes/flags": np.array([int(i in samples) for i in range(len(time))], np.uint32),
        "edges/left": np.array(left), "edges/right": np.array(right), "edges/parent": np.array(parent, np.int32), "edges/child": np.array(child, np.int32),
        "sites/position": np.array([m[0] for m in mutations]), "sites/ancestral_state": ancestral, "sites/ancestral_state_offset": ancestral_at,
        "mutations/site": np.arange(len(mutations), dtype=np.int32), "mutations/node": np.array([m[1] for m in mutations], np.int32), "mutations/derived_state": derived, "mutations/derived_state_offset": derived_at,
    })
    path.write_bytes(raw)
    return raw


def test_files_are_read_by_ranges(spark, tmp_path):
    time, samples, edges, all_trees = made_sequence(3)
    mutations = [(0.5, 0, "A", "C"), (2.0, 8, "ACG", ""), (3.25, 1, "é", "T")]
    raw = as_file(tmp_path / "x.trees", time, samples, edges, mutations)
    path = str(tmp_path / "x.trees")
    got = T.read_trees(spark, path, "edges", 7)
    assert got.rdd.getNumPartitions() == -(-len(edges) // 7)
    assert [tuple(r) for r in got.orderBy("edge").collect()] == [(k, *e) for k, e in enumerate(edges)]
    nodes = T.read_trees(spark, path, "nodes")
    assert [r.time for r in nodes.orderBy("node").collect()] == list(time) and sorted(r.node for r in T.sample_nodes(nodes).collect()) == samples
    placed = T.placed_mutations(T.read_trees(spark, path, "mutations", 2), T.read_trees(spark, path, "sites", 1))
    assert [tuple(r) for r in placed.orderBy("mutation").collect()] == [(k, x, a, k, d, node) for k, (x, node, a, d) in enumerate(mutations)]
    tables = T.tree_tables(got)
    assert tables["transitions"].count() == len(all_trees) - 1 - sum(a[2] == b[2] for a, b in zip(all_trees, all_trees[1:], strict=False))
    assert tables["initial_edges"].count() == sum(e[0] == 0 for e in edges) and tables["edges_in"].count() == sum(e[0] > 0 for e in edges)
    assert tables["edges_out"].count() == sum(e[1] < max(x[1] for x in edges) for e in edges)
    for bad, what in ((b"x" * 200, "no tree sequence"), (raw[:-8], "cut short"), (raw[:8] + b"\x02" + raw[9:], "version")):
        (tmp_path / "bad.trees").write_bytes(bad)
        with pytest.raises(Exception, match=what):
            T.read_trees(spark, str(tmp_path / "bad.trees"), "edges").count()
    with pytest.raises(ValueError, match="no table"):
        T.read_trees(spark, path, "migrations")


def test_graph_of_a_file_equals_that_of_its_tables(spark, tmp_path):
    from blockweave.__main__ import main

    # samples 0, 1, 2 under 3 = (0, 1) and the root 4 = (3, 2)
    edges = [(0.0, 1.0, 3, 0), (0.0, 1.0, 3, 1), (0.0, 1.0, 4, 2), (0.0, 1.0, 4, 3)]
    as_file(tmp_path / "x.trees", [0.0, 0.0, 0.0, 1.0, 2.0], [0, 1, 2], edges, [(0.1, 0, "A", "T"), (0.2, 3, "A", "T"), (0.3, 1, "A", "T")])
    main(["reduce", str(tmp_path / "x.trees"), "100", f"{tmp_path}/out"])
    got = {(r.a, r.b): r.w for r in spark.read.csv(f"{tmp_path}/out", schema="a int, b int, w double").collect()}
    assert got[0, 1] == pytest.approx(np.log(4), abs=1e-4) and (1, 2) in got


def test_siblings_share_one_list(spark):
    n = 500
    rows = spark.createDataFrame([("x", k, 0.0, 9.0, 10_000 if k else -1, k if k else 10_000) for k in range(n + 1)], "ts_id string, brick int, left double, right double, parent int, child int")
    events, lists = bricks.families(rows)
    assert "sibling_bricks" not in events.columns and events.count() == n + 1
    assert {(r.node, len(r.bricks)) for r in lists.collect()} == {(10_000, n), (-1, 1)}
    got = {r.focal_brick: r for r in bricks.family_events(rows).collect()}
    assert all(got[k].sibling_bricks == list(range(1, n + 1)) and got[k].parent_brick == 0 and not got[k].child_bricks for k in range(1, n + 1))
    assert got[0].child_bricks == list(range(1, n + 1)) and got[0].sibling_bricks == [0] and got[0].parent_brick is None


def test_shares_of_bricks_make_no_families(spark, monkeypatch):
    def never(*_):
        raise AssertionError("shares need no families")

    monkeypatch.setattr(bricks, "family_events", never)
    assert registry.QUERIES["a16_brick_shares"](spark, "/root/testdata/sf0.001").where("frequency > 0").count() > 0
