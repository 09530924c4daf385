"""Near duplicates against an exact join: crowds of near copies, ids with several texts, hot nodes, recall."""

import numpy as np
import pytest

from blockweave.llm import near_duplicates


def exact_classes(texts, k, percent):
    """Smallest index reachable by links, by counting common shingles."""
    sets, where = [], {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        sets.append(s)
        for x in s:
            where.setdefault(x, []).append(i)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def word(rng):
    return "".join(rng.choice(list("abcdefghij"), 5))


def crowd(rng, n, words, edits):
    base = [word(rng) for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for at in rng.choice(words, rng.integers(0, edits), replace=False):
            copy[at] = word(rng)
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_recall_in_crowds(spark, k, percent):
    rng = np.random.default_rng(11)
    texts = crowd(rng, 400, 150, 16)  # similarities on both sides of the threshold
    for _ in range(40):
        texts += crowd(rng, 5, 80, 6)
    line = " ".join(word(rng) for _ in range(12))
    texts += [f"{line} " + " ".join(word(rng) for _ in range(40)) for _ in range(200)]  # one line that all share
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicate_classes(df, k, percent).collect()}
    want = exact_classes(texts, k, percent)
    assert len(set(want)) > 100 and len([i for i in range(400) if want[i] == i]) > 5
    lost = [i for i, c in enumerate(want) if got[i] != c]
    assert lost == []


def test_an_id_with_several_texts_keeps_all_links(spark):
    rng = np.random.default_rng(12)
    a, b = crowd(rng, 2, 100, 2), crowd(rng, 2, 100, 2)
    df = spark.createDataFrame([(1, a[0]), (1, b[0]), (2, a[1]), (3, b[1]), (None, a[0]), (1, a[0])], "doc_id long, text string")
    got = [(r.doc_id, r.component_id, r.kept) for r in near_duplicates.near_duplicate_classes(df, 5, 80).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, None, True), (1, 1, True)], key=str)
    kept = near_duplicates.keep_representatives(df, 5, 80).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "1", "1", "None"]


def test_a_text_goes_and_another_of_its_id_stays(spark):
    rng = np.random.default_rng(13)
    a, b = crowd(rng, 2, 100, 2), " ".join(word(rng) for _ in range(60))
    df = spark.createDataFrame([(1, a[0]), (5, a[1]), (5, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text == b) for r in near_duplicates.keep_representatives(df).collect()) == [(1, False), (5, True)]


def test_node_comparison_over_batches():
    import pyarrow as pa

    rng = np.random.default_rng(14)
    nodes = np.sort(rng.integers(0, 40, 300))
    tokens = rng.integers(0, 3, (300, 8))
    rows = pa.record_batch([pa.array(nodes), pa.array(np.arange(300)), pa.array([t.astype(np.uint32).tobytes() for t in tokens])], names=["node", "member", "tokens"])
    slices = lambda r: (r.slice(at, 37) for at in range(0, r.num_rows, 37))
    got = {(a, b): n for out in near_duplicates._Compare(5)(slices(rows)) for a, b, n in zip(*(out.column(i).to_pylist() for i in range(3)), strict=True)}
    for i in range(300):
        mine = [(int((tokens[i] == tokens[j]).sum()), j) for j in range(300) if j != i and nodes[i] == nodes[j]]
        best = max((n for n, _ in mine), default=0)
        assert best < 5 or any(got.get((min(i, j), max(i, j))) == n for n, j in mine if n == best)
    assert all(n >= 5 and (tokens[a] == tokens[b]).sum() == n and nodes[a] == nodes[b] for (a, b), n in got.items())

    few = np.flatnonzero(np.arange(300) % 7 == 0)
    order = sorted([(nodes[i], 0, i) for i in few] + [(nodes[i], 1, i) for i in range(300)])
    at = [i for _, _, i in order]
    rows = pa.record_batch([pa.array(nodes[at]), pa.array([0] * len(at)), pa.array([bool(f) for _, f, _ in order]), pa.array(at), pa.array(np.array(at) % 5), pa.array([tokens[i].astype(np.uint8).tobytes() for i in at]), pa.array([np.int64(i % 3).tobytes() for i in at])], names=["node", "part", "follows", "member", "component", "tokens", "before"])
    got = {(a, b) for out in near_duplicates._Against(5)(slices(rows)) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)}
    assert got == {(min(i, j), max(i, j)) for i in few.tolist() for j in range(300) if nodes[i] == nodes[j] and i % 5 != j % 5 and i % 3 != j % 3 and (tokens[i] == tokens[j]).sum() >= 5}
