"""Conversation tries, mixtures and filter audits against plain versions."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.llm import conversation_trie, filter_audit, mixing

WORD = re.compile("[^\x20\x09-\x0d]+")
CONVS = "conv_id long, turn long, role string, text string, size string, d int"


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        rebuilt[c] = own.get(base, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out, below = {}, defaultdict(lambda: [0, 0, 0])
    for node in sorted(members, key=len, reverse=True):
        n, leaves, saved = below[node]
        saved += (len(members[node]) - 1) * (len(WORD.findall(node[-1][1])) if node else 0)
        leaves = leaves or 1
        if node:
            up = below[node[:-1]]
            up[0], up[1], up[2] = up[0] + 1, up[1] + leaves, up[2] + saved
        ends = hashlib.sha256(",".join(str(c) for c in sorted(c for c in members[node] if len(rebuilt[c]) == len(node))).encode()).hexdigest()
        out[node] = (min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), n, leaves, saved, ends)
    return sorted(out.values(), key=str)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made_conversations():
    rng = np.random.default_rng(3)
    rows = []
    for c in range(90):
        for t in range(int(rng.integers(1, 7))):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", " ".join(f"w{k}" for k in rng.integers(0, 2, int(rng.integers(1, 4)))), "x", 1))
    rows += [(200 + k, t, "user", f"the same {t}", None, None) for k in range(30) for t in range(9)]  # copies, and a shared stem
    rows += [(300 + k, t, "user", f"stem {t}" if t < 12 else f"branch {k % 7} {t}", None, None) for k in range(40) for t in range(16)]
    rows += [(500, 3, None, None, None, None), (500, None, "user", "first\x0bof all", None, None), (500, 3, "a", "tie", None, None), (500, 3, "a", "tie", None, None)]
    rows += [(None, 0, "user", "of nobody", None, None), (601, 0, "user", "", None, None), (602, 0, None, None, None, None), (-7, 0, "user", "below zero", None, None)]
    return rows + [(700, t, "user", f"long {t}", None, None) for t in range(300)]


@pytest.mark.parametrize("limit", [conversation_trie.LIMIT, 60, 3])
def test_trie_equals_the_plain_one(spark, limit):
    rows = made_conversations()
    got = conversation_trie.conversation_trie(spark.createDataFrame(rows, CONVS).repartition(5), limit=limit, bucket=40)
    assert as_rows(got) == plain_trie(rows)


def test_trie_of_little(spark):
    make = lambda rows: as_rows(conversation_trie.conversation_trie(spark.createDataFrame(rows, CONVS)))
    assert make([]) == []
    assert make([(None, 1, "user", "x", None, None)]) == []
    turnless = next(c for c in range(1000, 1100) if c % 20 and zlib.crc32(str(c).encode()) % 4 > 1)
    rows = [(turnless, 0, "user", "taken away", None, None)]
    assert make(rows) == plain_trie(rows) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
    rows = [(20, 0, "user", "word " * 200_000, None, None), (21, 0, "user", "other", None, None)]
    assert make(rows) == plain_trie(rows)


# ---- mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, part string"


def plain_targets(sizes):
    """By sharing out anew what capped sources can't take, until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * share > 3 * sizes[s]}
        if not above:
            return target | {s: weight[s] * share for s in free}
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= above
    return target


def made_documents(n=400):
    rng = np.random.default_rng(1)
    rows = [(k, "w " * int(rng.integers(0, 60)), "en", "hot" if k % 3 else f"s{k % 17}", None, "x", "y") for k in range(n)]
    rows += [(n + 1, None, None, None, None, None, None), (n + 2, "", "", "", 0, "", ""), (n + 3, "a b c " * 30_000, None, "s1", None, None, None), (None, "no id", None, "s2", None, None, None), (None, "no id", None, "s2", None, None, None)]
    return rows + [(n + 4, "x\x0by\tz", None, None, None, None, None), (7, "w w w", "en", "hot", None, None, None), (7, "w w w", "en", "hot", None, None, None), (n + 5, "é 漢字", None, "Ω", None, None, None)]


@pytest.mark.parametrize("shards,block", [(8, 256), (5, 64), (1, 2048)])
def test_mix_meets_targets_and_quotas(spark, shards, block):
    rows = made_documents()
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    got = mixing.mix_documents(df, shards, block).collect()
    size = lambda text: len(WORD.findall(text or ""))
    sizes = Counter()
    for _, text, _, source, *_ in rows:
        sizes[source] += size(text)
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    taken, quota, by_shard = Counter(), defaultdict(set), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(d.words for d in r.draws) and len({d["pass"] for d in r.draws}) == len(r.draws)
        taken[r.source] += r.taken
        for d in r.draws:
            quota[r.source, d.block].add(d.shard)
            assert 0 <= d.shard < shards
    assert all(abs(taken[s] - t) <= 0.5 for s, t in want.items())
    assert all(len(s) == 1 for s in quota.values())  # a block is one shard's
    again = mixing.mix_documents(df.repartition(3), shards, block).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_quotas_are_exact_in_both_margins(spark):
    rng = np.random.default_rng(2)
    quotas = [(k, int(q)) for k, q in enumerate(rng.integers(0, 40, 200))]  # a tree of two levels
    rows = mixing.shard_quotas(spark.createDataFrame(quotas, "rank long, quota long"), 6, 1).collect()
    assert {r["rank"]: sum(r.shards) for r in rows} == dict(quotas) and all(x >= 0 for r in rows for x in r.shards)
    whole = sum(q for _, q in quotas)
    assert [sum(r.shards[k] for r in rows) for k in range(6)] == [whole * (k + 1) // 6 - whole * k // 6 for k in range(6)]


def test_draws_are_hypergeometric(spark):
    from math import comb

    n = 20_000
    for m, k, d in ((50, 20, 12), (7, 3, 6), (9, 8, 8)):
        got = spark.range(n).select(mixing.hypergeometric(F.lit(m), F.lit(k), F.lit(d), mixing.uniform(3, F.col("id"))).alias("x")).groupBy("x").count().collect()
        for r in got:
            p = comb(k, r.x) * comb(m - k, d - r.x) / comb(m, d)
            assert abs(r["count"] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3
    big = spark.range(500).select(mixing.hypergeometric(F.lit(10**10), F.lit(10**9), F.lit(10**6), mixing.uniform(4, F.col("id"))).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(big[0] - 1e5) < 70 and 240 < big[1] < 360  # 300 by formula


def test_mix_of_little(spark):
    assert mixing.mix_documents(spark.createDataFrame([], DOCS)).collect() == []
    got = mixing.mix_documents(spark.createDataFrame([(1, "", None, "a", None, None, None), (2, None, None, None, None, None, None)], DOCS)).collect()
    assert [(r.size, r.target, r.taken, r.draws) for r in got] == [(0, 0.0, 0, [])] * 2


def test_mix_with_many_sources_and_its_files(spark, tmp_path, monkeypatch):
    rows = made_documents(120)
    df = spark.createDataFrame(rows, DOCS)
    few = mixing.mix_documents(df, 4, 64)
    monkeypatch.setattr(mixing, "FEW_SOURCES", 3)
    many = mixing.mix_documents(df, 4, 64)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    known = few.where("doc_id is not null and doc_id <> 7")
    mixing.write_mix(df.where("doc_id is not null and doc_id <> 7"), known, str(tmp_path / "mix"), 2)
    words = spark.read.parquet(str(tmp_path / "mix")).groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n"))
    assert {r.doc_id: r.n for r in words.collect()} == {r.doc_id: r.taken for r in known.collect() if r.taken}


# ---- filters


def plain_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    docs = []
    for i, text, _, source, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > first[text]}
        docs.append((source or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        own, cells, by_filter = [d for d in docs if d[0] == part], {}, Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                n_fail = sum(f in d[1] for d in own)
                cells[order, step] = (len(left) - len(gone), len(gone), n_fail - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone))
                by_filter[f] += len(gone)
                left = [d for d in left if f not in d[1]]
        out += [(part, o, s, *v, by_filter[o[s - 1]]) for (o, s), v in cells.items()]
    return sorted(out)


def test_audit_equals_the_plain_one(spark):
    rng = np.random.default_rng(4)
    texts = ["few words", "A LOUD ONE", "w " * 250, " ".join(f"w{k}" for k in range(260)), " ".join(f"W{k}" for k in range(260)), "a|b", "# " * 300, "", None, "é漢 " * 220]
    rows = [(k, texts[int(rng.integers(0, len(texts)))], None, [None, "", "a", "b"][k % 4], None, None, "clash") for k in range(200)]
    rows += [(5, texts[0], None, "a", None, None, None), (5, texts[0], None, "a", None, None, None), (None, texts[2], None, "b", None, None, None), (None, None, None, None, None, None, None), (300, "x" * 400_000, None, "long", None, None, None), (301, "w " * 200_000, None, "long", None, None, None)]
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 150, 2)] + [(3, None, 1), (4, 0, 1), (4, 1, None), (None, 1, 1), (9999, 1, 1)]
    got = filter_audit.audit_filters(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, labels)
    assert filter_audit.audit_filters(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() == []
