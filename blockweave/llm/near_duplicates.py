"""Near-duplicate classes by a chosen-path set similarity join.

A text's set is its distinct word shingles; texts with equal sets are one member from the start.
Each of TREES independent trees branches the members along their minwise tokens: two sets of Jaccard
similarity s take the same branch with probability s a level. The first PATH levels are one step.

1. Nodes of at most SMALL members are compared exhaustively on their sketches, within the node; each member is
   then confirmed against its likeliest partner, and after that all likely pairs whose ends are still apart.
2. Members of larger nodes are confirmed against their most central member.
3. Members of large nodes that still hold several components start deeper trees with hash functions of
   their own, as many as it takes for a pair at the threshold to be missed with probability MISS; of DEPTHS the
   depth is taken that costs the fewest rows. In each node those outside of its largest component are
   compared with all members, CROWD of them at a time, while the others stream by.

After the first links, sketches are WIDE bytes long, so that few pairs below the threshold are likely ones.

Every link is confirmed on the full sets of both texts. Pairs that are already in one component
aren't confirmed again, as classes and not links are asked for. Recall: a pair at the threshold t misses
all trees with probability (1 - t**PATH)**TREES = 6e-7 for t = 0.8, and in a crowd MISS = 1e-3 a pair,
while a class is lost only if each link that would join it is. Sets are told by 64-bit sums of their shingles' hashes.

Cases: a text of fewer words than a shingle has its whole word sequence as the one shingle; null
texts, empty ones and ones without words have the empty set and are linked with nothing; rows with
the same id and text are one document, an id with several texts has a class for each; null ids stay
alone with a null class; ties go to smaller members; an empty table gives no rows; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import compact, map_slices, materialised
from blockweave.llm.components import extend_components

TREES, PATH, SMALL = 20, 3, 12
POOL = TREES * PATH
#: Deeper trees: members compared at a time, probability of missing a pair at the threshold, depths to choose from.
CROWD, MISS, DEPTHS = 128, 1e-3, (4, 6, 8, 12, 16, 24)
#: Bytes of the sketches for close estimates.
WIDE = 1024
#: Likely pairs: at most so many standard deviations below the agreement that a pair at the threshold is expected to have.
DEVIATIONS = 5
#: Size of the bitmap that prefilters texts by id.
BITS = 1 << 21
SEED = 7

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_ONE = np.uint64(1)


def _draw(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit hashes of the distinct shingles of texts.

    A word is hashed as a polynomial over random values of its bytes; prefix sums over the text
    give all words at once.
    """

    def __init__(self, k: int):
        self.k = k
        self.byte = _draw(SEED, 256)
        self.place = _draw(SEED + 1, k + 1) | _ONE
        self.base = int(_draw(SEED + 2, 1)[0] | _ONE)
        self.inverse = pow(self.base, -1, 2**64)
        self.powers, self.backs = self._powers(1 << 14)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for b in (self.base, self.inverse):
            p = np.ones(n, np.uint64)
            have, step = 1, b
            while have < n:  # doubling: p[have:2*have] = p[:have] * b**have
                more = min(have, n - have)
                p[have : have + more] = p[:more] * np.uint64(pow(b, have, 2**64))
                have += more
            out.append(p)
            del step
        return out[0], out[1]

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes; empty without words."""
        b = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
        if not len(b):
            return np.empty(0, np.uint64)
        if len(b) >= len(self.powers):
            self.powers, self.backs = self._powers(2 * len(b))
        word = ~_SPACE[b]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]])))
        first, last = edge[::2], edge[1::2]
        if not len(first):
            return np.empty(0, np.uint64)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.byte[b] * self.powers[: len(b)], out=sums[1:])
        words = _mix((sums[last] - sums[first]) * self.backs[first] + (last - first).astype(np.uint64))
        k = self.k
        if len(words) < k:
            return _mix(np.array([int((words * self.place[: len(words)]).sum(dtype=np.uint64)) + len(words) & 2**64 - 1], np.uint64))
        n = len(words) - k + 1
        grams = np.full(n, self.place[k])
        for i in range(k):
            grams += words[i : i + n] * self.place[i]
        grams = np.sort(_mix(grams))
        return grams[np.concatenate([[True], grams[1:] != grams[:-1]])]


class Minwise:
    """Minwise tokens of a set under ``n`` hash functions."""

    def __init__(self, n: int, seed: int):
        self.a, self.c = (_draw(seed, n) | _ONE).astype(np.uint32)[:, None], _draw(seed + 1, n).astype(np.uint32)[:, None]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        best = np.full(len(self.a), 2**32 - 1, np.uint32)
        u = (hashes >> np.uint64(32)).astype(np.uint32)
        step = max(64, 131_072 // len(self.a))
        for at in range(0, len(u), step):
            best = np.minimum(best, (self.a * u[None, at : at + step] + self.c).min(1))
        return best


def set_number(hashes: np.ndarray) -> int:
    """A 64-bit number of a set, as a signed whole number."""
    n = np.array([len(hashes)], np.uint64)
    return int(_mix(hashes.sum(dtype=np.uint64) + _mix(_mix(hashes * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + n)).view(np.int64)[0])


class _Sketch:
    """Size, number and POOL minwise tokens of each text's set."""

    def __init__(self, k: int):
        self.k = k

    def start(self):
        shingle, minwise = Shingler(self.k), Minwise(POOL, SEED + 3)

        def run(cols):
            out = {n: [] for n in ("doc_id", "text_hash", "n_shingles", "member", "tokens")}
            for doc_id, text_hash, text in zip(cols["doc_id"], cols["text_hash"], cols["text"], strict=True):
                u = shingle(text)
                values = (doc_id, text_hash, len(u), set_number(u), minwise(u).tobytes()) if len(u) else (doc_id, text_hash, 0, None, None)
                for n, v in zip(out, values, strict=True):
                    out[n].append(v)
            return out

        return run


def sketch_documents(docs: DataFrame, k: int) -> DataFrame:
    arrow = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("member", pa.int64()), ("tokens", pa.binary())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return map_slices(rows, _Sketch(k), "doc_id long, text_hash long, n_shingles long, member long, tokens binary", arrow)


# ---- trees

_NODES = pa.schema([("node", pa.int64()), ("member", pa.int64())])


def _paths(tokens: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Nodes (members x trees) at ``depth`` of each tree."""
    t = tokens.reshape(len(tokens), trees, depth).astype(np.uint64)
    node = np.broadcast_to(_mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(depth)), t.shape[:2]).copy()
    for level in range(depth):
        node = _mix(node * np.uint64(0xD6E8FEB86659FD93) + t[:, :, level])
    return node.view(np.int64)


def first_nodes(sketches: DataFrame) -> DataFrame:
    """(node, member) of the members' nodes after the first PATH levels of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, POOL)
                nodes = _paths(tokens, TREES, PATH)
                yield pa.record_batch([nodes.ravel(), np.repeat(batch.column("member").to_numpy(), TREES)], schema=_NODES)

    return sketches.select("member", "tokens").mapInArrow(run, "node long, member long")


def deep_nodes(sets: DataFrame, trees: int, depth: int) -> DataFrame:
    """(node, member, before) of each member's nodes at ``depth`` of ``trees`` trees with hash functions of their own.

    ``before``: the member's nodes in the trees before, so that two members are compared in the first tree in which they meet.
    """
    arrow = pa.schema([*_NODES, ("before", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minwise = Minwise(trees * depth, SEED + 5)
        for batch in batches:
            if batch.num_rows:
                tokens = np.stack([minwise(np.frombuffer(b, np.uint64)) for b in batch.column("hashes").to_pylist()])
                nodes = _paths(tokens, trees, depth)
                before = [row[:t].tobytes() for row in nodes for t in range(trees)]
                yield pa.record_batch([nodes.ravel(), np.repeat(batch.column("member").to_numpy(), trees), before], schema=arrow)

    return sets.select("member", "hashes").mapInArrow(run, "node long, member long, before binary")


def wide_sketches(sets: DataFrame) -> DataFrame:
    """(member, tokens): sketches of WIDE bytes for close estimates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minwise = Minwise(WIDE, SEED + 9)
        for batch in batches:
            sketches = [(_mix(minwise(np.frombuffer(b, np.uint64)).astype(np.uint64)) & np.uint64(255)).astype(np.uint8).tobytes() for b in batch.column("hashes").to_pylist()]
            yield pa.record_batch([batch.column("member"), pa.array(sketches, pa.binary())], names=["member", "tokens"])

    return sets.select("member", "hashes").mapInArrow(run, "member long, tokens binary")


def _sizes(rows: DataFrame) -> DataFrame:
    """(node, n) of the nodes with two members or more."""
    return rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


class _Compare:
    """Of each node's members, whose rows come sorted by node and member, the pair that agrees most for each member."""

    def __init__(self, least: int):
        self.least = least

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            node, member = (batch.column(n).to_numpy() for n in ("node", "member"))
            if not len(node):
                continue
            rows = (node, member, np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(len(node), -1))
            if rest is not None:
                rows = tuple(np.concatenate(x) for x in zip(rest, rows, strict=True))
            begin = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
            yield from self._nodes(*(x[: begin[-1]] for x in rows[1:]), begin)
            rest = tuple(x[begin[-1] :] for x in rows)
        if rest is not None:
            yield from self._nodes(*rest[1:], np.array([0, len(rest[0])]))

    def _nodes(self, member, tokens, begin) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(begin)
        for m in np.unique(sizes[sizes > 1]):
            which = begin[:-1][sizes == m]
            for lo in range(0, len(which), max(1, 4096 // int(m))):
                at = which[lo : lo + max(1, 4096 // int(m))][:, None] + np.arange(m)
                t = tokens[at]
                agree = np.full((len(at), m, m), -1, np.int32)
                for i in range(m - 1):
                    agree[:, i, i + 1 :] = (t[:, i + 1 :] == t[:, i : i + 1]).sum(2)
                agree = np.maximum(agree, agree.transpose(0, 2, 1))
                partner = agree.argmax(2)
                g, i = np.nonzero(np.take_along_axis(agree, partner[:, :, None], 2)[:, :, 0] >= self.least)
                if len(g):
                    j = partner[g, i]
                    yield pa.record_batch([member[at[g, np.minimum(i, j)]], member[at[g, np.maximum(i, j)]], agree[g, i, j]], schema=_AGREE)


class _Against:
    """Pairs of different components with ``least`` equal bytes: of each group (node, part) the few members that come first with all that follow.

    Members with a node of an earlier tree in common have been compared there.
    """

    def __init__(self, least: int):
        self.least = least

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, few = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            node, part, follows, member, component = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("node", "part", "follows", "member", "component"))
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint8).reshape(len(node), -1)
            before = batch.column("before").to_pylist()
            begin = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (part[1:] != part[:-1])]))
            for lo, hi in zip(begin, [*begin[1:], len(node)], strict=True):
                if now != (node[lo], part[lo]):
                    now, few = (node[lo], part[lo]), [np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, tokens.shape[1]), np.uint8), np.empty((0, len(before[lo]) // 8), np.int64)]
                mid = lo + int((~follows[lo:hi]).sum())
                met = np.frombuffer(b"".join(before[lo:hi]), np.int64).reshape(hi - lo, -1) if before[lo] else np.empty((hi - lo, 0), np.int64)  # one tree a node
                few = [np.concatenate([x, y]) for x, y in zip(few, (member[lo:mid], component[lo:mid], tokens[lo:mid], met[: mid - lo]), strict=True)]
                a, b, n = [], [], []
                for k in range(len(few[0])):
                    equal = (tokens[mid:hi] == few[2][k]).sum(1)
                    hit = np.flatnonzero((equal >= self.least) & (component[mid:hi] != few[1][k]))
                    hit = hit[~(met[mid - lo :][hit] == few[3][k]).any(1)]
                    a.append(np.full(len(hit), few[0][k]))
                    b.append(member[mid:hi][hit])
                    n.append(equal[hit])
                if a and sum(map(len, a)):
                    a, b = np.concatenate(a), np.concatenate(b)
                    yield pa.record_batch([np.minimum(a, b), np.maximum(a, b), np.concatenate(n).astype(np.int32)], schema=_AGREE)


_AGREE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("agree", pa.int32())])


def _least(places: int, percent: int) -> int:
    t = percent / 100
    return max(1, int(places * t - DEVIATIONS * sqrt(places * t * (1 - t))))


def _best_partners(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b) of each member's likeliest partner in its nodes (node, member)."""
    together = rows.join(sketches, "member").select("node", "member", "tokens").repartition("node").sortWithinPartitions("node", "member")
    near = together.mapInArrow(_Compare(_least(POOL, percent)), "a long, b long, agree int")
    either = near.select(F.col("a").alias("x"), F.col("b").alias("y"), "agree").union(near.select(F.col("b").alias("x"), F.col("a").alias("y"), "agree"))
    return either.groupBy("x").agg(F.max_by("y", F.struct("agree", -F.col("y"))).alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _sides(rows: DataFrame) -> DataFrame:
    """Rows (node, member, component) of nodes with several components, with n, and few: how many are outside of the largest one."""
    sizes = rows.groupBy("node", "component").agg(F.count(F.lit(1)).alias("c"))
    nodes = sizes.groupBy("node").agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("most")).where("n > most.c").select("node", "n", (F.col("n") - F.col("most.c")).alias("few"), F.col("most.component").alias("most"))
    return rows.join(nodes, "node").withColumn("parts", F.ceil(F.col("few") / CROWD).cast("int"))


def _likely_links(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Likely pairs (a, b) between components within nodes: rows (node, member, component, before)."""
    sided = _sides(rows)
    own = F.pmod(F.xxhash64("member"), F.col("parts")).cast("int")
    first = sided.where("component <> most").select("node", own.alias("part"), F.lit(False).alias("follows"), "member", "component", "before")
    then = sided.select("node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("follows"), "member", "component", "before")
    together = first.union(then).join(sketches, "member").select("node", "part", "follows", "member", "component", "before", "tokens")
    dealt = together.repartition("node", "part").sortWithinPartitions("node", "part", "follows")
    return dealt.mapInArrow(_Against(_least(WIDE, percent)), "a long, b long, agree int").select("a", "b").distinct()


def _with_component(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return rows.join(classes.withColumnRenamed("node", "member"), "member", "left").withColumn("component", F.coalesce("component", "member"))


# ---- sets of members, and links


class _Sets:
    """(member, hashes) of rows whose id falls on a marked bit."""

    def __init__(self, bits: np.ndarray, k: int):
        self.bits, self.k = np.packbits(bits), k

    def start(self):
        bits, shingle = np.unpackbits(self.bits).astype(bool), Shingler(self.k)

        def run(cols):
            out = {"member": [], "hashes": []}
            for slot, text in zip(cols["slot"], cols["text"], strict=True):
                if bits[slot] and len(u := shingle(text)):
                    out["member"].append(set_number(u))
                    out["hashes"].append(u.tobytes())
            return out if out["member"] else None

        return run


def sets_of(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(member, hashes) of members (member, doc_id). A bitmap of fixed size sorts out most other texts before sets are shuffled."""
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(BITS)).cast("int")
    marked = members.select(slot.alias("slot")).distinct().toArrow().column("slot").to_numpy()  # BITS numbers at most
    bits = np.zeros(BITS, bool)
    bits[marked] = True
    rows = docs.where("doc_id is not null and text is not null").select("text", slot.alias("slot"))
    near = map_slices(rows, _Sets(bits, k), "member long, hashes binary", pa.schema([("member", pa.int64()), ("hashes", pa.binary())]))
    # repeated texts have equal sets
    return near.join(members.select("member"), "member", "left_semi").groupBy("member").agg(F.first("hashes").alias("hashes"))


class _Confirm:
    """Pairs whose sets reach the threshold, compared as whole numbers in percent."""

    def __init__(self, percent: int):
        self.percent = percent

    def __call__(self, cols):
        out = {"a": [], "b": []}
        for a, b, s, t in zip(cols["a"], cols["b"], cols["set_a"], cols["set_b"], strict=True):
            s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            if both and 100 * both >= self.percent * (len(s) + len(t) - both):
                out["a"].append(a)
                out["b"].append(b)
        return out if out["a"] else None


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("member").alias("a"), F.col("hashes").alias("set_a"))
    b = sets.select(F.col("member").alias("b"), F.col("hashes").alias("set_b"))
    return map_slices(pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b"), _Confirm(percent), "a long, b long", pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _empty(df: DataFrame) -> bool:
    return not df.take(1)


def near_duplicate_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; link when 100 * |A & B| >= percent * |A | B|."""
    return _classes(docs, k, percent).drop("text_hash")


def _classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    base = materialised(sketch_documents(docs, k))
    # one row a set; equal sets have equal tokens
    members = compact(base.where("n_shingles > 0 and doc_id is not null").groupBy("member").agg(F.min("doc_id").alias("doc_id"), F.first("tokens").alias("tokens")), 20_000)
    classes = _components(docs, members, k, percent)
    numbered = members.select("member", "doc_id").join(classes.withColumnRenamed("node", "member"), "member")
    joined = numbered.select("member", "component").join(numbered.groupBy("component").agg(F.min("doc_id").alias("class_id")), "component").select("member", "class_id")
    label = members.select("member", "doc_id").join(joined, "member", "left").select("member", F.coalesce("class_id", "doc_id").alias("class_id"))
    # the side with all documents may be hot in one set: a plain merge join, which Spark splits when skewed
    out = base.select("doc_id", "text_hash", "n_shingles", "member").join(label.hint("merge"), "member", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _components(docs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of the members that are linked with others."""
    sketches = members.select("member", "tokens")
    nodes = first_nodes(members)
    sized = compact(nodes.join(_sizes(nodes), "node"))
    small, large = (sized.where(c).select("node", "member") for c in (f"n <= {SMALL}", f"n > {SMALL}"))

    # 1. and 2.: the likeliest partner of each member, and the most central member of each large node
    central = large.groupBy("member").agg(F.count(F.lit(1)).alias("c"))
    hubs = large.join(central, "member").groupBy("node").agg(F.max_by("member", F.struct("c", -F.col("member"))).alias("hub"))
    stars = large.join(hubs, "node").where("member <> hub").select(F.least("member", "hub").alias("a"), F.greatest("member", "hub").alias("b"))
    first = compact(_best_partners(small, sketches, percent).union(stars).distinct())
    wanted = first.select(F.col("a").alias("member")).union(first.select(F.col("b").alias("member"))).distinct()
    sets = materialised(sets_of(docs, members.select("member", "doc_id").join(wanted, "member", "left_semi"), k))
    classes = extend_components(None, compact(_linked(first, sets, percent)))

    # 1.: small nodes of several components
    apart = compact(_sides(_with_component(small, classes)).select("node", "member", "component"))
    if not _empty(apart):
        some = sets.join(apart.select("member").distinct(), "member", "left_semi")
        rest = compact(_likely_links(apart.withColumn("before", F.lit(b"")), wide_sketches(some), percent).join(first, ["a", "b"], "left_anti"))
        classes = extend_components(classes, compact(_linked(rest, sets, percent)))

    # 3.: large nodes of several components
    crowd = compact(_sides(_with_component(large, classes)).select("member").distinct())
    if _empty(crowd):
        return classes
    crowded = materialised(sets.join(crowd, "member", "left_semi"))
    depth, trees = _deep(crowded, classes, percent / 100)
    deep = compact(_with_component(deep_nodes(crowded, trees, depth), classes))
    rest = compact(_likely_links(deep, wide_sketches(crowded), percent))
    return classes if _empty(rest) else extend_components(classes, compact(_linked(rest, sets, percent)))


def _deep(crowded: DataFrame, classes: DataFrame, threshold: float) -> tuple[int, int]:
    """The depth of trees that takes the fewest rows, by two trees of each depth, and the trees that this depth asks for."""
    pilot = None
    for depth in DEPTHS:
        nodes = deep_nodes(crowded, 2, depth).withColumn("node", F.xxhash64("node", F.lit(depth))).withColumn("depth", F.lit(depth))
        pilot = nodes if pilot is None else pilot.union(nodes)
    sided = _sides(_with_component(pilot, classes))
    rows = {r.depth: r.n for r in sided.groupBy("depth").agg(F.sum("parts").alias("n")).collect()}
    trees = {d: ceil(log(MISS) / log(1 - threshold**d)) for d in DEPTHS}
    n = crowded.count()
    depth = min(DEPTHS, key=lambda d: (trees[d] * (2 * n + rows.get(d, 0)), d))
    return depth, trees[depth]


def keep_representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of its class, with all their columns."""
    gone = _classes(docs, k, percent).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text")).distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == F.col("gone_id")) & (F.xxhash64(docs["text"]) == F.col("gone_text")), "left_anti")
