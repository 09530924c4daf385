"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items are cut into passages of at most PASSAGE words; their TF-IDF matrix A (idf over the
   passages) is factored by a distributed randomised SVD: tasks hold rows of A and return sums
   of A'(AQ), the driver only orthonormalises terms x RANK numbers.
2. Every window of a document is folded into the latent space. Windows come in six lengths, so
   that a passage is compared with windows that hold it whole; they start every STRIDE words.
   The gate is the window's length along the passage, its cosine by its own length: a window is a candidate where this projection reaches
   SHARE of the passage's length, well below what 3. asks for. A bound on the cosine alone would lose passages among other words of the benchmark.
3. A candidate is checked on its words: by idf weight PARAPHRASE of the passage must be there, then the
   longest common subsequence of passage and surroundings counts. From COPY of the passage's words on it is a copy; from PARAPHRASE on it is one
   if the answer, the last quarter of the passage, is there too.

A large benchmark is searched in blocks of BLOCK passages, one after another, so the driver holds one model of a bounded size. Each
document is scanned whole, once a block.

Cases: null and empty documents or items match nothing; equal items match alike; items shorter
than three words are compared as any other, by all their words; repeated documents give repeated rows; an empty benchmark
gives no rows; of equal matches of an item the first in the text is told; very long texts are searched whole, in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.llm.common import map_slices, materialised

PASSAGE, BLOCK = 64, 4096
RANK, OVERSAMPLE, ITERATIONS = 160, 10, 2
STRIDE = 8
#: Windows by length and step in strides, with the longest passage that each is meant for: from 9 words on some window holds it whole.
SCALES = ((1, 1, 4), (2, 1, 9), (4, 2, 17), (5, 2, 25), (7, 2, 41), (10, 2, 10**9))
#: Slots in which a passage's terms are noted for a first look; more terms than slots share them.
SLOTS = 1 << 13
SHARE, COPY, PARAPHRASE, ANSWER = 0.3, 0.65, 0.5, 0.8
SEED = 11
_EDGES = ".,;:!?\"'()[]{}«»„“”…*#$%&|-"


def words_of(text: str | None) -> list[str]:
    """Words in lower case between white space, without punctuation at their ends."""
    return [w for w in (r.strip(_EDGES) for r in text.lower().split()) if w] if text else []


# ---- 1. latent space


def passages_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, passage, words): the words of each item in passages of PASSAGE words."""

    def run(cols):
        out = {"item_id": [], "passage": [], "words": []}
        for item, text in zip(cols["item_id"], cols["text"], strict=True):
            w = words_of(text)
            for k, at in enumerate(range(0, len(w), PASSAGE)):
                if at and len(w) - at < PASSAGE // 4:  # a short rest is searched with the words before it
                    at = len(w) - PASSAGE
                out["item_id"].append(item)
                out["passage"].append(k)
                out["words"].append(w[at : at + PASSAGE])
        return out

    arrow = pa.schema([("item_id", pa.int64()), ("passage", pa.int32()), ("words", pa.list_(pa.string()))])
    return map_slices(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), run, "item_id long, passage int, words array<string>", arrow)


@dataclass
class LatentSpace:
    """Latent vectors of terms and of one block of passages."""

    terms: dict[str, int]
    vectors: np.ndarray
    items: list[int]
    words: list[list[str]]
    coordinates: np.ndarray
    norms: np.ndarray
    idf: np.ndarray
    scale: np.ndarray = field(default_factory=lambda: np.empty(0, int))


def _weights(words: list[str], terms: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array([terms[w] for w in words if w in terms], np.int64)
    u, n = np.unique(ids, return_counts=True)
    return u, n * idf[u]


class _Product:
    """Sums over a partition's passages of a'(aQ) as rows (term, column, value)."""

    def __init__(self, terms, idf, q, gram):
        self.terms, self.idf, self.q, self.gram = terms, idf, q, gram

    def start(self):
        return _Products(self)


class _Products:
    def __init__(self, p):
        self.p, self.sums = p, np.zeros((p.q.shape[1] if p.gram else len(p.terms), p.q.shape[1]))

    def __call__(self, cols):
        for words in cols["words"]:
            at, v = _weights(words, self.p.terms, self.p.idf)
            y = v @ self.p.q[at]
            if self.p.gram:
                self.sums += np.outer(y, y)
            else:
                self.sums[at] += np.outer(v, y)
        return None

    def finish(self):
        at = np.flatnonzero(self.sums.any(1))
        for k in at:
            yield {"term": [int(k)] * self.sums.shape[1], "col": list(range(self.sums.shape[1])), "value": self.sums[k].tolist()}


def _product(passages: DataFrame, terms: dict[str, int], idf: np.ndarray, q: np.ndarray, gram: bool) -> np.ndarray:
    arrow = pa.schema([("term", pa.int32()), ("col", pa.int32()), ("value", pa.float64())])
    rows = map_slices(passages.select("words"), _Product(terms, idf, q, gram), "term int, col int, value double", arrow)
    got = rows.groupBy("term", "col").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros((q.shape[1] if gram else len(terms), q.shape[1]))
    out[got.column("term").to_numpy(), got.column("col").to_numpy()] = got.column("value").to_numpy()
    return out


def latent_space(passages: DataFrame, rank: int = RANK) -> LatentSpace | None:
    """Randomised SVD of the TF-IDF matrix of one block of passages (at most BLOCK rows)."""
    df = passages.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy("w").collect()  # BLOCK * PASSAGE terms at most
    if not df:
        return None
    rows = passages.orderBy("item_id", "passage").collect()
    terms = {r.w: i for i, r in enumerate(df)}
    idf = np.log((1 + len(rows)) / (1 + np.array([r.n for r in df]))) + 0.05
    width = min(rank + OVERSAMPLE, len(terms), len(rows))
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((len(terms), width)))[0]
    for _ in range(ITERATIONS):
        q = np.linalg.qr(_product(passages, terms, idf, q, False))[0]
    values, vectors = np.linalg.eigh(_product(passages, terms, idf, q, True))
    keep = np.argsort(values)[::-1][:rank]
    basis = (q @ vectors[:, keep]) * idf[:, None]
    coords = np.zeros((len(rows), basis.shape[1]))
    for i, r in enumerate(rows):
        for w in r.words:
            coords[i] += basis[terms[w]]
    norms = np.linalg.norm(coords, axis=1, keepdims=True)
    lengths = np.array([len(r.words) for r in rows])
    scale = np.array([next(i for i, (_, _, most) in enumerate(SCALES) if n <= most) for n in lengths])
    return LatentSpace(terms, basis.astype(np.float32), [r.item_id for r in rows], [list(r.words) for r in rows], (coords / np.where(norms > 0, norms, 1)).astype(np.float32), norms[:, 0].astype(np.float32), idf, scale)


# ---- 2. and 3. search


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits of ``a``."""
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        if m := places.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class _Numbers(dict):
    """Raw token to term number + 1; 0 for words outside the benchmark, which stay unremembered if long."""

    def __init__(self, terms):
        super().__init__()
        self.terms = terms

    def __missing__(self, raw):
        k = self.terms.get(raw.strip(_EDGES), -1) + 1
        if len(self) < 400_000:
            self[raw] = k
        return k


class Searcher:
    """Finds the passages of a latent space in texts; numpy works on many texts at once."""

    def __init__(self, space: LatentSpace):
        self.space, self.numbers = space, _Numbers(space.terms)
        self.table = np.concatenate([np.zeros((1, space.vectors.shape[1]), np.float32), space.vectors])
        self.by_scale = [(n, step, np.flatnonzero(space.scale == i)) for i, (n, step, _) in enumerate(SCALES)]
        self.targets = [np.ascontiguousarray(space.coordinates[p].T) for _, _, p in self.by_scale]
        self.passages, self.repeats, self.least = [], [], []
        self.sizes = np.array([len(words) for words in space.words])
        self.slots = min(SLOTS, len(self.table))
        self.inside = np.zeros((len(space.words), self.slots), bool)
        for inside, words in zip(self.inside, space.words, strict=True):
            mine = [space.terms[w] + 1 for w in words]
            u, n = np.unique(mine, return_counts=True)
            weight = n * space.idf[u - 1]
            inside[u % self.slots] = True
            self.passages.append((mine, u, weight, PARAPHRASE * weight.sum()))
            self.repeats.append(((n - 1) * space.idf[u - 1]).sum() + 1e-6)
            self.least.append(PARAPHRASE * weight.sum())
        self.repeats, self.least, self.idf = np.array(self.repeats), np.array(self.least), np.concatenate([[0.0], space.idf])
        self.mark = np.zeros(len(self.table), bool)

    def matches(self, texts: list[str | None]) -> list[list[dict]]:
        """Matches of each text. Texts are laid out one after another, with gaps as long as the longest window."""
        gap = SCALES[-1][0] * STRIDE
        out: list[list[dict]] = [[] for _ in texts]
        parts, owners, used = [], [], 0
        for i, text in enumerate(texts):
            raw = text.lower().split() if text else []
            if raw:
                # whole strides, then the gap
                ids = np.zeros(-(-len(raw) // STRIDE) * STRIDE + gap, np.int32)
                ids[: len(raw)] = np.fromiter(map(self.numbers.__getitem__, raw), np.int32, len(raw))
                parts.append(ids)
                owners.append((used, i, len(raw)))
                used += len(ids)
            if parts and (used >= 16_384 or i == len(texts) - 1):
                self._scan(np.concatenate(parts), owners, out)
                parts, owners, used = [], [], 0
        if parts:
            self._scan(np.concatenate(parts), owners, out)
        return out

    def _scan(self, ids: np.ndarray, owners: list[tuple[int, int, int]], out: list[list[dict]]) -> None:
        blocks = np.concatenate([self.table[ids[at : at + 1024]].reshape(-1, STRIDE, self.table.shape[1]).sum(1) for at in range(0, len(ids), 1024)])
        begins, lengths = np.array([o[0] for o in owners]), np.array([o[2] for o in owners])
        starts = np.arange(len(blocks)) * STRIDE
        owner_of = np.searchsorted(begins, starts, "right") - 1
        inside = starts < (begins + lengths)[owner_of]  # windows that start in a gap reach into the next text only
        found: dict[tuple[int, int], tuple[float, int, bool]] = {}
        weights = self.idf[ids]
        window, have = blocks, 1
        windows = {1: blocks}
        nth = (starts - begins[owner_of]) // STRIDE  # within the text, so that its windows don't depend on its neighbours
        slots = ids % self.slots if self.slots < len(self.table) else ids
        for (n, step, passages), target in zip(self.by_scale, self.targets, strict=True):
            while have < n:  # the window and one right behind it
                more = max(k for k in windows if k <= n - have)
                window, have = window[:-more] + windows[more][have:], have + more
                windows[have] = window
            if not len(passages):
                continue
            norms = np.sqrt(np.einsum("ij,ij->i", window, window))
            least = SHARE * self.space.norms[passages][None]
            rows = np.flatnonzero((norms >= least.min()) & inside[: len(norms)] & (nth[: len(norms)] % step == 0))  # a shorter vector has no long projection
            for lo in range(0, len(rows), 1024):
                at = rows[lo : lo + 1024]
                along = window[at] @ target
                # by projection only: other words around a passage lower the cosine
                hit = along >= least
                # every hit is checked: a neighbour that projects further need not hold the passage
                w, p = np.nonzero(hit)
                for some in range(0, len(w), 4096):
                    which, near = passages[p[some : some + 4096]], at[w[some : some + 4096]]
                    k = owner_of[near]
                    low = np.maximum(begins[k], starts[near] - self.sizes[which])
                    high = np.minimum(begins[k] + lengths[k], starts[near] + n * STRIDE + self.sizes[which])
                    places = low[:, None] + np.arange((high - low).max())
                    cells = np.minimum(places, len(ids) - 1)
                    there = self.inside[which[:, None], slots[cells]] & (places < high[:, None])
                    # bounds of what _check asks for
                    weight = np.einsum("ij,ij->i", there, weights[cells]) + self.repeats[which]
                    left = np.flatnonzero((there.sum(1) >= PARAPHRASE * self.sizes[which]) & (weight >= self.least[which]))
                    # the same with each word once
                    terms = np.sort(np.where(there[left], ids[cells[left]], 0), axis=1)
                    once = self.idf[terms[:, 1:]] * (terms[:, 1:] != terms[:, :-1])
                    for i in left[once.sum(1) + self.idf[terms[:, 0]] + self.repeats[which[left]] >= self.least[which[left]]]:
                        begin, owner, length = owners[int(k[i])]
                        self._check(ids[begin : begin + length], int(which[i]), int(starts[near[i]]) - begin, n * STRIDE, owner, found)
        for (owner, p), (ratio, start, copy) in sorted(found.items()):
            out[owner].append({"item_id": self.space.items[p], "start_word": start, "lcs": ratio, "copy": copy})

    def _check(self, ids: np.ndarray, p: int, start: int, length: int, owner: int, found: dict) -> None:
        mine, terms, weight, least = self.passages[p]
        lo = max(0, start - len(mine))
        near = ids[lo : start + length + len(mine)]
        self.mark[terms] = True
        near = near[self.mark[near]]  # other words are in no common subsequence
        self.mark[terms] = False
        if len(near) < PARAPHRASE * len(mine):
            return
        self.mark[near] = True
        covered = weight[self.mark[terms]].sum()
        self.mark[near] = False
        if covered < least:
            return
        ratio = common_subsequence(mine, near.tolist()) / len(mine)
        if ratio < PARAPHRASE or ratio <= found.get((owner, p), (0.0,))[0]:
            return
        if ratio < COPY:
            answer = mine[-max(3, len(mine) // 4) :]
            if common_subsequence(answer, near.tolist()) < ANSWER * len(answer):
                return
        found[owner, p] = (ratio, lo, ratio >= COPY)


class _Search:
    def __init__(self, space: LatentSpace):
        self.space = space

    def start(self):
        search = Searcher(self.space)

        def run(cols):
            out = {n: [] for n in ("doc_id", "item_id", "start_word", "lcs", "copy")}
            for doc_id, got in zip(cols["doc_id"], search.matches(cols["text"]), strict=True):
                for m in got:
                    out["doc_id"].append(doc_id)
                    for n, v in m.items():
                        out[n].append(v)
            return out if out["doc_id"] else None

        return run


class _Clean:
    """Rows of documents without a match."""

    def __init__(self, space: LatentSpace):
        self.space = space

    def start(self):
        search = Searcher(self.space)

        def run(cols):
            keep = [i for i, got in enumerate(search.matches(cols["text"])) if not got]
            return {n: [v[i] for i in keep] for n, v in cols.items()}

        return run


class _Dirty:
    """Hashes of the rows whose text holds an item."""

    def __init__(self, space: LatentSpace):
        self.space = space

    def start(self):
        search = Searcher(self.space)

        def run(cols):
            hit = [i for i, got in enumerate(search.matches(cols["text"])) if got]
            return {n: [cols[n][i] for i in hit] for n in ("_a", "_b")}

        return run


def _spaces(benchmark: DataFrame) -> Iterator[tuple[LatentSpace, bool]]:
    """The model of each block, one at a time, and whether it is the only one."""
    passages = passages_of(benchmark).persist()
    try:
        blocks = max(1, -(-passages.count() // BLOCK))
        # twice as many, so that a hashed block stays below BLOCK
        hashed = F.pmod(F.xxhash64("item_id", "passage"), F.lit(2 * blocks))
        for b in range(2 * blocks if blocks > 1 else 1):
            space = latent_space(passages.where(hashed == b) if blocks > 1 else passages)
            if space is not None:
                yield space, blocks == 1
    finally:
        passages.unpersist()


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, lcs, copy) of every benchmark item found in a document. No shuffle of texts.

    With several blocks each is searched before the next model is built, so the driver holds one model at a time.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("lcs", pa.float64()), ("copy", pa.bool_())])
    schema = "doc_id long, item_id long, start_word long, lcs double, copy boolean"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for space, alone in _spaces(benchmark):
        part = map_slices(rows, _Search(space), schema, arrow)
        part = part if alone else materialised(part)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` in which no benchmark item is found, with the columns of documents.

    One block is searched in passing. With several, each leaves the hashes of the rows in which it finds an item, and
    the rows go by these at the end, so texts are moved once however many blocks there are.
    """
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    key = (F.xxhash64("doc_id", "text").alias("_a"), F.xxhash64("text", F.lit(1), "doc_id").alias("_b"))
    hits = None
    for space, alone in _spaces(benchmark):
        if alone:
            return map_slices(rows, _Clean(space), schema, arrow)
        found = map_slices(rows.select("text", *key), _Dirty(space), "_a long, _b long", pa.schema([("_a", pa.int64()), ("_b", pa.int64())]))
        found = materialised(found.distinct())
        hits = found if hits is None else hits.union(found)
    if hits is None:
        return rows
    return rows.withColumns({"_a": key[0], "_b": key[1]}).join(hits.distinct(), ["_a", "_b"], "left_anti").drop("_a", "_b")


def benchmark_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


