"""Cross-entropy difference scores: a target and a background n-gram model over one vocabulary.

Both models are interpolated bigram models over all words of all documents. The background model
counts all documents, the target model those marked as good. A document's score is the mean over its
tokens of log P_target - log P_background (positive: closer to the target). Target documents are
scored by the model that counts them too.

Every distinct word and every distinct pair of neighbours has its own count, known by a 64-bit hash;
the tables of counts grow with the corpus and stay in Spark:

1. Texts are dealt into chunks of about CHUNK_BYTES. Each chunk sorts its distinct words and pairs by hash
   and sends their counts, packed, to the buckets of the hash range.
2. A bucket adds up what all chunks have sent, and sends each chunk the totals of its own entries.
3. Each chunk scores its texts with these totals. Its texts come from the same shuffle as in 1.

Beyond FAN chunks counts are added up in several levels: a sender has at most FAN receivers and a receiver at most FAN senders. A receiver
of one level adds up a stretch of hashes over some senders and sends it on, in smaller stretches, to the next; the last level has the
totals, which go back the same way. So packets are chunks * FAN a level, and what a task holds is about a chunk's entries on any level.

A frequent word is one entry a chunk, so nothing is hot. Marks of target documents are dealt to the chunks
as ids; no text is joined.

Cases: null texts and texts without a word have no tokens and score 0; what has punctuation only is no word;
rows labelled twice count by their larger mark; without target rows both models are equal and all scores are 0;
repeated rows count repeatedly, and those of one id are all marked or none; an empty table gives
no rows; very long texts are read whole and make their chunk as long.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import map_slices, materialised

#: Bytes of text in a chunk, and of text behind a bucket: what one task holds at a time.
CHUNK_BYTES = 8_000_000
#: Receivers of a sender, and senders of a receiver, at most.
FAN = 256
#: Weights of the bigram and the unigram estimate; what is left is uniform.
BIGRAM, UNIGRAM = 0.6, 0.35
_EDGES = ".,;:!?\"'()[]"
_FLUSH = 300_000

_ARROW = pa.schema([("bucket", pa.int64()), ("stretch", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("n", pa.binary()), ("t", pa.binary())])
_COUNTS = "bucket long, stretch long, chunk long, keys binary, n binary, t binary"
_SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])
_SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def words_of(text: str | None) -> list[str]:
    """Words in lower case between white space, stripped of punctuation at both ends; what is left empty is none."""
    return [w for w in (r.strip(_EDGES) for r in text.lower().split()) if w] if text else []


def word_hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _pack(values: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, which compress well as most are small."""
    return zlib.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1).T).view("<u8").ravel()


class _Vocabulary:
    """Hashes of the distinct words of a task."""

    def start(self):
        return _DistinctWords()


class _DistinctWords:
    def __init__(self):
        self.words: set[str] = set()

    def __call__(self, cols):
        for t in cols["text"]:
            self.words.update(words_of(t))
        return self._rows() if len(self.words) > _FLUSH else None

    def _rows(self):
        out = {"word": np.array([word_hash(w) for w in self.words], np.uint64).view(np.int64).tolist()}
        self.words = set()
        return out

    def finish(self):
        if self.words:
            yield self._rows()


class Levels:
    """Who sends to whom. Senders of level 0 are the chunks; those of level k + 1 the receivers of level k.

    Hashes are cut into fan^(k + 1) stretches on level k. A receiver is a stretch over fan^(k + 1) neighbouring chunks; its number is
    the group of chunks by the number of stretches, and the stretch.
    """

    def __init__(self, chunks: int, fan: int = FAN):
        self.count = 1
        while fan**self.count < chunks:
            self.count += 1
        self.fan = max(1, math.ceil(round(chunks ** (1 / self.count), 9)))

    def send(self, level: int, sender: int, keys: np.ndarray, n: np.ndarray, t: np.ndarray) -> pa.Table:
        """Sorted entries of a sender of a level, packed by receiver."""
        stretches = self.fan ** (level + 1)
        chunk = sender // self.fan**level  # the group of chunks that the sender stands for
        at = ((keys >> np.uint64(32)) * np.uint64(stretches)) >> np.uint64(32)
        own, begin = np.unique(at, return_index=True)
        out = {name: [] for name in _ARROW.names}
        for stretch, lo, hi in zip(own.tolist(), begin, [*begin[1:], len(at)], strict=True):
            bucket = chunk // self.fan * stretches + stretch
            values = (bucket, stretch, sender, _pack(np.diff(keys[lo:hi], prepend=np.uint64(0))), _pack(n[lo:hi]), _pack(t[lo:hi]))
            for name, v in zip(out, values, strict=True):
                out[name].append(v)
        return pa.table(out, schema=_ARROW)


class _Chunk:
    """The tokens of a chunk's texts as numbers, and its entries (all tokens, words, pairs) in order of their keys."""

    def __init__(self, rows: pa.Table):
        is_mark = np.array(rows.column("mark").to_pylist(), bool)
        ids, texts = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
        marked = {i for i, m in zip(ids, is_mark, strict=True) if m}
        self.doc_ids = [i for i, m in zip(ids, is_mark, strict=True) if not m]
        if not marked <= set(self.doc_ids):
            raise RuntimeError("a mark has come to another chunk than its text")
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        parts = [np.fromiter(map(number.__getitem__, words_of(t)), np.int64) for t, m in zip(texts, is_mark, strict=True) if not m]
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.tokens = np.concatenate(parts) if parts else np.empty(0, np.int64)
        self.owner = np.repeat(np.arange(len(parts)), self.lengths)
        good = np.array([i in marked for i in self.doc_ids], bool)[self.owner]
        hashes = np.array([word_hash(w) for w in number], np.uint64)
        self.size = len(hashes)

        self.later = np.flatnonzero(self.owner[1:] == self.owner[:-1]) + 1  # tokens with one before them
        self.first = self.tokens[self.later - 1]
        codes, self.pair = np.unique(self.first * max(1, self.size) + self.tokens[self.later], return_inverse=True)
        a, b = np.divmod(codes, max(1, self.size))
        pairs = _mix(hashes[a] * np.uint64(0xD6E8FEB86659FD93) + _mix(hashes[b]) + np.uint64(2))
        keys = np.concatenate([np.zeros(1, np.uint64), _mix(hashes + np.uint64(1)), pairs])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.n = self._counts(np.ones(len(self.tokens), bool), len(codes))
        self.t = self._counts(good, len(codes))

    def _counts(self, of: np.ndarray, pairs: int) -> np.ndarray:
        words = np.bincount(self.tokens[of], minlength=self.size)
        both = np.bincount(self.pair[of[self.later]], minlength=pairs)
        return np.concatenate([[of.sum()], words, both])[self.order]

    def scores(self, n: np.ndarray, t: np.ndarray, size: int) -> pa.Table:
        """``n`` and ``t``: totals of all documents and of target documents, in order of the keys."""
        background = self._loss(n, size)
        target = self._loss(t, size) if t[0] else background
        mean = [np.bincount(self.owner, x, len(self.lengths)) / np.maximum(1, self.lengths) for x in (target, background)]
        return pa.table([self.doc_ids, self.lengths, *mean, mean[1] - mean[0]], schema=_SCORED)

    def _loss(self, sorted_totals: np.ndarray, size: int) -> np.ndarray:
        totals = np.empty(len(self.order))
        totals[self.order] = sorted_totals
        words, pairs = totals[1 : 1 + self.size], totals[1 + self.size :]
        u = words[self.tokens] / max(1.0, totals[0])
        given = u.copy()  # without a known word before
        before = words[self.first]
        given[self.later] = np.where(before > 0, pairs[self.pair] / np.maximum(1.0, before), given[self.later])
        return -np.log(BIGRAM * given + UNIGRAM * u + (1 - BIGRAM - UNIGRAM) / size)


class _Received:
    """A receiver's packets, their distinct keys in order, and the place of every entry among them."""

    def __init__(self, sent: pa.Table):
        self.sent = sent
        keys = [np.cumsum(_unpack(x), dtype=np.uint64) for x in sent.column("keys").to_pylist()]
        self.ends = np.cumsum([len(k) for k in keys])
        self.keys, self.place = np.unique(np.concatenate(keys), return_inverse=True)

    def sums(self) -> list[np.ndarray]:
        # bincount adds in doubles: exact below 2**53
        return [np.bincount(self.place, np.concatenate([_unpack(x) for x in self.sent.column(name).to_pylist()])) for name in ("n", "t")]

    def answers(self, totals: list[np.ndarray]) -> pa.Table:
        """Totals for each sender, in the order in which it has sent its entries."""
        back = [[_pack(x) for x in np.split(of[self.place], self.ends[:-1])] for of in totals]
        names = ("bucket", "stretch", "chunk")
        return pa.table([*(self.sent.column(c) for c in names), pa.array([None] * len(self.ends), pa.binary()), *back], schema=_ARROW)


def _add_up(sent: pa.Table) -> pa.Table:
    """Totals of a bucket of the last level."""
    got = _Received(sent)
    return got.answers(got.sums())


def _totals_of(totals: pa.Table) -> list[np.ndarray]:
    """What a sender gets back, in the order of its keys."""
    totals = totals.sort_by("stretch")
    return [np.concatenate([_unpack(x) for x in totals.column(name).to_pylist()]) for name in ("n", "t")]


def _onward(levels: Levels, level: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """What a receiver of a level sends on to the next."""

    def send(key: tuple, table: pa.Table) -> pa.Table:
        got = _Received(table)
        n, t = (x.astype(np.int64) for x in got.sums())
        return levels.send(level + 1, key[0].as_py(), got.keys, n, t)

    return send


def _back(sent: pa.Table, totals: pa.Table) -> pa.Table:
    """What a receiver answers once it has its totals from the next level."""
    return _Received(sent).answers(_totals_of(totals))


def corpus_totals(sent: DataFrame, levels: Levels) -> DataFrame:
    """Packets of the chunks (level 0) -> their totals, addressed to the chunks."""
    down = []
    for level in range(levels.count - 1):
        sent = materialised(sent)  # read again on the way back
        down.append(sent)
        sent = sent.groupBy("bucket").applyInArrow(_onward(levels, level), _COUNTS)
    totals = sent.groupBy("bucket").applyInArrow(_add_up, _COUNTS)
    for sent in reversed(down):
        totals = sent.groupBy("bucket").cogroup(totals.groupBy("chunk")).applyInArrow(_back, _COUNTS)
    return totals


def score_documents(docs: DataFrame, good: DataFrame, chunk_bytes: int = CHUNK_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (nats a token) and score of every row.

    ``good``: the doc_ids of target documents, distinct. Texts are shuffled once and read three times.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = max(1, map_slices(rows.select("text").where(F.col("text").isNotNull()), _Vocabulary(), "word long", pa.schema([("word", pa.int64())])).distinct().count())
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = 1 + n_bytes // chunk_bytes

    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    marks = dealt.select("chunk", "doc_id").join(good.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi").distinct()
    both = dealt.select("chunk", "doc_id", "text", F.lit(False).alias("mark")).union(marks.select("chunk", "doc_id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("mark")))

    levels = Levels(chunks, fan)

    def count(key: tuple, table: pa.Table) -> pa.Table:
        chunk = _Chunk(table)
        return levels.send(0, key[0].as_py(), chunk.keys, chunk.n, chunk.t)

    def score(table: pa.Table, totals: pa.Table) -> pa.Table:
        return _Chunk(table).scores(*_totals_of(totals), size)

    totals = corpus_totals(both.groupBy("chunk").applyInArrow(count, _COUNTS), levels)
    return both.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(score, _SCORES)


def good_documents(labels: DataFrame) -> DataFrame:
    """Ids of documents marked as of good quality, each once."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
