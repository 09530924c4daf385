"""Toxicity of texts whose words may be disguised: a noisy channel, then a learned lexicon.

1. A trigram character model is counted over the letters of all documents.
2. Spans that look disguised (letters mixed with digits or signs, letters spaced out one by one,
   a letter three times or more) become lattices: each sign may stand for some letters or for
   nothing, each run for one or two letters, separators may fall away. Viterbi decoding under
   the character model restores them. Plain words have one path only and are left as they are.
3. A lexicon is learned from a bounded sample of labelled rows: words and word beginnings with
   their rate of toxic rows, restored texts included. Copies count once, and a feature enters only
   if its rate is far above what chance gives any of the features that were looked at.
4. The plain text and the restored one are scored whole: 1 - product over the entries of its
   words of (1 - the rate that is sure), shrunk towards the base rate.

Cases: null and empty texts get the base score of a text without entries; without labelled rows
the lexicon is empty, as it is for an empty table; rows labelled twice count once with their larger label; ties
between readings go to the one listed first; repeated rows give repeated results; very long texts
are read whole, in time that grows with their length.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import id_remainder, map_slices
from blockweave.llm.near_duplicates import Shingler

THRESHOLD = 0.7
#: Labelled rows that the lexicon is fitted on, at most (the smallest id hashes); a documented bound.
MAX_LABELLED = 12_000
MIN_TOXIC, MIN_RATE = 3, 0.8
#: Features that may be expected to enter by chance.
CHANCE = 0.01
#: Minwise hashes by which near copies are told.
KEYS = 8
PREFIX_LENGTHS = (4, 5, 6)

# Letters that a sign or digit may stand for; "" means that it may be noise.
SIGNS: dict[str, str] = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
    "*": "abcdefghijklmnopqrstuvwxyz", "#": "abcdefghijklmnopqrstuvwxyz",
}
SEPARATORS = " .-_*~,/"
_WORD = re.compile(r"[^\W\d_]+")
LONGEST = 40  # letters of a word
#: Signs of several bytes; letters one by one with repeated separators.
_WIDE_SIGN = re.compile("|".join(c for c in SIGNS if ord(c) >= 128).encode())
_ONE = rb"[a-z\x80-\xff0-9@$!|+(<#]"
_WIDE_SPACED = re.compile(rb"(?<![a-z\x80-\xff])" + _ONE + rb"(?:([ .\-_*~,/])\1+" + _ONE + rb"){2,}(?![a-z\x80-\xff])")

# Classes of bytes: 0 other, 1 letter (all of >= 0x80 too), 2 sign or digit that may stand for a letter, 3 separator.
_CLASS = np.zeros(256, np.uint8)
for _c in range(256):
    if 97 <= _c <= 122 or _c >= 0x80:
        _CLASS[_c] = 1
for _ch in SIGNS:
    if ord(_ch) < 128:
        _CLASS[ord(_ch)] = 2
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in SEPARATORS]] = True
_SEPARATOR[[10, 9]] = False
_LETTER = _CLASS == 1
_A2Z = np.zeros(256, bool)
_A2Z[97:123] = True

SYMBOLS = 32  # 0 gap, 1 to 26 the letters a to z, 27 to 31 bytes of all other letters
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = 27 + np.arange(128) % 5


# ---- 1. character model


class _Grams:
    def start(self):
        return _Gramming()


class _Gramming:
    def __init__(self):
        self.counts = np.zeros(SYMBOLS**3, np.int64)

    def __call__(self, cols):
        joined = "\n\n".join(t.lower() for t in cols["text"] if t)
        s = _SYMBOL[np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)]
        if len(s) > 2:
            self.counts += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        return None

    def finish(self):
        at = np.flatnonzero(self.counts)
        yield {"gram": at.tolist(), "n": self.counts[at].tolist()}


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) over all texts as an array [a, b, c]; at most 32**3 sums reach the driver."""
    rows = map_slices(docs.select("text").where(F.col("text").isNotNull()), _Grams(), "gram int, n long", pa.schema([("gram", pa.int32()), ("n", pa.int64())]))
    got = rows.groupBy("gram").agg(F.sum("n").alias("n")).collect()
    tri = np.zeros(SYMBOLS**3)
    for g, n in got:
        tri[g] = n
    tri = tri.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    bi, uni = tri.sum(0), tri.sum((0, 1)) + 1.0
    p1 = uni / uni.sum()
    p2 = (bi + 8 * p1) / (bi.sum(1, keepdims=True) + 8)
    return np.log((tri + 8 * p2[None]) / (tri.sum(2, keepdims=True) + 8))


# ---- 2. lattices


def disguised_spans(raw: bytes) -> list[tuple[int, int]]:
    """Byte ranges of a lower-cased text that have more than one reading."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) < 3:
        return []
    k, a2z = _CLASS[b], _A2Z[b]
    x, y, z = b[:-2], b[1:-1], b[2:]
    run = a2z[:-2] & (x == y) & (y == z)
    letter = k == 1
    # a sign before or after a letter; the word without the signs that follow it is read in the plain text
    sign = np.zeros(len(b), bool)
    sign[:-1] = (k[:-1] == 2) & letter[1:]
    sign[1:] |= (k[1:] == 2) & letter[:-1]
    hits = [np.flatnonzero(run), np.flatnonzero(sign), [m.start() for m in _WIDE_SIGN.finditer(raw)]]
    wide = [m.span() for m in _WIDE_SPACED.finditer(raw)]
    spaced: list[tuple[int, int]] = []
    if len(b) >= 5:
        sep = _SEPARATOR[b]
        one = letter | (k == 2)
        chain = one[:-4] & sep[1:-3] & one[2:-2] & sep[3:-1] & one[4:]
        chain[1:] &= ~letter[:-5]
        for at in np.flatnonzero(chain):
            if spaced and at < spaced[-1][1]:
                continue
            end = int(at) + 5
            while end + 1 < len(b) and sep[end] and one[end + 1]:
                end += 2
            if end < len(b) and letter[end]:  # the last one begins a longer word
                end -= 2
            if end - at >= 5:
                spaced.append((int(at), end))
    at = np.unique(np.concatenate(hits).astype(np.int64))
    if spaced:  # in order and apart: a hit is covered if the last one to begin at or before it has not ended
        begins, ends = np.array(spaced).T
        nth = np.searchsorted(begins, at, "right") - 1
        at = at[(nth < 0) | (at >= ends[nth])]
    if not len(at):
        return sorted({*spaced, *wide})
    # the runs of letters and signs around the hits, and in them the end of the last letter
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (k == 1) | (k == 2), [0]]).astype(np.int8)))
    own = np.unique(np.searchsorted(edge, at, "right") - 1)
    first, last = edge[own], edge[own + 1]
    letters = np.flatnonzero(letter)
    tail = np.searchsorted(letters, last)
    some = np.flatnonzero(tail > np.searchsorted(letters, first))
    first, last, tail = first[some], last[some], letters[tail[some] - 1] + 1
    odd = np.zeros(len(b) + 1, np.int64)  # signs among the letters, three of a letter, wide signs
    odd[1:][k == 2] = 1
    odd[1:-2][run] += 1
    odd[[m.start() + 1 for m in _WIDE_SIGN.finditer(raw)]] += 1
    odd = np.cumsum(odd)
    inside = odd[tail] > odd[first]
    spans = [*spaced, *wide]
    for lo, mid, hi, open_ in zip(first.tolist(), tail.tolist(), last.tolist(), inside.tolist(), strict=True):
        # each number of the signs at the end may belong to the word
        if open_:
            spans.append((lo, mid))
        if hi > mid:
            spans += [(lo, e) for e in range(mid + 1, min(hi, mid + LONGEST))]
            spans.append((lo, hi))
    return sorted(set(spans))


def lattice(span: str) -> list[list[str]]:
    """Readings of each place of a span: letters, or "" where a character may fall away."""
    if _WIDE_SPACED.fullmatch(span.encode("utf-8", "surrogatepass")):
        span = re.sub(r"([ .\-_*~,/])\1+", r"\1", span)
    spaced = bool(re.fullmatch(r"(?:.[ .\-_*~,/])+.", span, re.S))
    places: list[list[str]] = []
    for m in re.finditer(r"([^\W\d_*#])\1*|\*+|#+|.", span, re.S):
        c = m[0]
        if spaced and m.end() - m.start() == 1 and m.start() % 2 == 1:
            places.append([""])
        elif c[0] in "*#":
            # hidden letters; a row longer than any word is a rule, not a mask
            places += [list(SIGNS[c[0]])] * len(c) if len(c) <= LONGEST else [[""]]
        elif len(c) >= 3:
            places.append([c[0], c[:2]])
        elif len(c) == 1 and c in SIGNS:
            # as an opening mark a sign may be noise; so may one after the last letter, which the plain text shows too
            places.append([*SIGNS[c], *([""] if m.start() == 0 and not c.isdigit() else [])])
        else:
            places.append([c])
    return places


@lru_cache(10_000)
def _symbols(text: str) -> tuple[int, ...]:
    return tuple(_SYMBOL[list(text.encode("utf-8", "surrogatepass"))].tolist())


def _viterbi(model: np.ndarray, before: tuple[int, int], places: list[list[str]], after: tuple[int, ...]) -> list[str]:
    """The likeliest reading of each place between fixed symbols; states are the last two symbols, as a table."""
    least = np.full((SYMBOLS, SYMBOLS), -np.inf)
    scores, cells = least.copy(), np.arange(SYMBOLS * SYMBOLS).reshape(SYMBOLS, SYMBOLS)
    scores[before] = 0.0
    steps = []

    def append(table: np.ndarray, origin: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
        longer = table + model[:, :, c]
        at = longer.argmax(0)
        out, back = least.copy(), np.zeros_like(origin)
        out[:, c], back[:, c] = longer[at, cells[0]], origin[at, cells[0]]
        return out, back

    for readings in places:
        best, origin, which = least.copy(), cells.copy(), np.zeros_like(cells)
        coded = [_symbols(r) for r in readings]
        single = [r for r, c in enumerate(coded) if len(c) == 1]
        if len(single) > 4:  # hidden letters: all at once
            letters = np.array([coded[r][0] for r in single])
            longer = scores[:, :, None] + model[:, :, letters]
            at = longer.argmax(0)
            best[:, letters] = np.take_along_axis(longer, at[None], 0)[0]
            origin[:, letters] = at * SYMBOLS + cells[0][:, None]
            which[:, letters] = single
        for r, code in enumerate(coded):
            if len(single) > 4 and len(code) == 1:
                continue
            table, back = scores, cells
            for c in code:
                table, back = append(table, back, c)
            better = table > best
            best, origin, which = np.where(better, table, best), np.where(better, back, origin), np.where(better, r, which)
        scores = best
        steps.append((origin, which))
    table, back = scores, cells
    for c in after:
        table, back = append(table, back, c)
    state = int(back.ravel()[table.argmax()])
    chosen = []
    for (origin, which), readings in zip(reversed(steps), reversed(places), strict=True):
        chosen.append(readings[which.ravel()[state]])
        state = int(origin.ravel()[state])
    return chosen[::-1]


class Decoder:
    """Likeliest readings under a model of three characters.

    Places with one reading are fixed. Two fixed symbols part what stands before them from what comes
    after, so each stretch of open places is decoded with the two symbols on either side, which
    gives the reading of the whole span; stretches are remembered.
    """

    def __init__(self, model: np.ndarray):
        self.model, self.seen = model, {}

    def __call__(self, span: str) -> str:
        places = lattice(span)
        out: list[str] = []
        last = (0, 0)
        at = 0
        while at < len(places):
            if len(places[at]) == 1:
                out.append(places[at][0])
                last = (*last, *_symbols(places[at][0]))[-2:]
                at += 1
                continue
            end, after = at + 1, ()  # up to two fixed symbols, or the end of the word
            k = end
            while k < len(places) and len(after) < 2:
                if len(places[k]) > 1:
                    end, after = k + 1, ()
                else:
                    after = after + _symbols(places[k][0])
                k += 1
            after = after[:2] if len(after) >= 2 else (*after, 0)
            key = (last, tuple(map(tuple, places[at:end])), after)
            if (got := self.seen.get(key)) is None:
                if len(self.seen) > 100_000:
                    self.seen.clear()
                got = self.seen[key] = _viterbi(self.model, last, places[at:end], after)
            out += got
            for r in got:
                last = (*last, *_symbols(r))[-2:]
            at = end
        return "".join(out)


def decode(span: str, model: np.ndarray) -> str:
    """The likeliest reading of a span."""
    return Decoder(model)(span)


class Restorer:
    """Restored readings of the disguised spans of texts, remembered by span."""

    def __init__(self, model: np.ndarray):
        self.decode, self.seen = Decoder(model), {}

    def _read(self, raw: bytes) -> list[tuple[int, int, str]]:
        out = []
        for a, b in disguised_spans(raw):
            piece = raw[a:b]
            if (got := self.seen.get(piece)) is None:
                if len(self.seen) > 100_000:
                    self.seen.clear()
                got = self.seen[piece] = self.decode(piece.decode("utf-8", "replace"))
            out.append((a, b, got))
        return out

    def __call__(self, low: str) -> list[str]:
        return [r for _, _, r in self._read(low.encode("utf-8", "surrogatepass"))]

    def text(self, low: str) -> tuple[str, list[str]]:
        """The text with the readings in place of its disguised spans, and these readings."""
        raw = low.encode("utf-8", "surrogatepass")
        got = self._read(raw)
        if not got:
            return low, []
        parts, at, k = [], 0, 0
        while k < len(got):
            a, end = got[k][0], got[k][1]
            readings = []
            while k < len(got) and got[k][0] < end:  # several readings of one place
                end = max(end, got[k][1])
                readings.append(got[k][2])
                k += 1
            parts += [raw[at:a].decode("utf-8", "replace"), " ".join(readings)]
            at = end
        parts.append(raw[at:].decode("utf-8", "replace"))
        return "".join(parts), [r for _, _, r in got]


# ---- 3. lexicon


def features_of(word: str) -> list[str]:
    """=word and ^beginnings of it; words that are longer than LONGEST have beginnings only."""
    return [*(["=" + word] if len(word) <= LONGEST else []), *("^" + word[:n] for n in PREFIX_LENGTHS if len(word) > n)]


class _Features:
    """Distinct features of the plain and the restored text, and minwise hashes of its runs of five words."""

    def __init__(self, model):
        self.model = model

    def start(self):
        restore, shingle = Restorer(self.model), Shingler(5)
        seeds = np.random.default_rng(KEYS).integers(0, 2**64, KEYS, np.uint64)

        def run(cols):
            features, keys = [], []
            for t in cols["text"]:
                low = (t or "").lower()
                words = {w for version in {low, restore.text(low)[0]} for w in _WORD.findall(version)}
                features.append(sorted({f for w in words for f in features_of(w)}))
                runs = shingle(t)
                keys.append([int(((runs ^ s) * s).min().view(np.int64)) for s in seeds | np.uint64(1)] if len(runs) else [0] * KEYS)
            return {"toxic": cols["toxic"], "features": features, "keys": keys}

        return run


@dataclass
class Lexicon:
    entries: dict[str, float]
    base: float


def learn_lexicon(docs: DataFrame, labels: DataFrame, model: np.ndarray, max_labelled: int = MAX_LABELLED) -> Lexicon:
    """Fit on at most ``max_labelled`` labelled rows that may be learned from.

    A feature counts once for each class of near copies, as toxic if all its rows there are. It enters
    if its rate of toxic classes is MIN_RATE at least and so far above the base rate that
    none would be expected to by chance (log likelihood ratio against the number of features looked at).
    """
    usable = labels.where(F.col("toxic").isNotNull() & (id_remainder() != 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # bounded: also small enough to broadcast
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    arrow = pa.schema([("toxic", pa.int32()), ("features", pa.list_(pa.string())), ("keys", pa.list_(pa.int64()))])
    rows = map_slices(sample.select("toxic", "text"), _Features(model), "toxic int, features array<string>, keys array<bigint>", arrow).persist()
    try:
        classed = rows.join(_classes(rows), "keys")
        n, pos = classed.groupBy("class").agg(F.min("toxic").alias("toxic")).agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        base = (pos + 0.5) / (n + 10.0)
        if not pos:
            return Lexicon({}, base)
        by_class = classed.select("class", "toxic", F.explode("features").alias("f")).groupBy("f", "class").agg(F.min("toxic").alias("toxic"))
        counts = by_class.groupBy("f").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).persist()
        looked_at = counts.count()
        rate = F.col("t") / F.col("n")
        rest = F.when(F.col("t") < F.col("n"), (F.col("n") - F.col("t")) * F.log((1 - rate) / (1 - base))).otherwise(0.0)
        sure = counts.where((F.col("t") >= MIN_TOXIC) & (rate >= MIN_RATE)).where(F.col("t") * F.log(rate / base) + rest >= math.log(looked_at / CHANCE)).collect()  # words of the bounded sample
        counts.unpersist()
    finally:
        rows.unpersist()
    return Lexicon({r.f: _least_rate(r.t, r.n) for r in sorted(sure)}, base)


def _least_rate(t: int, n: int, z: float = 1.96) -> float:
    """Lower end of the interval of a rate (Wilson)."""
    mid, spread = t / n + z * z / (2 * n), z * math.sqrt(t / n * (1 - t / n) / n + z * z / (4 * n * n))
    return (mid - spread) / (1 + z * z / n)


def _classes(rows: DataFrame) -> DataFrame:
    """(keys, class): of its minwise hashes each text takes the one that most texts share, so near copies meet."""
    slots = rows.select("keys", F.posexplode("keys").alias("slot", "key"))
    shared = slots.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n"))
    return slots.distinct().join(shared, ["slot", "key"]).groupBy("keys").agg(F.max_by("key", F.struct("n", "slot")).alias("class"))


# ---- 4. scores


class _Score:
    def __init__(self, model, lexicon: Lexicon):
        self.model, self.lexicon = model, lexicon

    def start(self):
        restore, entries = Restorer(self.model), self.lexicon.entries
        least = min(PREFIX_LENGTHS)
        begins = {f[1 : least + 1] for f in entries}
        # a text without an entry: the share of toxic rows that the entries leave, far below the threshold
        floor = min(0.3, self.lexicon.base / 2)

        def found(text: str) -> set[str]:
            """The entry of the highest rate of each word that has any."""
            out = set()
            for w in {*_WORD.findall(text)}:
                if w[:least] in begins and (own := [f for f in features_of(w) if f in entries]):
                    out.add(max(own, key=lambda f: (entries[f], f)))
            return out

        def one(text):
            low = (text or "").lower()
            whole, restored = restore.text(low)
            hits = found(low)
            if restored:
                hits |= found(whole)
            miss = 1 - floor
            for f in sorted(hits):
                miss *= 1 - entries[f]
            return 1 - miss, " ".join(restored), sorted(f[1:] for f in hits)

        def run(cols):
            got = [one(t) for t in cols["text"]]
            scores = [float(min(1.0, max(0.0, g[0]))) for g in got]
            return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores], "restored": [g[1] for g in got], "found": [g[2] for g in got]}

        return run


def score_toxicity(docs: DataFrame, training: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted, restored readings and entries found, for every row of ``docs``.

    Two narrow passes over whole texts and one over the labelled sample; the model sent to tasks is
    a table of 32**3 numbers and the lexicon.
    """
    model = character_model(docs)
    lexicon = learn_lexicon(training, labels, model, max_labelled)
    rows = docs.select(docs["doc_id"].cast("long"), (id_remainder() == 1).alias("held_out"), "text")
    arrow = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("restored", pa.string()), ("found", pa.list_(pa.string()))])
    return map_slices(rows, _Score(model, lexicon), "doc_id long, held_out boolean, score double, predicted int, restored string, found array<string>", arrow)


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not predicted toxic, with the columns of documents.

    The whole row goes through the scoring pass, so nothing is joined or shuffled.
    """
    model = character_model(docs)
    lexicon = learn_lexicon(docs, labels, model)
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("predicted", pa.int32())])
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang", "source", F.col("n_chars").cast("long"), F.lit(False).alias("held_out"))
    scored = map_slices(rows, _KeepRow(model, lexicon), "doc_id long, text string, lang string, source string, n_chars long, predicted int", arrow)
    return scored.where("predicted = 0").drop("predicted")


class _KeepRow(_Score):
    def start(self):
        score = super().start()

        def run(cols):
            got = score(cols)
            return {n: cols[n] for n in ("doc_id", "text", "lang", "source", "n_chars")} | {"predicted": got["predicted"]}

        return run

