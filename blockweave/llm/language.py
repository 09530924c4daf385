"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. The trigram abc is bound as rot2(a) * rot1(b) * c,
where rot is a cyclic shift; a text is the bundle (sum) of its trigram vectors and a language
the bundle of its texts. All bundles are centred on the mean trigram vector of the training text, and a
document takes the language whose prototype has the largest cosine with it.

Letters: the text in lower case; code points that are not letters become one gap symbol, runs of
it collapse. Letters outside the fixed alphabet fall into a few shared symbols.

Cases: null texts and texts without a letter are ``und`` with score 0; ties go to the language
that sorts first; without a labelled row everything is ``und``; repeated rows count repeatedly; an empty table gives no rows; very long texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import id_remainder, map_slices

DIM = 1024
SEED = 20240611
# Letters with a symbol of their own; all others share SHARED symbols.
ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâäåæçèéêëìíîïñòóôöøùúûüÿœ"
SHARED = 8
SYMBOLS = 1 + len(ALPHABET) + SHARED
_LOW = 0x250


def _symbol_table() -> np.ndarray:
    table = np.zeros(_LOW, np.int64)
    for cp in range(_LOW):
        ch = chr(cp).lower()[:1]
        if ch.isalpha():
            table[cp] = ALPHABET.find(ch) + 1 if ch in ALPHABET else 1 + len(ALPHABET) + cp % SHARED
    return table


def trigrams(text: str | None, table: np.ndarray) -> np.ndarray:
    """Codes of all trigrams of a text, gaps at both ends included; empty without a letter."""
    if not text:
        return np.empty(0, np.int64)
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sym = table[np.minimum(cps, _LOW - 1)]
    for at in np.flatnonzero(cps >= _LOW):
        cp = int(cps[at])
        sym[at] = (1 + len(ALPHABET) + cp % SHARED if chr(cp).isalpha() else 0) if cp < 0xD800 or cp > 0xDFFF else 0
    if not sym.any():
        return np.empty(0, np.int64)
    sym = np.concatenate([[0], sym, [0]])
    sym = sym[np.concatenate([[True], (sym[1:] != 0) | (sym[:-1] != 0)])]
    if len(sym) < 3:
        return np.empty(0, np.int64)
    return (sym[:-2] * SYMBOLS + sym[1:-1]) * SYMBOLS + sym[2:]


class Binder:
    """Trigram vectors, bound when first met; at most SYMBOLS**3 rows of DIM bytes."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim = dim
        self.letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dim))
        self.row = np.full(SYMBOLS**3, -1, np.int32)
        self.table = np.empty((1024, dim), np.int8)
        self.used = 0

    def rows(self, grams: np.ndarray) -> np.ndarray:
        new = grams[self.row[grams] < 0]
        if len(new):
            while self.used + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            a, b, c = new // SYMBOLS**2, new // SYMBOLS % SYMBOLS, new % SYMBOLS
            self.table[self.used : self.used + len(new)] = np.roll(self.letters[a], 2, 1) * np.roll(self.letters[b], 1, 1) * self.letters[c]
            self.row[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
        return self.table[self.row[grams]]

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dim, np.float64)
        for at in range(0, len(grams), 4096):
            out += counts[at : at + 4096].astype(np.float32) @ self.rows(grams[at : at + 4096]).astype(np.float32)
        return out


class _Count:
    """Trigram counts by language of a partition."""

    def start(self):
        return _Counting()


class _Counting:
    def __init__(self):
        self.table, self.counts, self.held, self.size = _symbol_table(), {}, {}, 0

    def __call__(self, cols):
        for text, lang in zip(cols["text"], cols["lang"], strict=True):
            g = trigrams(text, self.table)
            self.held.setdefault(lang, []).append(g)
            self.size += len(g)
        if self.size > 2_000_000:
            self._fold()
        return None

    def _fold(self):
        for lang, parts in self.held.items():
            u, n = np.unique(np.concatenate(parts), return_counts=True)
            have = self.counts.setdefault(lang, np.zeros(SYMBOLS**3, np.int64))
            have[u] += n
        self.held, self.size = {}, 0

    def finish(self):
        self._fold()
        for lang, have in self.counts.items():
            g = np.flatnonzero(have)
            yield {"lang": [lang] * len(g), "gram": g.tolist(), "n": have[g].tolist()}


def train_prototypes(docs: DataFrame, dim: int = DIM, seed: int = SEED) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their centred unit prototypes and the centre, from (text, lang) rows.

    Counts are summed per (language, trigram) by Spark; the driver gets at most
    SYMBOLS**3 numbers a language however much text there is.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counted = map_slices(rows, _Count(), "lang string, gram long, n long", pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())]))
    got = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    binder = Binder(dim, seed)
    protos = np.zeros((len(langs), dim))
    for k, lang in enumerate(langs):
        own = got[got["lang"] == lang].sort_values("gram")
        protos[k] = binder.bundle(own["gram"].to_numpy(), own["n"].to_numpy()) / max(1, own["n"].sum())
    centre = protos.mean(0) if len(langs) > 1 else np.zeros(dim)
    protos -= centre
    norms = np.linalg.norm(protos, axis=1, keepdims=True)
    return langs, protos / np.where(norms > 0, norms, 1), centre


class _Predict:
    def __init__(self, langs, protos, centre, dim, seed):
        self.langs, self.protos, self.centre, self.dim, self.seed = langs, protos, centre, dim, seed

    def start(self):
        binder, table = Binder(self.dim, self.seed), _symbol_table()

        def one(text):
            g = trigrams(text, table)
            if not len(g) or not self.langs:
                return "und", 0.0
            u, n = np.unique(g, return_counts=True)
            v = binder.bundle(u, n) / len(g) - self.centre
            cos = self.protos @ v / (np.linalg.norm(v) or 1.0)
            k = int(np.argmax(np.round(cos, 12)))
            return self.langs[k], float(min(1.0, max(0.0, (1 + cos[k]) / 2)))

        def run(cols):
            got = [one(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

        return run


def identify_language(docs: DataFrame, training: DataFrame, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """Predict every row of ``docs`` from its text alone with prototypes of ``training``.

    Two passes over narrow columns and one shuffle of trigram counts; the model sent to tasks is
    a few vectors. score = (1 + cosine) / 2.
    """
    model = train_prototypes(training, dim, seed)
    rows = docs.select(docs["doc_id"].cast("long"), (id_remainder() == 1).alias("held_out"), "text")
    arrow = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    return map_slices(rows, _Predict(*model, dim, seed), "doc_id long, held_out boolean, lang_pred string, score double", arrow)


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32 of the id's text modulo 3 is not 1."""
    return docs.where(id_remainder() != 1)
