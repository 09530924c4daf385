"""Sum-of-squares packing of documents into sequences of a fixed number of tokens.

Documents are tokenized and closed by an end id; longer ones are cut into whole sequences and a
rest. The rests are packed in independent groups, each by the sum-of-squares rule: with
N(g) open sequences of residual gap g, a piece goes where the sum over g of N(g)^2 becomes smallest
(a new sequence included; of equals the smallest gap). Within a group larger pieces go first.

Cases: a null or empty text is the end id alone; null ids are packed as any other; equal rows are packed as separate documents, and
however many there are they are dealt to all groups; a document of exactly the length fills a sequence; very long texts are tokenized
whole and cut; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import map_slices

LENGTH = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Documents packed together. A group leaves a few sequences unfilled, so larger is tighter.
GROUP_DOCS = 16_384
#: Words, and letter runs or signs within words, whose ids a worker remembers.
_REMEMBERED = 600_000
#: Longer words seldom come again and aren't remembered.
_SHORT = 18
# Characters that Python's split takes for white space and the tokenizer doesn't, and the one
# whose lower case depends on its place in Python only: such texts go to the tokenizer whole.
# Letters of Latin scripts, ASCII signs and common quotes: words of these are cut here, all others by the tokenizer.
_PLAIN = re.compile("[!-~\u00a1-\u024f\u2013-\u2022\u2026\u20ac]+").fullmatch
_WHOLE = re.compile("[\x1c-\x1f\u03a3]|<\\|")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Token ids of whole texts, exactly as the tokenizer gives them, but word by word.

    The tokenizer normalises (NFC, lower case), never joins characters across white space, cuts
    words into runs of letters, single digits and runs of signs, and merges within these only. So
    a text's ids are those of its words in order. Ids of words and of their parts are remembered;
    unknown parts go to the tokenizer's merge model. ``check`` compares with the tokenizer.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the tokenizer's own pattern for the parts of a word
        pattern = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.parts = regex.compile(pattern).findall
        # byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: 256 + i for i, b in enumerate(others)}
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        got = self.known.get(part)
        if got is None:
            if len(self.known) > _REMEMBERED:
                self.known.clear()
            mapped = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(mapped)]
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(part) <= _SHORT:
                self.known[part] = got
        return got

    def _word(self, word: str) -> bytes:
        if not _PLAIN(word):
            parts, got = [], self.whole(word)
        elif word.isalpha():
            parts = [word]
        else:
            parts = self.parts(word)
        got = got if not parts else self._part(parts[0]) if len(parts) == 1 else b"".join([self._part(p) for p in parts])
        if len(word) <= _SHORT:
            if len(self.words) > _REMEMBERED:
                self.words.clear()
            self.words[word] = got
        return got

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if _WHOLE.search(text) or "\x00" in text:
            return self.whole(text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        get, word = self.words.get, self._word
        return b"".join([get(w) or word(w) for w in text.lower().split()])


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder a worker, kept over tasks."""
    return WordEncoder(path)


class _Pieces:
    """Pieces of documents with their packing group. Rows equal in id and text, which a hash can't part, are dealt on from the second of a task."""

    def __init__(self, path: str, length: int, end_id: int, groups: int):
        self.path, self.length, self.end, self.groups = path, length, np.array([end_id], "<u4").tobytes(), groups

    def start(self):
        encode, width, end = word_encoder(self.path), 4 * self.length, self.end
        task = TaskContext.get()
        seen, partition = Counter(), task.partitionId() if task else 0

        def run(cols):
            out = {n: [] for n in ("doc_id", "pack_group", "piece", "start", "length", "ids_crc32")}
            for doc_id, mark, group, text in zip(cols["doc_id"], cols["mark"], cols["pack_group"], cols["text"], strict=True):
                if seen[mark]:
                    group = zlib.crc32(f"{mark} {seen[mark]} {partition}".encode()) % self.groups
                seen[mark] += 1
                ids = encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    for n, v in zip(out, (doc_id, group, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[n].append(v)
            return out

        return run


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece, in the order given; sizes from 1 to ``length``."""
    count = np.zeros(length + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(length + 1)]
    bins, offsets, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    worst = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        # change of the sum of squares for a piece put in gap g >= s; index 0 is g = s, which closes a sequence
        change = 2 * (count[: length - s] - count[s:length]) + 2
        if s < length:
            change[0] = 1 - 2 * count[s]
            change[count[s:length] == 0] = worst
            k = int(change.argmin())
            best = int(change[k])
        else:
            k, best = 0, worst
        anew = 2 * int(count[length - s]) + 1 if s < length else 0
        if best <= anew and best < worst:
            gap = s + k
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = length, made
            made += 1
        bins[i], offsets[i] = b, length - gap
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def _pack_group(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=[False, True, True, True], ignore_index=True)
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), length)
        pdf["sequence_id"] = (pdf["pack_group"].to_numpy() << 32) + bins
        pdf["offset"] = offsets
        return pdf.drop(columns="pack_group")

    return run


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Texts are tokenized where they are read; only narrow piece rows are shuffled, by a hash of
    the id into groups whose number grows with the documents.
    """
    groups = max(1, -(-docs.count() // group_docs))
    mark = F.xxhash64("doc_id", F.crc32("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), F.pmod(mark, F.lit(groups)).cast("long").alias("pack_group"), "text")
    arrow = pa.schema([("doc_id", pa.int64()), ("pack_group", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    pieces = map_slices(rows, _Pieces(path or tokenizer_path(), length, end_id, groups), "doc_id long, pack_group long, piece int, start long, length long, ids_crc32 long", arrow)
    return pieces.groupBy("pack_group").applyInPandas(_pack_group(length), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
