"""The whole pipeline against a plain version of its stages on a small table."""

import re

import numpy as np
import pytest

import corpus_pipeline
from blockweave.llm import packing, pii
from test_near_duplicates import exact_classes, word

TOXIC = ["moron", "idiot"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(20)
    prose = lambda n: [word(rng) for _ in range(n)]
    items = [prose(30) for _ in range(4)]
    rows, labels = [], []
    for i in range(240):
        words = prose(int(rng.integers(20, 60)))
        if i % 4 == 0:
            words.insert(5, TOXIC[i // 4 % 2])
        labels.append((i, int(i % 4 == 0)))
        rows.append((i, " ".join(words)))
    copied = prose(80)
    rows += [(300 + i, " ".join([*copied[:i], word(rng), *copied[i + 1 :]])) for i in range(6)]
    rows += [(400, " ".join(prose(20) + items[0] + prose(20))), (401, " ".join(prose(20) + items[1])), (402, "m0r0n " + " ".join(prose(30)))]
    rows += [(500, "call 4111111111111111 now " + " ".join(prose(20))), (501, ""), (502, None), (None, " ".join(prose(15))), (503, " ".join(prose(9000)))]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, part string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def plain_pipeline(rows, items):
    """doc_id and token counts of what should be left, by exact words, sets and passages."""
    left = [(i, t) for i, t in rows if not set(re.findall("[a-z]+", (t or "").replace("0", "o"))) & set(TOXIC)]
    classes = exact_classes([t for _, t in left], 5, 80)
    left = [row for k, row in enumerate(left) if classes[k] == k]
    left = [(i, t) for i, t in left if not any(" ".join(w) in (t or "") for w in items)]
    encode = packing.word_encoder(packing.tokenizer_path())
    out = {}
    for i, t in left:
        out[i] = len(encode(pii.pseudonymise(t, b"key")[0] or "")) // 4 + 1
    return out


def test_whole_pipeline(spark, tables):
    folder, rows, items = tables
    got = corpus_pipeline.run(spark, folder).toPandas()
    want = plain_pipeline(rows, items)
    assert set(got.doc_id.dropna().astype(int)) == {i for i in want if i is not None} and got.doc_id.isna().sum() == 1
    lengths = got.dropna(subset="doc_id").groupby("doc_id").length.sum()
    assert {int(i): int(n) for i, n in lengths.items() if i != 500} == {i: n for i, n in want.items() if i not in (None, 500)}
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= 4096 and s.offset.tolist() == [0, *s.length.cumsum()[:-1]]


def test_stages_on_empty_tables(spark, tables):
    folder = tables[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
