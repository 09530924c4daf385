"""Merkle fingerprints of texts. DataFrame functions only.

The tree's leaves are pieces of a paragraph (line): they end after a word whose last letter is one of
BORDERS, or at LONGEST characters, so an edit moves no border beyond the next one. A paragraph's digest is over those of
its pieces, a section's over those of its paragraphs: sections end where a paragraph's digest ends in 0 to 3. The root is over the
sections. All digests are whole, so equal roots mean equal texts. Sections, paragraphs and pieces that
differ locate edits (``differing_sections``); likeness of two fingerprints is the Dice measure of their trees' distinct leaves.

Cases: a null text counts as empty and has one empty paragraph; two texts without pieces
have likeness 1, one without and one with 0; null ids sort after all others and repeated ids by
text; with a single row the next document is itself; an empty table gives no rows; very long texts are read
whole, and a paragraph's pieces are found in one pass over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BORDERS, LONGEST = "dgklmrw", 80
_PIECE = r"[^\n]{1,%d}?(?:[%s] |\z)|[^\n]{1,%d}" % (LONGEST, BORDERS, LONGEST)
#: Rows that a bucket of neighbours aims at, and buckets at most (their borders are broadcast). Beyond 1.3 million
#: rows buckets grow; their rows are sorted on disk where memory is short.
BUCKET_ROWS, MAX_BUCKETS = 64, 20_000
_LOWEST = -(2**63)


def piece_digests(text: Column) -> Column:
    """Digests of the pieces of each paragraph, in order."""
    return F.transform(F.split(text, "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(_PIECE), F.lit(0)), lambda x: F.sha2(x, 256)))


def paragraph_digests(pieces: Column) -> Column:
    return F.transform(pieces, lambda p: F.sha2(F.array_join(p, ""), 256))


def section_digests(paragraphs: Column) -> Column:
    joined = F.concat(F.array_join(paragraphs, ";"), F.lit(";"))
    return F.transform(F.split(F.regexp_replace(joined, "([0-3]);", "$1;|"), "\\|", -1), lambda s: F.sha2(s, 256))


def root_digest(sections: Column) -> Column:
    return F.sha2(F.array_join(sections, ""), 256)


def likeness(a: Column, b: Column) -> Column:
    """Dice measure of the distinct leaves of two trees, given as piece digests by paragraph."""
    a, b = F.array_distinct(F.flatten(a)), F.array_distinct(F.flatten(b))
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(F.round(2.0 * F.size(F.array_intersect(a, b)) / both, 9))


def merkle_tree(docs: DataFrame) -> DataFrame:
    """doc_id, root, and the digests of sections, paragraphs and pieces, in order, of every row. Narrow."""
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), piece_digests(F.coalesce(F.col("text"), F.lit(""))).alias("pieces"))
    tree = leaves.withColumn("paragraphs", paragraph_digests(F.col("pieces"))).withColumn("sections", section_digests(F.col("paragraphs")))
    return tree.select("doc_id", root_digest(F.col("sections")).alias("root"), "sections", "paragraphs", "pieces")


def differing_sections(a: Column, b: Column) -> Column:
    """Positions from 0 of the sections of ``a`` that ``b`` has nowhere. Only those that differ are looked up."""
    apart = F.array_except(a, b)
    return F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.array_contains(apart, F.element_at(a, (i + 1).cast("int"))))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds lie below the key: a search in two steps over a square arrangement."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    ends = F.array(*[F.lit(r[-1]) for r in rows])
    table = F.expr("array(" + ",".join("array(" + ",".join(f"{v}L" for v in r) + ")" for r in rows) + ")")
    return _two_step(key, ends, table, step)


def _two_step(key: Column, ends: Column, table: Column, step: int) -> Column:
    row = F.size(F.filter(ends, lambda x: x < key))
    inside = F.coalesce(F.size(F.filter(F.try_element_at(table, row + 1), lambda x: x < key)), F.lit(0))
    return row * step + F.greatest(inside, F.lit(0))


def with_next_text(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text of the next document in descending order of doc_id (after the last: the first).

    Rows go to buckets of neighbouring ids, and the first row of each bucket also, as a guest, to the
    bucket before it. So each text is shuffled once (1 in BUCKET_ROWS twice) and
    no task holds more than its buckets. Broadcast: two numbers a bucket, MAX_BUCKETS rows at most.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("k", F.coalesce(F.col("doc_id"), F.lit(_LOWEST)))
    n = docs.count()
    wanted = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("k"))
    bounds: list[int] = []
    if wanted > 1:
        found = ids.agg(F.percentile_approx("k", [i / wanted for i in range(1, wanted)], F.lit(10 * wanted))).first()[0]
        bounds = sorted(set(found or []))
    bucket = _bucket(F.col("k"), bounds)
    firsts = ids.withColumn("bucket", bucket).groupBy("bucket").agg(F.max("k").alias("k")).orderBy("bucket").collect()  # MAX_BUCKETS rows at most
    above = [r.bucket for r in firsts[1:]] + [r.bucket for r in firsts[:1]]
    guests = spark.createDataFrame([(r.k, b) for r, b in zip(firsts, above, strict=True)], "k long, guest_of int")
    placed = (
        rows.withColumn("own", bucket)
        .join(F.broadcast(guests), "k", "left")
        .withColumn("at", F.explode(F.when(F.col("guest_of").isNull(), F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("guest")))).otherwise(F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("guest")), F.struct(F.col("guest_of").alias("bucket"), F.lit(1).alias("guest"))))))
        .select("doc_id", "text", "k", "at.bucket", "at.guest")
    )
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("k"), F.desc("text"))
    return placed.withColumn("next_text", F.lead("text").over(order)).where("guest = 0").select("doc_id", "text", "next_text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; see the module."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    leaves = with_next_text(docs).select(
        "doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), piece_digests(F.col("text")).alias("own"), piece_digests(edited).alias("other"), piece_digests(F.col("next_text")).alias("next")
    )
    sections = leaves.withColumn("mine", section_digests(paragraph_digests(F.col("own")))).withColumn("theirs", section_digests(paragraph_digests(F.col("other"))))
    return sections.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        root_digest(F.col("mine")).alias("fingerprint"),
        root_digest(F.col("theirs")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
        F.size("mine").cast("long").alias("n_sections"),
        F.size(F.array_except("mine", "theirs")).cast("long").alias("n_differing"),
    )
