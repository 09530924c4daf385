"""The prefix trie of conversations that share their first turns.

Conversations with the same turns are first made one sequence with a count, so copies never make a large group. Sequences are grouped by the
digest of their first turn. Groups are hash-partitioned into buckets, and a bucket's tries are built in ``applyInPandas``: a dictionary of
pointers from (node, digest) to node, then one pass over the nodes in reverse order of making, which is a postorder without recursion.

A group with more turns than LIMIT is no bucket's: as many turns as all its sequences have in common become a stem, a row a node, from
sums in Spark, and what lies beyond is grouped again by the next turn, until no group is too large. What subtries yield is added up
along the stems at the end. So no task holds more than a bucket, however hot a first turn or however long a conversation is.

The ids of the conversations that end in a node are hashed in the order of the sorted rows, one after another, in constant memory.

Cases: turns are ordered by turn (null first), then role, then text; a null role or text is empty; a turn of empty role and text is a turn.
Rows without conv_id belong to no conversation and are left out. Whole texts count, of any length. Rows equal in all columns are
turns of their own. A conversation all of whose turns its absent base would have given is turnless and ends in the root. An empty table has no node.
Turns and sequences are told apart by 128-bit digests. Other columns than the four are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockweave.llm.common import compact, materialised, parts

#: A conversation's base is the last id divisible by FAMILY; it gives up to HEAD - 1 turns.
FAMILY, HEAD = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
#: Turns of a group that one bucket may hold, and turns of a bucket aimed at.
LIMIT, BUCKET = 100_000, 50_000
NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, d (from 1), digest and words of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    nth = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return own.withColumn("d", F.row_number().over(nth)).select(
        "conv_id", "d", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")
    )


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of the rebuilt conversations: the first h of the family's base, then the conversation's own after its first h."""
    first = turns.where(F.col("d") == 1).select("conv_id")
    ids = first.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % HEAD).cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("d") < HEAD)).select(F.col("conv_id").alias("base"), "d", "digest", "words")
    given = heads.groupBy("base").agg(F.count(F.lit(1)).cast("int").alias("n"))
    about = ids.join(given, "base", "left").withColumn("given", F.least("h", F.coalesce("n", F.lit(0)))).drop("n")
    lent = about.join(heads, "base").where("d <= h").select("conv_id", "d", "digest", "words")
    kept = turns.join(about.select("conv_id", "h", "given"), "conv_id").where("d > h").select("conv_id", (F.col("d") - F.col("h") + F.col("given")).alias("d"), "digest", "words")
    return lent.unionByName(kept), first


def sequences(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """seq (its smallest conv_id), length, n_convs and ends_sha256 of every distinct sequence of turns.

    A sequence is told by the exclusive or of hashes of its turns with their places, which needs no order and is summed before it is shuffled.
    """
    mark = lambda *key: F.bit_xor(F.xxhash64(*key))
    marks = turns.groupBy("conv_id").agg(mark("d", "digest").alias("a"), mark("digest", F.lit(1), "d").alias("b"), F.count(F.lit(1)).alias("length"))
    own = ids.join(marks, "conv_id", "left").na.fill(0)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, n, sha = None, 0, 0, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"seq": [first], "length": [now[2]], "n_convs": [n], "ends_sha256": [sha.hexdigest()]}, schema=schema)

        schema = pa.schema([("seq", pa.int64()), ("length", pa.int64()), ("n_convs", pa.int64()), ("ends_sha256", pa.string())])
        for batch in batches:
            out = []
            for a, b, length, conv in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (a, b, length) != now:
                    if now is not None:
                        out.append(closed())
                    now, first, n, sha = (a, b, length), conv, 0, hashlib.sha256()
                sha.update(f",{conv}".encode() if n else str(conv).encode())
                n += 1
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if now is not None:
            yield closed()

    ordered = own.select("a", "b", "length", "conv_id").repartition("a", "b", "length").sortWithinPartitions("a", "b", "length", "conv_id")
    return ordered.mapInArrow(hashed, "seq long, length long, n_convs long, ends_sha256 string")


def _tries(rows: pd.DataFrame) -> pd.DataFrame:
    """Tries of a bucket: rows (grp, top_conv, base, seq, d, digest, words, n_convs, ends_sha256 where the sequence ends), any order."""
    rows = rows.sort_values(["grp", "seq", "d"], kind="stable")
    child, parent, depth, group, words, smallest, members, ends, top_conv = {}, [], [], [], [], [], [], [], []
    now, at = None, -1
    for grp, top, seq, d, digest, w, n, end in zip(*(rows[c] for c in ("grp", "top_conv", "seq", "d", "digest", "words", "n_convs", "ends_sha256")), strict=True):
        if (grp, seq) != now:
            now, at = (grp, seq), -1
        key = (grp if at < 0 else at, digest)
        node = child.get(key)
        if node is None:
            node = child[key] = len(parent)
            for column, value in ((parent, at), (depth, d), (group, grp), (words, w), (smallest, seq), (members, 0), (ends, None), (top_conv, top)):
                column.append(value)
        at = node
        smallest[at], members[at] = min(smallest[at], seq), members[at] + n
        if end is not None:
            ends[at] = end
    children, leaves, saved = [0] * len(parent), [0] * len(parent), [0] * len(parent)
    for k in range(len(parent) - 1, -1, -1):  # a node is made after its parent
        leaves[k] = leaves[k] or 1
        saved[k] += (members[k] - 1) * words[k]
        if (p := parent[k]) >= 0:
            children[p] += 1
            leaves[p] += leaves[k]
            saved[p] += saved[k]
    return pd.DataFrame({
        "conv_id": smallest, "depth": depth, "parent_conv_id": [top_conv[k] if p < 0 else smallest[p] for k, p in enumerate(parent)], "n_convs": members, "n_children": children,
        "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": [e or NOTHING for e in ends], "grp": [g if p < 0 else None for g, p in zip(group, parent, strict=True)],
    })


def _stems(turns: DataFrame, members: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that all sequences of a large group share (grp, d, words, ...), and the stems' ends (grp, e).

    turns: grp, seq, d, digest, words, n_convs, ends_sha256 of the large groups, beyond their base.
    """
    by_place = turns.groupBy("grp", "d").agg(F.min("digest").alias("x"), F.max("digest").alias("y"), F.count(F.lit(1)).alias("here"), F.min("words").alias("words"), F.max("ends_sha256").alias("ends_sha256"), F.count_distinct("digest").alias("kinds"))
    places = by_place.join(large.select("grp", "n_seqs", "n_convs", "conv_id"), "grp")
    split = places.where((F.col("x") != F.col("y")) | (F.col("here") < F.col("n_seqs"))).groupBy("grp").agg(F.min("d").alias("split"))
    known = places.join(split, "grp", "left")
    shared = known.where("split is null or d < split")
    after = known.where("d = split").select("grp", (F.col("d") - 1).alias("d"), F.col("kinds").alias("n_children"))
    ends = shared.groupBy("grp").agg(F.max("d").alias("e"))
    nodes = shared.join(after, ["grp", "d"], "left").join(ends, "grp").select(
        "grp", "d", "e", "words", "conv_id", "n_convs", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), F.coalesce("n_children", F.when(F.col("d") < F.col("e"), 1).otherwise(0)).cast("long").alias("n_children")
    )
    return nodes, ends


def conversation_trie(conversations: DataFrame, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """One row a node of the trie of rebuilt conversations; the columns of NODE."""
    turns, ids = rebuilt_turns(materialised(numbered_turns(conversations)))
    turns, ids = materialised(turns), materialised(ids)
    seqs = compact(sequences(turns, ids))
    whole = seqs.agg(F.min("seq").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("length").alias("turns"), F.max(F.when(F.col("length") == 0, F.col("ends_sha256"))).alias("ends_sha256")).first()
    spark = conversations.sparkSession
    if whole["conv_id"] is None:
        return spark.createDataFrame([], NODE)
    about = seqs.where("length > 0").withColumnRenamed("seq", "conv_id")
    own = turns.join(about, "conv_id").select(F.col("conv_id").alias("seq"), "d", "digest", "words", "n_convs", F.when(F.col("d") == F.col("length"), F.col("ends_sha256")).alias("ends_sha256"))
    rows = compact(own)

    # groups of sequences with the same turns up to and with the one after ``base``
    members = rows.where("d = 1").select("seq", F.col("digest").alias("grp"), F.lit(0).alias("base"), F.lit(None).cast("binary").alias("above"), F.lit(whole["conv_id"]).cast("long").alias("top_conv"))
    members = compact(members.join(about.select(F.col("conv_id").alias("seq"), "length", "n_convs"), "seq"))
    final, stems = [], []
    while True:
        sizes = members.groupBy("grp").agg(F.sum(F.col("length") - F.col("base")).alias("n_turns"), F.count(F.lit(1)).alias("n_seqs"), F.sum("n_convs").alias("n_convs"), F.min("seq").alias("conv_id"), F.first("above").alias("above"), F.first("top_conv").alias("top_conv"), F.first("base").alias("base"))
        large = compact(sizes.where(F.col("n_turns") > limit))
        n_large = large.count()
        if not n_large:
            final.append(members)
            break
        is_large = members.join(F.broadcast(large.select("grp")) if n_large <= 10_000 else large.select("grp"), "grp", "left_semi")
        final.append(members.join(large.select("grp"), "grp", "left_anti"))
        beyond = rows.join(is_large.select("seq", "grp", "base"), "seq").where("d > base")
        nodes, ends = _stems(beyond, is_large, large)
        nodes = compact(nodes.join(large.select("grp", "above", "top_conv", "base"), "grp"))
        stems.append(nodes)
        nexts = is_large.join(nodes.groupBy("grp").agg(F.first("e").alias("e"), F.first("conv_id").alias("stem_conv")), "grp").where("length > e")
        step = rows.select("seq", F.col("d").alias("_d"), "digest").join(nexts, "seq").where("_d = e + 1")
        members = compact(step.select("seq", F.unhex(F.md5(F.concat("grp", "digest"))).alias("grp"), F.col("e").alias("base"), F.col("grp").alias("above"), F.col("stem_conv").alias("top_conv"), "length", "n_convs"))

    small = final[0]
    for more in final[1:]:
        small = small.unionByName(more)
    small = materialised(small)
    n_buckets = parts(whole["turns"] or 0, bucket)
    dealt = rows.join(small.select("seq", "grp", "base", "top_conv"), "seq").where("d > base").withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(n_buckets)))
    built = materialised(dealt.groupBy("bucket").applyInPandas(lambda b: _tries(b), f"{NODE}, grp binary"))
    inner = built.drop("grp")

    # what hangs below the stems, from the last split to the first; then below the root
    tops = built.where("grp is not null").select("grp", "n_leaves", "saved_tokens").join(small.select("grp", "above").distinct(), "grp").drop("grp")
    for nodes in reversed(stems):
        below = tops.where("above is not null").groupBy(F.col("above").alias("grp")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        upward = Window.partitionBy("grp").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
        full = nodes.join(below, "grp", "left").withColumn("n_leaves", F.coalesce("l", F.lit(1)).cast("long")).withColumn("saved_tokens", F.sum((F.col("n_convs") - 1) * F.col("words")).over(upward) + F.coalesce("s", F.lit(0)))
        full = materialised(full)
        first = F.col("d") == F.col("base") + 1
        inner = inner.unionByName(full.select("conv_id", F.col("d").cast("int").alias("depth"), F.when(first, F.col("top_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
        tops = tops.unionByName(full.where(first).select("n_leaves", "saved_tokens", "above"))
    top = tops.where("above is null").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    root = top.select(
        F.lit(whole["conv_id"]).cast("long").alias("conv_id"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(whole["n_convs"]).cast("long").alias("n_convs"), "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.lit(whole["ends_sha256"] or NOTHING).alias("ends_sha256"),
    )
    return root.unionByName(inner)
