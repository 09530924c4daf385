"""Mix sources to target weights: a multivariate-hypergeometric splitting tree. DataFrame functions only.

Each source's documents are laid end to end in an order drawn by hash; its target is so many words of that line, gone through at most
three times. The line is cut into blocks, a source's quota. Quotas are divided among output shards by a tree: a node holds some sources and
the blocks that each shard still takes from them; it hands its children (up to FAN of them, one after another) multivariate-hypergeometric
draws, each of which halves the shards again and again, down to one. The leaves are quotas by source and shard, exact in both margins.
A source's blocks are then permuted, its shards take disjoint stretches of them, and a shard's documents are ordered by hash.

Targets: sources in code point order weigh 1, 2, 3, 1, ...; a target is min(3 sizes, weight * level), and the level follows from prefix
sums of the sources by size / weight. Nothing depends on partitions: global orders are total but for rows that are equal in all that counts.

Cases: a null or empty text has size 0 and takes nothing; a null source is a source of its own, the last; an empty source name is not null.
Null ids are ordered by their texts. Rows equal in id and text are documents of their own, which may change places. The last document that
a target reaches is cut, so that a source takes its target to the nearest word. A table without words takes nothing, an empty one gives no rows. Words
beyond the end of a block belong to the block in which their document begins, so a very long document leaves the blocks behind it empty.
Other columns than doc_id, text and source are never read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockweave.llm.common import materialised

#: Words of a block, passes over a source at most, weights by rank.
BLOCK_WORDS, PASSES, WEIGHTS = 2048, 3, 3
#: Children of a node of the tree; bounds what one row holds.
FAN = 64
WORD = r"[^\x20\x09-\x0D]+"
#: Sources that are broadcast, and tasks that a hot source's documents are dealt to beyond.
FEW_SOURCES, SALTS = 50_000, 64
#: Multipliers of the block permutation: primes beyond any quota, so that they have no factor in common with it.
PRIMES = (2305843009213693951, 1152921504606846883, 576460752303423433)


def with_running_total(df: DataFrame, order: list[str], value: str, before: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each, in the order of the named columns.

    One range shuffle; borders are carried by one total a partition.
    """
    ranged = materialised(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    parts = ranged.groupBy("_part").agg(F.sum(value).alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"))
    return ranged.withColumn(before, F.coalesce(F.sum(value).over(upto), F.lit(0))).join(F.broadcast(parts), "_part").withColumn(before, F.col(before) + F.col("_carried")).drop("_part", "_carried")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def uniform(seed: int, *key: Column) -> Column:
    """A number between 0 and 1 as a function of the seed and the key."""
    return (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def hypergeometric(population: Column, marked: Column, draws: Column, u: Column) -> Column:
    """Marked ones among ``draws`` without replacement, by inversion over eight standard deviations to either side of the mode.

    Probabilities are built from ratios of neighbours, so no factorials are needed; what lies beyond has a probability below 1e-13.
    """
    return let(
        F.struct(population.cast("double").alias("m"), marked.cast("double").alias("k"), draws.cast("double").alias("n"), u.alias("u")),
        lambda a: F.when((a["n"] <= 0) | (a["k"] <= 0), F.lit(0).cast("long")).when(a["k"] >= a["m"], a["n"].cast("long")).when(a["n"] >= a["m"], a["k"].cast("long")).otherwise(_inverted(a)),
    )


def _inverted(a: Column) -> Column:
    m, k, n = a["m"], a["k"], a["n"]
    mode = F.floor((n + 1) * (k + 1) / (m + 2))
    reach = F.ceil(8 * F.sqrt(n * k / m * (1 - k / m) * (m - n) / F.greatest(m - 1, F.lit(1.0)))) + 4
    low = F.greatest(F.lit(0), (n + k - m).cast("long"), mode - reach)
    high = F.least(n.cast("long"), k.cast("long"), mode + reach)
    ratio = lambda x: (k - x + 1) * (n - x + 1) / (x * (m - k - n + x))  # noqa: E731  p(x) / p(x - 1)

    def sums(low: Column, high: Column) -> Column:
        """Weights of low to high, p(low) = 1, as running sums; the values above the drawn height are counted off."""
        steps = F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<bigint>"))
        total = F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("s")), lambda t, x: let(t["w"] * ratio(x), lambda w: F.struct(w.alias("w"), (t["s"] + w).alias("s"))))
        walk = lambda height: F.aggregate(
            steps,
            F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("s"), low.alias("x")),
            lambda t, x: let(t["w"] * ratio(x), lambda w: F.struct(w.alias("w"), (t["s"] + w).alias("s"), F.when(t["s"] <= height, x).otherwise(t["x"]).alias("x"))),
        )["x"]
        return let(total["s"] * a["u"], walk)

    return let(F.struct(low.alias("low"), high.alias("high")), lambda b: sums(b["low"], b["high"]))


def split_among_shards(room: Column, draws: Column, levels: int, seed: int, key: Column) -> Column:
    """Draws of each of 2^levels shards with so much ``room`` (an array): halves of the shards, then halves of these, down to one."""

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0).cast("long"), lambda t, x: t + x)

    def halved(level: int, drawn: Column) -> Column:
        """Draws of the 2^(level + 1) halves, from those of the nodes above."""
        half = 1 << (levels - level - 1)  # shards of a half

        def node(i: Column) -> Column:
            left, right = total(F.slice(room, 2 * half * i + 1, half)), total(F.slice(room, 2 * half * i + half + 1, half))
            own = F.get(drawn, i)
            return let(hypergeometric(left + right, left, own, uniform(seed, key, F.lit(level), i)), lambda x: F.array(x, own - x))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit((1 << level) - 1)), node))

    drawn = F.array(draws.cast("long"))
    for level in range(levels):
        drawn = let(drawn, functools.partial(halved, level))
    return drawn


def source_targets(sources: DataFrame) -> DataFrame:
    """no_source, name, source_size -> rank, weight and target: shares of all words by weight, at most PASSES times a source's size."""
    ranked = with_running_total(sources.withColumn("_one", F.lit(1)), ["no_source", "name"], "_one", "rank").drop("_one").withColumn("weight", F.col("rank") % WEIGHTS + 1).withColumn("ratio", PASSES * F.col("source_size") / F.col("weight"))
    capped = with_running_total(ranked.withColumn("cap", PASSES * F.col("source_size")), ["ratio", "rank"], "cap", "cap_before")
    sums = with_running_total(capped, ["ratio", "rank"], "weight", "weight_before")
    whole = sums.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))  # one row
    # sources by size / weight: those before the first whose cap holds its share are capped, and the level follows
    held = sums.join(F.broadcast(whole)).where((F.col("weights") - F.col("weight_before")) * F.col("ratio") <= F.col("words") - F.col("cap_before"))
    spent = held.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("cap_spent"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight_spent"))
    level = whole.join(F.broadcast(spent)).select(((F.col("words") - F.col("cap_spent")) / F.when(F.col("weights") > F.col("weight_spent"), F.col("weights") - F.col("weight_spent"))).alias("level"))
    share = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap").cast("double")))
    return sums.join(F.broadcast(level)).select("no_source", "name", "source_size", "rank", "weight", share.alias("target"))


def shard_quotas(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """rank and quota of each source -> ``shards``, its blocks by shard (n_shards numbers).

    The tree's nodes are ranges of ranks: FAN to the power of its height sources below the root.
    """
    levels = max(0, (n_shards - 1).bit_length())

    def hand_out(step: int) -> Callable[[Column, Column], Column]:
        """A child's draws leave the room of its node."""

        def draw(t: Column, c: Column) -> Column:
            got = split_among_shards(t["room"], c["draws"], levels, seed, F.struct(F.lit(step), c["child"]))
            return let(got, lambda g: F.struct(F.zip_with(t["room"], g, lambda r, x: r - x).alias("room"), F.concat(t["out"], F.array(F.struct(c["child"].alias("node"), g.alias("room")))).alias("out")))

        return draw

    totals = quotas.agg(F.sum("quota").alias("all"), F.max("rank").alias("last")).first()  # one row
    if totals["all"] is None:
        return quotas.withColumn("shards", F.array().cast("array<bigint>")).limit(0)
    height = 1
    while FAN**height <= totals["last"]:
        height += 1
    blocks = int(totals["all"])
    room = [blocks * (k + 1) // n_shards - blocks * k // n_shards if k < n_shards else 0 for k in range(1 << levels)]
    state = quotas.limit(1).select(F.lit(0).cast("long").alias("node"), F.array(*[F.lit(x).cast("long") for x in room]).alias("room"))
    for step in range(height - 1, -1, -1):
        below = FAN**step
        child = F.floor(F.col("rank") / below).cast("long")
        children = quotas.groupBy(child.alias("child")).agg(F.sum("quota").alias("draws")).groupBy(F.floor(F.col("child") / FAN).cast("long").alias("node")).agg(F.array_sort(F.collect_list(F.struct("child", "draws"))).alias("children"))

        start = F.struct(F.col("room"), F.array().cast("array<struct<node: bigint, room: array<bigint>>>").alias("out"))
        state = state.join(children, "node").select(F.explode(F.aggregate("children", start, hand_out(step))["out"]).alias("x")).select("x.node", "x.room")
    return quotas.join(state.select(F.col("node").alias("rank"), F.slice("room", 1, n_shards).alias("shards")), "rank")


def _with_sources(line: DataFrame, about: DataFrame, n_sources: int) -> DataFrame:
    """Documents with their source's row: broadcast while there are few sources, else joined with each source's rows dealt to SALTS tasks."""
    if n_sources <= FEW_SOURCES:
        return line.join(F.broadcast(about), ["no_source", "name"])
    salted = about.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return line.withColumn("_salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(salted, ["no_source", "name", "_salt"]).drop("_salt")


def _pass_words(k: int) -> Column:
    """Words that pass ``k`` over the source takes from the document at ``at``."""
    start = F.col("at") + k * F.col("source_size")
    return F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - start)).cast("long")


def _permuted(block: Column, quota: Column, seed: int) -> Column:
    """Place of a block among its source's, a bijection of 0 to quota - 1: multiplied by a prime and moved, all modulo the quota."""
    prime = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(F.xxhash64(F.lit(seed), F.col("rank")), F.lit(len(PRIMES))) + 1).cast("int"))
    step = F.pmod(prime, quota)
    return F.pmod((block.cast("decimal(19,0)") * step + F.pmod(F.xxhash64(F.lit(seed + 1), F.col("rank")), quota)), quota).cast("long")


def mix_documents(docs: DataFrame, n_shards: int = 8, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, and ``draws``: (pass, words, block, shard, key) of every time the mix takes the document.

    A shard's documents are read in the order of ``key``. Texts are read once and only counted and hashed; narrow rows move.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("name"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"),
    )
    line = materialised(with_running_total(narrow, ["no_source", "name", "key", "doc_id", "size"], "size", "before"))
    sources = line.groupBy("no_source", "name").agg(F.sum("size").alias("source_size"), F.min("before").alias("begins"))
    targets = materialised(source_targets(sources.drop("begins")))
    goals = targets.withColumn("goal", F.round("target").cast("long")).withColumn("quota", F.ceil(F.col("goal") / block_words).cast("long"))
    quotas = materialised(shard_quotas(goals.select("rank", "quota"), n_shards, seed).select("rank", "shards"))
    about = goals.join(quotas, "rank").join(sources.drop("source_size"), ["no_source", "name"])
    placed = _with_sources(line, about, goals.count()).withColumn("at", F.col("before") - F.col("begins"))
    upto = F.transform(F.sequence(F.lit(1), F.lit(n_shards)), lambda i: F.aggregate(F.slice("shards", 1, i), F.lit(0).cast("long"), lambda t, x: t + x))

    def draw(k: int) -> Column:
        block = F.floor((F.col("at") + k * F.col("source_size")) / block_words).cast("long")
        place = _permuted(block, F.greatest("quota", F.lit(1)), seed)
        shard = let(place, lambda p: F.size(F.filter("upto", lambda x: x <= p)))
        return F.when(_pass_words(k) > 0, F.struct(F.lit(k).alias("pass"), _pass_words(k).alias("words"), block.alias("block"), shard.alias("shard"), F.xxhash64(F.lit(seed + 2 + k), "key", "doc_id").alias("key")))

    draws = F.filter(F.array(*[draw(k) for k in range(PASSES)]), lambda d: d.isNotNull())
    return placed.withColumn("upto", upto).select(
        "doc_id", "size", F.when(~F.col("no_source"), F.col("name")).alias("source"), "source_size", "target",
        sum((_pass_words(k) for k in range(1, PASSES)), _pass_words(0)).alias("taken"), draws.alias("draws"),
    )


def write_mix(docs: DataFrame, mixed: DataFrame, folder: str, files_a_shard: int = 1) -> None:
    """The mix as Parquet, by shard: each document as often as it was drawn, cut to ``words`` words, a file's rows in the order of the keys."""
    drawn = mixed.select("doc_id", F.explode("draws").alias("d")).select("doc_id", "d.*")
    rows = drawn.join(docs.select("doc_id", "text"), "doc_id").withColumn("text", F.when(F.regexp_count("text", F.lit(WORD)) > F.col("words"), F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("words").cast("int")), " ")).otherwise(F.col("text")))
    dealt = rows.withColumn("_file", F.pmod(F.col("key"), F.lit(files_a_shard))).repartition("shard", "_file").sortWithinPartitions("shard", "key")
    dealt.select("shard", "doc_id", "pass", "block", "text").write.partitionBy("shard").parquet(folder)
