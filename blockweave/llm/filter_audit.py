"""What each of five quality filters removes, in every order of application. DataFrame functions only.

Each text is read once and becomes a narrow row: a digest and four failure bits (A to D). The fifth bit (E, an exact copy of a smaller
doc_id's text) comes from a groupBy on the digest, which is summed before it is shuffled, and a join on doc_id and digest, so that a text
with a third of all rows makes no large key. Masks are then counted: 32 cells a part. Every figure of every order follows from the cells.

Cases: a null text is empty; an empty text has no words, so it fails A, and E if a smaller id is empty too; words of any length and number
are counted in whole texts. A null doc_id is not larger than any id, so it never fails E, and it has no labels. Rows equal in id and text
are no copies of each other. A null source and an empty one are the same part. Of repeated label rows one with the value 1 decides. A
document without a label row is neither good nor toxic. An empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import materialised

#: Fixed values of the audit: names of the filters, in the order of their bits.
FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = r"[#$%&*|]"
N_CELLS = 1 << len(FILTERS)


def failure_bits(text: Column) -> Column:
    """Bits A to D of a text that is not null."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    short = F.size(words) < 200
    repeated = 100 * F.size(F.array_distinct(words)) < 50 * F.size(words)
    loud = 100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) > 2 * F.length(text)
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate((short, repeated, loud, text.rlike(SIGNS)))), F.lit(0))


def mask_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of every document."""
    text = F.coalesce("text", F.lit(""))
    narrow = materialised(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failure_bits(text).alias("bits")))
    firsts = narrow.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("is_first", F.lit(True))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.when(F.col("doc_id").isNotNull() & F.col("is_first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    return (
        narrow.join(firsts, ["doc_id", "digest"], "left").join(known, "doc_id", "left")
        .select("part", F.col("bits").bitwiseOR(copy).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    )


def mask_histogram(rows: DataFrame) -> DataFrame:
    """Cells of each part: n, good and toxic documents by mask."""
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def order_effects(cells: DataFrame) -> DataFrame:
    """One row a part, order and step, from arrays of a part's 32 cells.

    Of the orders of all filters, a mask of b bits is removed by each of its filters in 120 / b.
    """
    at = lambda mask, column: F.coalesce(F.max(F.when(F.col("mask") == mask, F.col(column))), F.lit(0)).cast("long")
    parts = cells.groupBy("part").agg(*[F.array(*[at(m, c) for m in range(N_CELLS)]).alias(c) for c in ("n", "good", "toxic")])
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = (
        parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.array(*[F.lit(s) for s in range(1, len(FILTERS) + 1)])))
        .withColumn("own", F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, step, 1)) - 1)"))
        .withColumn("before", F.expr(f"aggregate(sequence(1, step), 0, (a, s) -> if(s < step, a | shiftleft(1, instr('{FILTERS}', substring(filter_order, s, 1)) - 1), a))"))
    )
    total = lambda column, condition, factor="1": F.expr(f"aggregate(sequence(0, {N_CELLS - 1}), 0L, (a, m) -> if({condition}, a + {column}[m] * ({factor}), a))")
    removed = "(m & own) <> 0 and (m & before) = 0"
    orders_won = f"{len(orders)} div bit_count(m)"
    return steps.select(
        "part", "filter_order", "step",
        total("n", "(m & (own | before)) = 0").alias("kept"),
        total("n", removed).alias("removed"),
        total("n", "(m & own) <> 0 and (m & before) <> 0").alias("redundant"),
        F.expr("n[own]").alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("n", "(m & own) <> 0", orders_won).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return order_effects(mask_histogram(mask_rows(docs, labels)))
