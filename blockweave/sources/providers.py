"""Tables that user code supplies: as a whole, or block by block, where a task asks for the blocks and columns that a job needs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.operators.joins import partition_variants
from blockweave.sources.readers import source

#: ``partition(block, columns)``: the rows of one block, given as its row of the catalog, with the wanted columns in order.
Fetch = Callable[[dict, list[str]], pd.DataFrame]


@dataclass
class Provider:
    """``frame`` is what ``readers.source`` takes; ``partition`` fetches one block's rows; ``types`` has the SQL type of each column."""

    types: dict[str, str]
    frame: DataFrame | str | Callable[[SparkSession, list[str]], DataFrame] | None = None
    partition: Fetch | None = None


def fetch_blocks(catalog: DataFrame, fetch: Fetch, types: dict[str, str], blocks_a_task: int = 4) -> DataFrame:
    """block_id and columns of every block of a catalog, fetched in its task; blocks that a job filters away beforehand are never asked for.

    What a block yields must have the wanted columns; a block may be empty. A fetch that fails fails the job with the block's name.
    """
    columns = list(types)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for block in part.to_dict("records"):
                try:
                    rows = fetch(block, columns)
                except Exception as e:
                    raise RuntimeError(f"the partition callback failed for block {block['block_id']}: {e}") from e
                if lacking := [c for c in columns if c not in rows.columns]:
                    raise ValueError(f"the partition callback lacks {lacking} for block {block['block_id']}")
                yield pd.concat([pd.Series(block["block_id"], rows.index, name="block_id", dtype=object), rows[columns]], axis=1)

    tasks = max(1, -(-catalog.count() // blocks_a_task))
    return catalog.repartition(tasks, "block_id").mapInPandas(run, ", ".join(["block_id string", *(f"`{c}` {t}" for c, t in types.items())]))


def provide(spark: SparkSession, provider: Provider, catalog: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of the catalog's blocks with their block_id: from the partition callback if there is one, else from the whole table by position (CHR, POS)."""
    wanted = list(dict.fromkeys(["CHR", "POS", *(columns or provider.types)]))
    if unknown := [c for c in wanted if c not in provider.types]:
        raise ValueError(f"the provider has no type for {unknown}")
    if provider.partition is not None:
        return fetch_blocks(catalog, provider.partition, {c: provider.types[c] for c in wanted})
    if provider.frame is None:
        raise ValueError("the provider has neither a frame nor a partition callback")
    rows = source(spark, provider.frame, wanted)
    typed = rows.select(*[F.col(c).cast(provider.types[c]).alias(c) for c in wanted])
    return partition_variants(typed, catalog).select("block_id", *wanted)
