"""Tree sequence files: a Python data source over the binary columnar container, and its tables.

The container has a header, a descriptor for each array (type, place of its name, place and length of its values) and the arrays themselves.
The driver reads header and descriptors; a task reads the byte ranges of its own rows from each column it needs. Files may lie on
any file system that pyarrow opens.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Fixed values of the format: magic, sizes, numpy types by type number.
MAGIC, HEADER, DESCRIPTOR = b"\x89KAS\r\n\x1a\n", 64, 64
TYPES = ("<i1", "<u1", "<i2", "<u2", "<i4", "<u4", "<i8", "<u8", "<f4", "<f8")
#: Rows of a partition.
ROWS = 1_000_000
#: Tables and their columns, by the names of their arrays; the last are texts with offsets.
TABLES: dict[str, tuple[str, dict[str, str], str | None]] = {
    "nodes": ("node int, flags long, time double", {"flags": "nodes/flags", "time": "nodes/time"}, None),
    "edges": ("edge int, left double, right double, parent int, child int", {"left": "edges/left", "right": "edges/right", "parent": "edges/parent", "child": "edges/child"}, None),
    "sites": ("site int, position double, ancestral_state string", {"position": "sites/position"}, "sites/ancestral_state"),
    "mutations": ("mutation int, site int, node int, derived_state string", {"site": "mutations/site", "node": "mutations/node"}, "mutations/derived_state"),
}


@dataclass
class Rows(InputPartition):
    first: int
    last: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_directory(path: str) -> dict[str, tuple[str, int, int]]:
    """Type, place and length of each array of a file, by name."""
    system, name = _open(path)
    with system.open_input_file(name) as f:
        head = f.read(HEADER)
        if len(head) < HEADER or head[:8] != MAGIC:
            raise ValueError(f"{path} is no tree sequence file")
        major, _, items, size = struct.unpack("<HHIQ", head[8:24])
        if major != 1:
            raise ValueError(f"{path} has version {major} of the container; 1 is known")
        if HEADER + items * DESCRIPTOR > size or size != f.size():
            raise ValueError(f"{path} is cut short")
        out, table = {}, f.read(items * DESCRIPTOR)
        for k in range(items):
            kind, key_at, key_len, at, n = struct.unpack_from("<B7xQQQQ", table, k * DESCRIPTOR)
            if kind >= len(TYPES) or key_at + key_len > size or at + n * np.dtype(TYPES[kind]).itemsize > size:
                raise ValueError(f"{path} has a descriptor beyond its end")
            f.seek(key_at)
            out[f.read(key_len).decode()] = (TYPES[kind], at, n)
        return out


class TreesReader(DataSourceReader):
    def __init__(self, path: str, table: str, rows: int, schema: StructType):
        self.path, self.rows, self.arrow = path, rows, to_arrow_schema(schema)
        _, self.columns, self.text = TABLES[table]
        self.directory = read_directory(path)
        missing = [c for c in self.columns.values() if c not in self.directory]
        if missing:
            raise ValueError(f"{path} lacks {missing}")
        lengths = {self.directory[c][2] for c in self.columns.values()}
        if len(lengths) > 1:
            raise ValueError(f"columns of {table} differ in length")
        self.n = lengths.pop()

    def partitions(self) -> list[InputPartition]:
        return [Rows(at, min(self.n, at + self.rows)) for at in range(0, self.n, self.rows)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        system, name = _open(self.path)
        arrow = self.arrow
        with system.open_input_file(name) as f:

            def values(array: str, first: int, last: int) -> np.ndarray:
                kind, at, _ = self.directory[array]
                width = np.dtype(kind).itemsize
                f.seek(at + first * width)
                return np.frombuffer(f.read((last - first) * width), kind)

            first, last = partition.first, partition.last
            out = {arrow.names[0]: np.arange(first, last)} | {c: values(a, first, last) for c, a in self.columns.items()}
            if self.text:
                offsets = values(f"{self.text}_offset", first, last + 1) if last > first else np.zeros(1, np.int64)
                raw = values(self.text, int(offsets[0]), int(offsets[-1])).tobytes()
                ends = (offsets - offsets[0]).tolist()
                out[arrow.names[-1]] = [raw[a:b].decode() for a, b in zip(ends, ends[1:], strict=False)]
            columns = [pa.array(out[n], arrow.field(n).type) if isinstance(out[n], list) else pa.array(out[n]).cast(arrow.field(n).type) for n in arrow.names]
            yield from pa.Table.from_arrays(columns, schema=arrow).to_batches(65_536)


class TreesSource(DataSource):
    """Format "trees": options path, table (nodes, edges, sites or mutations) and rows (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "trees"

    def schema(self) -> str:
        return TABLES[self.options["table"]][0]

    def reader(self, schema: StructType) -> TreesReader:
        return TreesReader(self.options["path"], self.options["table"], int(self.options.get("rows", ROWS)), schema)


def read_trees(spark: SparkSession, path: str, table: str, rows: int = ROWS) -> DataFrame:
    """A table of a tree sequence file, in partitions of ``rows`` rows."""
    if table not in TABLES:
        raise ValueError(f"no table {table}; there are {list(TABLES)}")
    spark.dataSource.register(TreesSource)
    return spark.read.format("trees").option("path", path).option("table", table).option("rows", rows).load()


def sample_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes whose first flag is set."""
    return nodes.where(F.col("flags").bitwiseAND(F.lit(1)) == 1).select("node")


def placed_mutations(mutations: DataFrame, sites: DataFrame) -> DataFrame:
    """Mutations with their site's position and ancestral state. One whose site is not there is an error."""
    both = mutations.join(sites, "site", "left")
    known = F.assert_true(F.col("position").isNotNull(), F.concat(F.lit("no site for mutation "), F.col("mutation").cast("string")))
    return both.withColumn("_ok", known).where("_ok is null").select("site", "position", "ancestral_state", "mutation", "derived_state", "node")


def tree_tables(edges: DataFrame) -> dict[str, DataFrame]:
    """initial_edges, transitions, edges_out and edges_in of one tree sequence's edges: what changes from tree to tree.

    Transitions are numbered in parts, by ``ordering.numbered``; the first tree's number is 0. The state of all nodes in all trees is not written
    out: windows find it anew (``operators.bricks``).
    """
    from blockweave.operators.ordering import numbered

    points = edges.select(F.explode(F.array("left", "right")).alias("left")).distinct()
    last = points.agg(F.max("left").alias("end"))  # one row
    trees = numbered(points.join(F.broadcast(last)).where("left < end").drop("end"), ["left"], "transition").withColumn("transition", F.col("transition").cast("int"))
    begun = edges.join(trees, "left")
    ended = edges.join(trees.withColumnRenamed("left", "right"), "right")
    row = ("left", "right", "parent", "child")
    return {
        "initial_edges": begun.where("transition = 0").select(*row),
        "transitions": trees.where("transition > 0").select("transition", "left"),
        "edges_out": ended.where("transition > 0").select("transition", "child"),
        "edges_in": begun.where("transition > 0").select("transition", *row),
    }
