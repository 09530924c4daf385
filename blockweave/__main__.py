"""Command line: ``python -m blockweave reduce <tree sequence> <path threshold> <output folder>``.

The tree sequence is a .trees file, or a folder of the Parquet tables initial_edges, transitions, edges_out, edges_in, node_state, sample_nodes
and mutations; the output is a weighted edge list (from, to, weight) as CSV.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from blockweave.operators import graphs
from blockweave.sources import trees


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="blockweave")
    reduce = parser.add_subparsers(dest="command", required=True).add_parser("reduce")
    reduce.add_argument("folder")
    reduce.add_argument("path_threshold", type=float)
    reduce.add_argument("output")
    reduce.add_argument("--edge-threshold", type=float)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("blockweave").getOrCreate()
    table = lambda name: spark.read.parquet(f"{given.folder}/{name}")
    if given.folder.endswith(".trees"):
        nodes = trees.read_trees(spark, given.folder, "nodes")
        mutations = trees.placed_mutations(trees.read_trees(spark, given.folder, "mutations"), trees.read_trees(spark, given.folder, "sites"))
        edges, _ = graphs.graph_from_tree_sequence(trees.read_trees(spark, given.folder, "edges"), nodes, trees.sample_nodes(nodes), mutations, given.path_threshold, given.edge_threshold)
    else:
        samples = table("sample_nodes")
        rows = graphs.tree_rows("all", spark, *[table(n) for n in ("initial_edges", "transitions", "edges_out", "edges_in", "node_state")], samples.count())
        edges, _ = graphs.graph_from_trees(rows, samples, table("mutations"), given.path_threshold, given.edge_threshold)
    graphs.round_weights(edges).orderBy("from", "to").write.csv(given.output)


if __name__ == "__main__":
    main()
