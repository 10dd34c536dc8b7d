"""Connected components by repeated local contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.session import cut

#: Links that one forest takes in before it is sent on, which bounds a task's memory.
FOREST_LINKS = 1 << 20


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars that join what a task's links join: at most one link a node and FOREST_LINKS links read."""
    low: dict = {}
    read = 0

    def find(x):
        root = x
        while low[root] != root:
            root = low[root]
        while low[x] != root:
            low[x], x = root, low[x]
        return root

    def stars(schema: pa.Schema) -> pa.RecordBatch:
        joined = [(find(x), x) for x in low]
        joined = [j for j in joined if j[0] != j[1]]
        return pa.RecordBatch.from_arrays([pa.array([j[i] for j in joined], schema.field(i).type) for i in (0, 1)], schema=schema)

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            low.setdefault(a, a)
            low.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                low[max(a, b)] = min(a, b)
        read += batch.num_rows
        if read >= FOREST_LINKS:
            yield stars(schema)
            low.clear()
            read = 0
    if low:
        yield stars(schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every node of an undirected graph with the smallest node it can reach.

    Each task first joins what its own edges join and sends on stars.  Then every round each node moves to the
    smallest of its neighbours and itself, by value and by a round-specific hash in turn, and the graph is rewritten on
    those labels; under hashes the expected number of nodes falls by a constant factor, so rounds grow with the logarithm
    of the graph and later rounds are cheap.  A round groups and joins on nodes only: no neighbour list is collected,
    so a hub costs as many rows as it has edges.

    Edges with a null end are ignored; self loops keep their node as a component of one; repeated edges
    don't matter.  Returns ``node, component`` for nodes that occur in an edge; empty edges give an empty frame.
    """
    a, b = F.col(src), F.col(dst)
    given = cut(edges.where(a.isNotNull() & b.isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
    nodes = given.select(F.col("a").alias("node")).union(given.select("b")).distinct()
    kind = given.schema["a"].dataType.simpleString()
    # Each task first joins what its own links join, so that repeated and redundant links are gone before any shuffle.
    live = cut(given.where("a <> b").mapInArrow(_forest, f"a {kind}, b {kind}").distinct())
    steps: list[DataFrame] = []
    for round_no in range(max_rounds):
        if live.isEmpty():
            break
        # Forests are stars around small nodes, which every other round draws together; hashes shorten any other shape.
        order = (lambda c: c) if round_no % 2 == 0 else (lambda c: F.xxhash64(c, F.lit(round_no)))
        rank = lambda c: F.struct(order(c).alias("r"), c.alias("v"))
        both = live.union(live.select("b", "a"))
        moves = cut(
            both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("near"))
            .select("a", F.least(F.col("near"), rank(F.col("a")))["v"].alias("to"))
        )
        steps.append(moves)
        to_a = moves.select("a", F.col("to").alias("na"))
        to_b = moves.select(F.col("a").alias("b"), F.col("to").alias("nb"))
        live = cut(
            live.join(to_a, "a").join(to_b, "b").where("na <> nb")
            .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).mapInArrow(_forest, f"a {kind}, b {kind}").distinct()
        )
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Later rounds know fewer nodes: what a round's nodes finally reach is joined to it from the last round back.
    final = None
    for moves in reversed(steps):
        if final is None:
            final = moves.select("a", F.col("to").alias("rep"))
        else:
            after = final.select(F.col("a").alias("to"), F.col("rep").alias("then"))
            final = cut(moves.join(after, "to", "left").select("a", F.coalesce("then", "to").alias("rep")))
    if final is None:
        return nodes.select("node", F.col("node").alias("component"))
    labels = cut(nodes.join(final.select(F.col("a").alias("node"), "rep"), "node", "left").select("node", F.coalesce("rep", "node").alias("rep")))
    low = labels.groupBy("rep").agg(F.min("node").alias("component"))
    return labels.join(low, "rep").select("node", "component")
