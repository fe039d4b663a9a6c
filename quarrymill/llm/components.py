"""Connected components of a graph given by its edges: union-find in two scales.

Each partition first runs union-find over its own edges, which leaves at most one edge per node and partition.
Then large-star and small-star rounds join the parts until nothing changes; each round is a few joins over edges
and a stored table, so that a lost executor costs one round at most. A node of many edges is aggregated partially
and its joins may be split, as the other side has one row per node.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import map_arrow, stored


def _local_forest(batches: Iterator) -> Iterator:
    import pyarrow as pa

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, find(x)) for x in list(parent)]
    pairs = [(x, y) for x, y in pairs if x != y]
    for start in range(0, len(pairs), 50_000):
        part = pairs[start : start + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([y for _, y in part], pa.int64())], ["a", "b"])


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row per node of any edge: node, root (the smallest node of its component). Nodes are integers.

    Loops, repeated edges, both directions and edges with a null end add nothing; no edges give no rows.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    pairs = stored(map_arrow(pairs, _local_forest, "a long, b long"))
    before = None
    while True:
        mark = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark[0] == 0 or tuple(mark) == before:
            break
        before = tuple(mark)
        both = pairs.select("a", "b").union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large.where("a <> b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("a"), F.col("m").alias("b")).union(joined.select(F.col("b").alias("a"), F.col("m").alias("b")))
        pairs = stored(small.where("a <> b").distinct())
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select(F.col("b"), F.col("b")).distinct())
