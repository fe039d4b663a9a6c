"""Order-stable near-duplicate removal.

A document is kept if no kept document before it is similar. That is the first maximal independent set in order
of ids. Rounds decide all documents at once that can be decided: one is kept when none of its smaller neighbours
is undecided or kept, and removed when one is kept. The number of rounds is that of the longest chain of such
decisions, not of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.similarity import document_pairs, grouped
from quarrymill.plans.storage import cut


def removed(pairs: DataFrame) -> DataFrame:
    """id: nodes that the scan in order of ids removes. pairs: a, b of undirected edges."""
    edges = cut(pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo <> hi").distinct())
    gone = None
    while not edges.isEmpty():
        # Ends of remaining edges without a smaller end among them are kept; their larger ends go.
        waiting = edges.select(F.col("hi").alias("id")).distinct()
        out = cut(edges.join(waiting, edges["lo"] == waiting["id"], "left_anti").select(F.col("hi").alias("id")).distinct())
        gone = out if gone is None else gone.union(out)
        edges = edges.join(out, edges["hi"] == out["id"], "left_anti")
        edges = cut(edges.join(out, edges["lo"] == out["id"], "left_anti"))
    return gone if gone is not None else edges.select(F.col("hi").alias("id"))


def deduplicated(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.9) -> DataFrame:
    """docs without near-duplicates of documents before them. Documents without tokens stay; of equal bags the smallest id stands for all."""
    groups = grouped(docs, id_col, text_col)
    pairs = document_pairs(docs, id_col, text_col, "jaccard", threshold, groups)
    gone = removed(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))).select(F.col("id").alias("__rep"))
    copies = groups.where("id <> rep").select(F.col("id").alias("__gone"))
    return docs.join(copies.union(gone), docs[id_col] == F.col("__gone"), "left_anti")
