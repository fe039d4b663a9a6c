"""Near-duplicate documents: SimHash links and MinHash bands give candidates, exact similarity decides. For the pipeline.

A document's set is its shingles of WIDTH words, A-Z lower-cased (a shorter text is its one shingle, a text without
words the empty one). Documents are linked if the exact Jaccard similarity of their sets is 0.8 or more.

Candidates come from operator 4 first: fingerprints of these shingles that anchors link at 2 or fewer bits, in groups
joined by chains of such links. Fingerprints alone can't reach a similarity of 0.8: there two of them differ in 9.7
of 64 bits on average (the angle of vectors that share 8 / 9 of their shingles), and no covering code has a radius
that large and anchors few enough to compare at. So documents that agree on one of 12 bands of 4 values of a MinHash
signature are candidates too; a pair of similarity 0.8 is one with probability 0.998, one of 0.9 practically always.
Buckets, dealing of large ones and verification are those of `line_dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm import simhash
from quarrymill.llm.common import fresh, map_arrow, released, stored
from quarrymill.llm.components import connected
from quarrymill.llm.line_dedup import SIMILARITY, banded, candidates, told_apart, verified

WIDTH = 5
ROWS = 64
BITS = 2


def shingles(text: str | None):
    """Hashes of the shingles of a text, repeats included; a text without words has the one of the empty shingle."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [*starts[WIDTH:], at] if len(words) > WIDTH else [at]
    return np.fromiter((digest(joined[s : max(e - 1, 0)], simhash.SEED) for s, e in zip(starts or [0], ends)), np.dtype("<u8"), len(ends))


def shingle_sets(texts: list[str | None]) -> list:
    import numpy as np

    return [np.unique(shingles(t)) for t in texts]


def _signed(rows: DataFrame) -> DataFrame:
    """doc_id, line_no, line_id, proof, fp, bands. rows: these but the last two, and line."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                hashes = [shingles(t) for t in part.column(4).to_pylist()]
                prints = pa.array([simhash.print_of(h) for h in hashes], pa.int64())
                sets = [np.unique(h) for h in hashes]
                made = banded(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], prints, pa.array([m.tobytes() for m in made], pa.binary())], ["doc_id", "line_no", "line_id", "proof", "fp", "bands"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, line_no int, line_id long, proof long, fp long, bands binary")


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id is not the smallest of its component; rows without id stay.

    Components are documents joined by chains of similarity of at least similarity. Null texts are empty, equal
    texts are one; a component of null ids loses nothing. Rows that repeat the smallest id stay with it. No rows
    give no rows; other columns, whatever their names, are passed on.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lit(0).alias("line_no"), F.xxhash64(text).alias("line_id"), F.xxhash64(F.lit(1), text).alias("proof"), text.alias("line"))
    rows, each = told_apart(rows, _signed, F.min("doc_id").alias("first"), F.first("fp").alias("fp"))
    chains = connected(simhash.links(each.select("fp").distinct(), BITS)).select(F.col("node").alias("fp"), "root")
    groups = each.select("fp", "line_id").join(chains, "fp", "left").select(F.xxhash64(F.lit("fingerprint"), F.coalesce("root", "fp")).alias("bucket"), "line_id")
    members = stored(candidates(each, groups))
    released(docs.sparkSession)
    texts = rows.groupBy("line_id").agg(F.first("line").alias("line")).join(members.select("line_id").distinct(), "line_id", "left_semi")
    roots = connected(verified(members, texts, similarity, shingle_sets))
    linked = each.join(roots, each["line_id"] == roots["node"]).select("line_id", "root", "first")
    named = linked.join(linked.groupBy("root").agg(F.min("first").alias("class")), "root").select("line_id", "class")
    classes = stored(each.join(named, "line_id", "left").select("line_id", F.coalesce("class", "first").alias("class")))
    gone = fresh(docs, "gone")
    out = rows.join(classes, "line_id").where("doc_id <> class").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(out, docs[id_col] == out[gone], "left_anti")
