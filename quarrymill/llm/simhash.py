"""SimHash near-duplicates by anchor points.

A fingerprint has 64 bits. The anchors are the pairs of codewords of the binary Golay code of length 23 on bits
0-22 and 23-45; the code is perfect, with covering radius 3, so every fingerprint has exactly one home: the pair
of codewords within 3 bits of its parts. If two fingerprints differ in d bits, the second lies within 3 + d1 and
3 + d2 bits of the first one's home, d1 + d2 <= d. So fingerprints are replicated to all anchors within the radius
plus the threshold, shared between the parts, and those at an anchor are compared with those at home there. A
pair is met exactly once for each of its two homes, and one order of the pair is kept. For a threshold of 2 a
fingerprint has about 62 anchors of 2**24, whatever the size of the input.

Only distinct fingerprints are replicated and linked; copies share one. Links between different fingerprints are
at most 2,080 for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import fresh, map_arrow, stored, table
from quarrymill.llm.components import connected

SEED = 42
WIDTH = 3
RADIUS = 3
LENGTH = 23
#: x**11 + x**10 + x**6 + x**5 + x**4 + x**2 + 1 generates the Golay code.
GENERATOR = 0b110001110101
ROWS = 256


def _bits(hashes, half: float):
    """64 flags: in how many of the 64-bit hashes a bit is set, compared with half."""
    import numpy as np

    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 15):
        part = hashes[start : start + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts > half


def print_of(hashes) -> int:
    """The fingerprint of shingles with these hashes, as a signed 64-bit integer."""
    import numpy as np

    return int(np.packbits(_bits(hashes, len(hashes) / 2), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """SimHash of a text as a signed 64-bit integer; a text without words has 0."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = np.array([digest(joined, SEED)], np.dtype("<u8"))
    else:
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        ends = [*starts[width:], at]
        hashes = np.fromiter((digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends)), np.dtype("<u8"), len(ends))
    return print_of(hashes)


def _remainders(words):
    import numpy as np

    rest = words.astype(np.int64).copy()
    for bit in range(LENGTH - 1, 10, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - 11))
    return rest


class Anchors:
    """For a syndrome, the error patterns that lead to codewords within the radius and 1, 2, ... bits beyond."""

    def __init__(self, threshold: int):
        import numpy as np

        self.threshold, self.patterns, self.starts, self.counts = threshold, [], [], []
        for excess in range(threshold + 1):
            weights = range(RADIUS + 1) if excess == 0 else [RADIUS + excess]
            patterns = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(LENGTH), w)], np.int64)
            syndromes = _remainders(patterns)
            order = np.argsort(syndromes, kind="stable")
            self.patterns.append(patterns[order])
            self.counts.append(np.bincount(syndromes, minlength=1 << 11))
            self.starts.append(np.concatenate([[0], np.cumsum(self.counts[-1])[:-1]]))

    def of(self, prints):
        """(positions in prints, anchors): every anchor of every fingerprint, homes first."""
        import numpy as np

        parts = [(prints >> shift) & ((1 << LENGTH) - 1) for shift in (0, LENGTH)]
        syndromes = [_remainders(p) for p in parts]
        for first in range(self.threshold + 1):
            for second in range(self.threshold + 1 - first):
                n1, n2 = self.counts[first][syndromes[0]], self.counts[second][syndromes[1]]
                total = n1 * n2
                at = np.repeat(np.arange(len(prints)), total)
                k = np.arange(len(at)) - np.repeat(np.cumsum(total) - total, total)
                one = self.patterns[first][self.starts[first][syndromes[0][at]] + k // n2[at]]
                two = self.patterns[second][self.starts[second][syndromes[1][at]] + k % n2[at]]
                yield at, (parts[0][at] ^ one) | ((parts[1][at] ^ two) << LENGTH)


def anchored(prints: DataFrame, threshold: int) -> DataFrame:
    """anchor, fp: a row for each anchor within the covering radius plus threshold of each fingerprint."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        anchors = Anchors(threshold)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                fps = batch.slice(start, 4096).column(0).to_numpy(zero_copy_only=False)
                for at, anchor in anchors.of(fps):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64)), pa.array(fps[at])], ["anchor", "fp"])

    return map_arrow(prints.select("fp"), run, "anchor long, fp long")


def fingerprints(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fp (signed 64-bit). Null texts are empty; other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                made = pa.array([fingerprint(t, width) for t in part.column(1).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), made], ["doc_id", "fp"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def links(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) that differ in at most threshold bits."""
    home = anchored(prints, 0).select("anchor", F.col("fp").alias("a"))
    visitors = anchored(prints, threshold).select("anchor", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    # Both sides are estimated alike, from the size of prints, though a fingerprint has some 62 rows among the visitors: they are not to be broadcast.
    return home.join(visitors.hint("merge"), (home["anchor"] == visitors["anchor"]) & near).select("a", "b")


def near_duplicates(docs: DataFrame, threshold: int = 2, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id, links (fingerprints linked to its own).

    Documents of one fingerprint, and of fingerprints that chains of links join, are a component, named by its
    smallest doc_id. Null and empty texts have fingerprint 0 and are linked like others. Null ids name no
    component; a component of null ids has a null name. Repeated rows stay. An empty table gives no rows.
    """
    rows = stored(fingerprints(docs, width, id_col, text_col))
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    pairs = stored(links(prints, threshold))
    degrees = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b"))).groupBy("fp").agg(F.count(F.lit(1)).alias("links"))
    roots = connected(pairs).select(F.col("node").alias("fp"), "root")
    linked = roots.join(prints, "fp").join(degrees, "fp")
    names = linked.groupBy("root").agg(F.min("first_id").alias("name"))
    named = linked.join(names, "root").select("fp", "name", "links")
    classes = prints.join(named, "fp", "left").select(
        "fp", F.when(F.col("links").isNull(), F.col("first_id")).otherwise(F.col("name")).alias("component_id"), F.coalesce("links", F.lit(0)).alias("links")
    )
    # Both sides are plain tables: Spark can split the rows of a fingerprint that many documents share.
    return rows.join(stored(classes), "fp").select("doc_id", "fp", "component_id", "links")


def deduplicated(docs: DataFrame, threshold: int = 2, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id is not the smallest of its component; rows without id stay."""
    name = fresh(docs, "gone")
    gone = near_duplicates(docs, threshold, width, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[id_col] == gone[name], "left_anti")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")
