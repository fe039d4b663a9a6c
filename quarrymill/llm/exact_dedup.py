"""Exact deduplication of texts.

Rows are grouped by a 128-bit digest of the normalised text together with the text itself, so bytes decide and
the digest only makes the grouping cheap: Spark compares digests first and texts when these are equal. Partial
aggregation leaves each map task one row per distinct text, however many copies it holds, so a group of copies
never meets in one task. The second pass moves ids and digests, no texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import SPACES, table


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per class of equal texts: digest, text_sha256, keep_id, group_size."""
    body = normalised(F.col(text_col))
    return (
        docs.select(F.col(id_col).alias("id"), body.alias("body"))
        .groupBy(F.unhex(F.md5("body")).alias("digest"), "body")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal to each other. The smallest non-null id of a class stays; in a class without
    ids keep_id is null and all its rows stay, as nothing tells them apart. Rows that repeat the keeper's id are
    the keeper and stay too. Other columns, whatever their names, are ignored. An empty table gives no rows.
    Classes were told apart by bytes; a row finds its class by digest and SHA-256 together.
    """
    body = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), body.alias("body")).select(
        "doc_id", F.unhex(F.md5("body")).alias("digest"), F.sha2("body", 256).alias("text_sha256")
    )
    return rows.join(classes(docs, id_col, text_col), ["digest", "text_sha256"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names."""
    body = normalised(F.col(text_col))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.unhex(F.md5(body)).alias("d"), F.sha2(body, 256).alias("s"))
    keepers = classes(docs, id_col, text_col)
    same = (F.col("d") == F.col("digest")) & (F.col("s") == F.col("text_sha256")) & F.col("id").eqNullSafe(F.col("keep_id"))
    return rows.join(keepers, same, "left_semi").select("row.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g') AS body FROM documents),
c AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, c.keep_id, c.group_size, d.doc_id IS NOT DISTINCT FROM c.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN c USING (body)
"""
