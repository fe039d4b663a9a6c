"""Raw documents to token shards: quality rules, exact dedup, near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return
the columns of documents, and pass on others whatever their names. Between stages rows are stored in the folder that
the cluster shares. Null texts are empty in every stage; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm import bpe, exact_dedup, mixing, near_dedup, quality_rules
from quarrymill.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base checks or a certified rule go; labels come from sf_dir.

    Null and empty texts fail the base checks. Rows without doc_id are judged but teach nothing; a null lang is a
    stratum of its own. Repeated rows are judged alike. Without labels only the base checks reject.
    """
    return quality_rules.kept(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays, with rows that repeat that id; of texts without any id all stay."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by chains of similarity of 0.8 or more (shingles of five words), the one with the smallest doc_id stays.

    Candidates are fingerprints that operator 4 links and bands beside them; exact similarity decides. Rows without
    doc_id stay.
    """
    return near_dedup.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out, kept or doubled so that sources meet their target weights.

    A null source is a source. Reruns take the same rows: they are told apart by id and content, and rows alike in
    both are numbered. Documents without words stay once.
    """
    return mixing.mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document and the digests of a round trip; null and empty texts have no ids, repeated rows a row each."""
    return bpe.digests(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]
#: The dual of the mixing stage is solved by iteration, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
