"""The corpus pipeline: language ID, line dedup, near-duplicate removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept, with the columns of documents. run() writes
each stage's rows as Parquet in the shared folder and gives the next stage what it reads back. The last stage returns
pieces of packed sequences. Nulls, repeated rows and empty tables: as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrakiln.llm import langid, line_dedup, mixing, near_dups, packing
from terrakiln.llm.common import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that no language's dictionary fits clearly better than the others."""
    return langid.keep_identified(docs, docs.select("doc_id", "text", "lang"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each repeated line stays in the first document that holds it; n_chars follows the text."""
    return line_dedup.with_length(line_dedup.dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dups.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("near_dups", near_duplicates), ("mixing", mix_sources), ("packing", pack)]

#: Four of the stages have no SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
