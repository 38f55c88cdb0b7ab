"""A corpus from raw documents to packed sequences, in stages that each write a table.

Quality rules reject junk; of each SimHash group one document stays; repeated passages lose all but
their first occurrence; what is left is packed into sequences whose source proportions hold. Every
stage reads all that its predecessor kept; all but the last return the columns of `documents`, whatever
other columns those are. Texts of any length are read whole.

Nulls, ties and repeats in each stage are as its operator's module defines them: quality rules reject
null, blank and short texts; of repeated rows near-dedup keeps one, and rows without a doc_id all stay;
substring dedup leaves rows without a doc_id whole, and a text that loses all its words is the empty
text; packing gives such a text the end id alone. An empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from granary.llm._shared import stored
from granary.llm.packing import pack
from granary.llm.quality_rules import keep_good
from granary.llm.simhash import keep_one
from granary.llm.word_dedup import drop_repeated_words


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and every threshold."""
    return keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of linked fingerprints."""
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 20-word passages that an earlier document, or their own beginning, has."""
    out = drop_repeated_words(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

#: Fingerprints and byte-pair merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of `sf_dir`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
