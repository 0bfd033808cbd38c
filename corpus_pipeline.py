"""From documents to packed training sequences: classifier, rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes and reads again as the next
stage's documents. All but the last return the rows that they keep as they came, with all their columns, whatever names those have.

Defined results: an empty table passes as an empty one. Texts that are null or empty have measures of 0, fail the rules (few words), are
in no group of near-duplicates and are the end token alone when packed. Rows without an id and repeated rows are judged row by row; of
repeated rows of one group the near-duplicate stage keeps one, and rows without an id all stay there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import cotrain, neardup, packing, rules
from loomgraph.llm.common import bounded_batches, only, stage, table
from loomgraph.llm.queries import WORDS


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return cotrain.keep_good(docs, cotrain.train(only(docs, *[c for c in ("doc_id", "text", "source", "lang") if c in docs.columns]), table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy of the rule ledger."""
    return rules.keep_passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component; rows without an id or without words are in none and stay."""
    bounded_batches(spark)
    return neardup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of up to 4096 tokens."""
    bounded_batches(spark)
    return packing.pack(only(docs, "doc_id", "text"), WORDS, with_ids=False)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("packing", pack)]
#: The classifier and the packing have no SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
