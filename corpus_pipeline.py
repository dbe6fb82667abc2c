"""Corpus pipeline: documents -> training sequences.

Five stages, each an operator of ``loanscope.llm`` on all rows its predecessor
kept; each result is written as Parquet and read again by the next stage.
The first four return the columns of ``documents``.

1. quality rules: documents they reject go;
2. exact dedup: of equal texts the smallest doc_id stays;
3. n-gram Jaccard join: of each class of near duplicates (5-word shingles,
   similarity 0.8 or more) the smallest doc_id stays;
4. suffix-array dedup: byte strings that also start earlier are cut out of
   the texts (no row goes, n_chars follows the text);
5. packing: pieces of token sequences.

Null texts count as empty (the quality rules reject them); a row with a null
doc_id is a document of its own that comes after all others and stays without
an id, down to its pieces; an empty table
passes through all stages; extra columns stay until the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loanscope.llm import exact_dedup, jaccard_join, packing, quality_rules, suffix_dedup
from loanscope.llm.tables import read_table, ship, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality_rules.kept_documents(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return exact_dedup.kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard_join.kept_documents(docs, shingle=5, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return suffix_dedup.deduplicated_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(docs, added_tokens=True, **packing.tokenizer())


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("suffix_array_dedup", substrings),
    ("packing", sequences),
]

#: SQL cannot express thresholds, suffix arrays or tokenisation;
#: tests/llm/test_plain.py compares the rows of every stage with a plain
#: version (packing: the pieces; of the sequences only that they are filled
#: without gaps up to their capacity).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
