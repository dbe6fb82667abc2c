"""Exact dedup (operator 7): skew-safe combining on full content.

Two texts are equal when they are identical after every run of ASCII white
space has become one space.  The work is native DataFrame code:

1. One scan computes the SHA-256 of the normalised text.  Rows whose digest
   occurs once have no equal row; they are done.  (The digest count is a
   partial aggregate, so a digest held by a third of the rows costs one row
   per task.)
2. For the rest the content itself is part of the grouping key, never the
   digest alone, at every stage:
   a. copies are combined inside each task (the partial aggregate),
   b. groups of (digest, content, salt) are merged; the salt spreads a hot
      digest over ``SALTS`` tasks,
   c. the salt winners of a digest and content are merged globally.
3. Each of those rows finds its group by digest and content.

Null text counts as empty, and empty texts are equal to each other.  Ties
cannot arise: doc_id orders the copies; rows that repeat a doc_id are counted
as rows and all marked kept when theirs is the smallest id.  A row with a null
doc_id comes after all that have one: if its group has no doc_id, one of its
rows is kept and the keep_id of all is null.  An empty table
gives an empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.llm.tables import possibly, read_table, scratch, with_columns_free, with_null_ids, without, written

# Tasks over which the rows of one digest are spread in the first merge.
SALTS = 32


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def duplicate_groups(members: DataFrame, salts: int = SALTS) -> DataFrame:
    """Groups of equal content: text_sha256, content, keep_id, group_size.
    ``members`` has doc_id, text_sha256 and content."""
    salted = (
        members.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("text_sha256", "content", "salt")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    return salted.groupBy("text_sha256", "content").agg(
        F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256
    (see the module notes for nulls, ties, repeated rows and empty input)."""
    return with_null_ids(with_columns_free(docs, id_col, text_col), lambda rows: _exact_dedup(rows, salts),
                         ids=("doc_id", "keep_id"))


def _exact_dedup(rows: DataFrame, salts: int) -> DataFrame:
    content = normalised(F.col("text"))
    digests = written(rows.select("doc_id", F.sha2(content, 256).alias("text_sha256")), "digests")
    repeated = digests.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("text_sha256")
    again = written(digests.join(repeated.withColumn("again", F.lit(True)), "text_sha256", "left"), "again")
    singles = again.filter("again IS NULL").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "text_sha256"
    )
    # only these texts move
    found, _ = possibly(rows, again.filter("again"))
    members = written(
        found.select("doc_id", content.alias("content"))
        .withColumn("text_sha256", F.sha2("content", 256))
        .join(repeated, "text_sha256", "left_semi"),
        "members",
    )
    copies = members.join(duplicate_groups(members, salts), ["text_sha256", "content"]).select(
        "doc_id", "keep_id", "group_size", "text_sha256"
    )
    return singles.unionByName(copies).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256"
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, all columns unchanged.  A
    row with a null doc_id comes after all that have one: it stays if no other
    text equals its own, and of equal texts without any doc_id one stays."""
    def kept(docs: DataFrame) -> DataFrame:
        with scratch(docs.sparkSession):
            return without(docs, exact_dedup(docs).select("doc_id", "kept"))

    return with_null_ids(docs, kept)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY content) AS keep_id,
       count(*) OVER (PARTITION BY content) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY content) AS kept,
       sha256(content) AS text_sha256
FROM d
"""

QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLE = {"op7_exact_dedup": SQL}
