"""Reports kept current while loan files keep arriving.

The loan table only grows (new loans issued, new monthly snapshots), and
every measure of the group reports is additive.  So a report can run as
a Structured Streaming query over the loan folder: Spark keeps the
partial sums per group in its state store and each micro-batch folds the
new files in, instead of re-reading the whole table.

* ``aggregate`` reports (money by year/term/grade/state, P&L slices) are a
  streaming ``groupBy().agg()`` in complete mode: the same functions as the
  batch reports, since they only use groupBy/agg/withColumn.
* ``share`` reports need a window over the aggregated groups; streaming
  does not run non-time windows, so the query keeps the finest-grain counts
  as state and each micro-batch applies the window to that (small, static)
  batch in ``foreachBatch`` before writing it.
* the cleaning job itself (``start_cleaning``) is stateless per row: new
  raw loan files get their derived columns and are appended to the cleaned
  table, exactly once per file (file source + Parquet sink + checkpoint).

State and progress live under the session's shared checkpoint folder, so a
restarted driver resumes where it stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loanscope.functions.arith import pct
from loanscope.session import require_shared_dir


def loan_stream(spark: SparkSession, folder: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """Streaming DataFrame over a folder of loan Parquet files."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)


def _checkpoint(spark: SparkSession, name: str, checkpoint: str | None) -> str:
    return checkpoint or f"{require_shared_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"


def start_aggregate(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    report: Callable[[DataFrame], DataFrame],
    sink: Callable[[DataFrame, int], None],
    name: str = "report",
    checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Run an additive report (e.g. ``portfolio.money_by``-based) over the
    growing folder; ``sink(batch_df, batch_id)`` receives the full current
    result after every micro-batch."""
    result = report(loan_stream(spark, folder, schema))
    w = (
        result.writeStream.outputMode("complete")
        .foreachBatch(sink)
        .option("checkpointLocation", _checkpoint(spark, name, checkpoint))
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def start_cleaning(
    spark: SparkSession,
    raw_folder: str,
    raw_schema: StructType,
    out_folder: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Append newly arrived raw loan files, with the cleaning job's derived
    columns, to the Parquet table at ``out_folder``.

    ``checkpoint`` belongs to ``out_folder`` and must be given again on every
    restart: the sink skips batch numbers it has already committed, so a new
    checkpoint over an old table would lose files."""
    from loanscope.operators.cleaning import with_derived

    cleaned = with_derived(loan_stream(spark, raw_folder, raw_schema))
    w = (
        cleaned.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out_folder)
        .option("checkpointLocation", checkpoint)
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def start_share(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    group: list,
    sub: list,
    sink: Callable[[DataFrame, int], None],
    name: str = "share",
    checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Share of ``sub`` inside ``group``, kept current: streaming counts at
    (group, sub) in state, the window applied per micro-batch."""
    counts = loan_stream(spark, folder, schema).groupBy(*group, *sub).agg(F.count(F.lit(1)).alias("_rows"))

    def apply(batch: DataFrame, batch_id: int) -> None:
        # ``batch`` is the current state: one row per (group, sub)
        sink(share_from_counts(batch, group, sub), batch_id)

    w = (
        counts.writeStream.outputMode("complete")
        .foreachBatch(apply)
        .option("checkpointLocation", _checkpoint(spark, name, checkpoint))
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def share_from_counts(counts: DataFrame, group: list, sub: list) -> DataFrame:
    """``operators.shares.share_of`` over pre-aggregated ``_rows`` counts."""
    w = Window.partitionBy(*group) if group else Window.partitionBy()
    return counts.select(
        *group, *sub,
        F.col("_rows").alias("number_of_loans"),
        F.sum("_rows").over(w).alias("total_loans"),
    ).withColumn("percentage", pct("number_of_loans", "total_loans"))

