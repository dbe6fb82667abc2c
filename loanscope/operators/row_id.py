"""Dense surrogate ids 1..N in key order, without a single partition.

``row_number().over(Window.orderBy(k))`` moves every row into one task
(``Exchange SinglePartition``).  Instead:

1. range-partition by the key and sort within partitions;
2. tag each row with its range partition and its position in it
   (``monotonically_increasing_id`` is ``partition_id << 33 | position``);
3. write that tagged frame once to the session's shared checkpoint folder.
   The ranges come from sampling and the positions from task order, so two
   recomputations need not agree; after the write both passes below read
   the same stored tags, and a lost executor only costs a re-read;
4. count rows per range partition - one row per partition, bounded by the
   partition count - and turn the counts into starting offsets with a
   window over those few rows;
5. broadcast the offsets (size bounded by the partition count) and add
   them to each row's position.

The range partition count is ``spark.sql.shuffle.partitions`` (size it to
the data, see ``session.scale_conf``); AQE merges ranges that are too
small.  Requires a unique key order (ties would make positions arbitrary).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanscope.session import require_shared_dir


def _free(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_row_id(df: DataFrame, order_cols, id_col: str = "row_id", num_partitions: int | None = None,
                work_dir: str | None = None) -> DataFrame:
    """Add ``id_col`` = 1..N in the order of ``order_cols`` (see the module
    notes); a column of that name is replaced, all others stay as they are.
    The tagged rows are written to ``work_dir``, by default a new folder in the
    session's shared one; whoever names a folder may remove it when the result
    is no longer read."""
    spark = df.sparkSession
    path = work_dir or f"{require_shared_dir(spark).rstrip('/')}/loanscope-rowid-{uuid.uuid4().hex}"
    cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    pid, pos, off = (_free(df, n) for n in ("_pid", "_pos", "_off"))
    # Without an explicit count the range exchange uses the session's shuffle
    # partitions and AQE may merge neighbouring ranges; merged ranges stay in
    # key order, so the tags below remain globally ordered.
    ranged = df.repartitionByRange(num_partitions, *cols) if num_partitions else df.repartitionByRange(*cols)
    (
        ranged
        .sortWithinPartitions(*cols)
        .withColumn(pid, F.spark_partition_id())
        .withColumn(pos, F.monotonically_increasing_id() - F.shiftleft(F.col(pid).cast("bigint"), 33))
        .write.parquet(path)
    )
    tagged = spark.read.parquet(path)
    counts = tagged.groupBy(pid).agg(F.count(F.lit(1)).alias(off))
    offsets = counts.select(
        pid,
        F.coalesce(
            F.sum(off).over(Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0).cast("bigint"),
        ).alias(off),
    )
    # one row per range partition: bounded by n
    out = tagged.join(F.broadcast(offsets), pid)
    return out.withColumn(id_col, F.col(off) + F.col(pos) + 1).drop(pid, pos, off)
