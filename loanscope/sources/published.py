"""Published tables: whole versions behind a pointer, views and loan ids.

``publish`` writes a new version beside the current one and then commits it:
readers see the old table until the new one is complete, and a failing export
leaves the old one readable.  ``append_with_ids`` continues surrogate ids over
imports like an AUTO_INCREMENT column.  ``publish_views`` keeps catalog views
over the published loan table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanscope.operators.row_id import with_row_id
from loanscope.sources import commits
from loanscope.sources.store import cleaned


def publish(df: DataFrame, path: str, fmt: str = "parquet", keep: int = 2) -> str:
    """Write ``df`` as the new version of the table at ``path``; the folder of
    the version.  The last ``keep`` versions stay, for queries that still read
    them."""
    spark, root = df.sparkSession, path.rstrip("/")
    seen = commits.entries(spark, root)
    target = f"{root}/version-{uuid.uuid4().hex}"
    writer = df.write.option("header", True) if fmt == "csv" else df.write
    try:
        writer.format(fmt).save(target)
        commits.add(spark, root, len(seen), {"folder": target.rsplit("/", 1)[1], "format": fmt,
                                             "schema": df.schema.json()})
    except BaseException:
        commits.remove(spark, target)
        raise
    for old in seen[:len(seen) + 1 - keep]:
        commits.remove(spark, f"{root}/{old['folder']}")
    return target


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the current version, None if nothing is published."""
    seen = commits.entries(spark, path.rstrip("/"))
    return f"{path.rstrip('/')}/{seen[-1]['folder']}" if seen else None


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a published table."""
    seen = commits.entries(spark, path.rstrip("/"))
    if not seen:
        raise FileNotFoundError(f"nothing is published at {path}")
    last = seen[-1]
    reader = spark.read.schema(T.StructType.fromJson(json.loads(last["schema"])))
    if last["format"] == "csv":
        reader = reader.option("header", True)
    return reader.format(last["format"]).load(f"{path.rstrip('/')}/{last['folder']}")


def high_water_mark(spark: SparkSession, path: str) -> int:
    """The largest id given so far (0 at the start)."""
    seen = commits.entries(spark, path.rstrip("/"))
    return seen[-1]["top"] if seen else 0


def append_with_ids(new: DataFrame, path: str, order_cols, id_col: str = "loan_id") -> int:
    """Append ``new`` to the table at ``path`` with ids from the stored
    high-water mark on, in the order of ``order_cols``; the new mark.

    Only the new rows are read and numbered (``with_row_id``, no single
    partition); rows appended earlier keep their ids and their files.  Two
    appends at once do not both succeed: the later one raises
    ``ConcurrentCommit`` and leaves nothing behind.  Later batches may have
    more columns; they are null in earlier rows."""
    spark, root = new.sparkSession, path.rstrip("/")
    seen = commits.entries(spark, root)
    top = seen[-1]["top"] if seen else 0
    batch, work = f"{root}/batch-{uuid.uuid4().hex}", f"{root}/_work-{uuid.uuid4().hex}"
    try:
        numbered = with_row_id(new, order_cols, id_col, work_dir=work)
        rest = [c for c in new.columns if c != id_col]
        numbered.select((F.col(id_col) + F.lit(top)).alias(id_col), *rest).write.parquet(batch)
        ids = spark.read.parquet(batch)
        n = ids.count()  # from the files' footers
        commits.add(spark, root, len(seen), {"batch": batch.rsplit("/", 1)[1], "top": top + n, "rows": n,
                                             "schema": ids.schema.json()})
    except BaseException:
        commits.remove(spark, batch)
        raise
    finally:
        commits.remove(spark, work)
    return top + n


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """All rows appended at ``path``, in one scan."""
    root = path.rstrip("/")
    seen = commits.entries(spark, root)
    if not seen:
        raise FileNotFoundError(f"nothing was appended at {path}")
    fields: dict[str, T.StructField] = {}
    for e in seen:
        for f in T.StructType.fromJson(json.loads(e["schema"])).fields:
            fields.setdefault(f.name, f)
    return spark.read.schema(T.StructType(list(fields.values()))).parquet(*[f"{root}/{e['batch']}" for e in seen])


def publish_views(spark: SparkSession, root: str, df: DataFrame | None = None, database: str = "loanscope") -> None:
    """Catalog views ``loans`` and ``loans_clean`` in ``database`` over the loan
    table published at ``root``; with ``df`` that is published first.

    The views last as long as the catalog does (all sessions of an application;
    with a Hive metastore, all applications).  They read the version that was
    current when they were made: calling this again is the refresh, a query
    that runs meanwhile goes on with its version."""
    if df is not None:
        publish(df, root)
    folder = current(spark, root)
    if folder is None:
        raise FileNotFoundError(f"nothing is published at {root}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    table = spark.read.parquet(folder)
    for name, columns in (("loans", table.columns), ("loans_clean", cleaned(table).columns)):
        chosen = ", ".join(f"`{c}`" for c in columns)
        spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS SELECT {chosen} FROM parquet.`{folder}`")
