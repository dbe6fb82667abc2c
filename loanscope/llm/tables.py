"""Reading input tables and writing intermediates to the shared folder."""

from __future__ import annotations

import tempfile
import threading
import time
import uuid
import zipfile
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.operators.row_id import with_row_id
from loanscope.session import require_shared_dir
from loanscope.sources.commits import remove


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark (any path Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_open = threading.local()
RELEASE_S = 3.0
_released = 0.0


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps.  It does so when the
    driver's collector finds their plans unreachable, by itself every 30 minutes
    (``spark.cleaner.periodicGC.interval``, fixed when the session starts); until
    then they fill the executors' disks.  At most once in ``RELEASE_S`` seconds."""
    global _released
    if time.monotonic() - _released > RELEASE_S:
        spark.sparkContext._jvm.System.gc()
        _released = time.monotonic()


@contextmanager
def scratch(spark: SparkSession):
    """Tables ``written`` inside are removed at the end, but for those written
    with ``keep``.  Only for steps whose results are written inside: nothing may
    read the removed tables any more, not even to make up for a lost executor."""
    outer = getattr(_open, "paths", None)
    _open.paths = paths = []
    try:
        yield
    finally:
        _open.paths = outer
        for path in paths:
            remove(spark, path)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the folder in ``spark.checkpoint.dir`` and return
    the stored copy: later steps read files that every executor sees, so a
    lost executor costs a re-read and never a different recomputation."""
    spark = df.sparkSession
    path = f"{require_shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    if not keep and getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(schema).parquet(path)


def with_columns_free(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator needs, under fixed names: an input may
    carry any other columns, also with names the operator uses inside."""
    return df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


SLOTS = 1 << 23


def possibly(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose doc_id may be among the doc_ids of
    ``ids``, and those whose doc_id surely is not.  Tasks are told which of
    ``SLOTS`` hash slots are taken, 64 to a row (1 MB of bits however many ids
    there are), so only the first part has to move to be joined with ``ids``;
    with very many ids that is nearly all."""
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(SLOTS))
    word, bits = free_name(rows, "_word"), free_name(rows, "_bits")
    words = ids.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias(word)).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 AS int))")).alias(bits))
    marked = rows.withColumn(word, F.floor(slot / 64)).join(F.broadcast(words), word, "left")
    hit = F.coalesce(F.getbit(bits, (slot % 64).cast("int")), F.lit(0)) == 1
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return marked.filter(hit).select(*columns), marked.filter(~hit).select(*columns)


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is one of ``ids`` (doc_id)."""
    return possibly(rows, ids)[0].join(ids.select("doc_id"), "doc_id", "left_semi")


def without(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows whose doc_id no row of ``judged`` (doc_id, kept) drops, all
    columns; a doc_id stays if one of its rows does.  The texts of the others
    are the few that move."""
    dropped = written(judged.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter("NOT kept").select("doc_id"),
                      "dropped", keep=True)
    maybe, surely = possibly(rows, dropped)
    gone = dropped.toDF(free_name(rows, "_gone"))
    return surely.unionByName(maybe.join(gone, maybe["doc_id"] == gone[gone.columns[0]], "left_anti"))


def with_null_ids(docs: DataFrame, stage: Callable[[DataFrame], DataFrame],
                  others: DataFrame | None = None, ids: tuple = ("doc_id",)) -> DataFrame:
    """``stage(docs)``, where a row with a null doc_id is a document of its own:
    the stage sees it under an id above all doc_ids (those of ``others`` too), in
    the order of the text's SHA-256 and the other columns; in the columns ``ids``
    of the result such an id is null again."""
    top, nulls = docs.agg(F.max("doc_id").cast("bigint"), F.count_if(F.col("doc_id").isNull())).first()
    if not nulls:
        return stage(docs)
    tops = [top, others.agg(F.max("doc_id").cast("bigint")).first()[0] if others is not None else None]
    least = max([t for t in tops if t is not None], default=-1) + 1
    kind = docs.schema["doc_id"].dataType
    rest = [F.col(f"`{c}`") for c, t in docs.dtypes if c not in ("doc_id", "text") and "map<" not in t]
    row = free_name(docs, "_row")
    nameless = with_row_id(docs.filter(F.col("doc_id").isNull()), [F.sha2("text", 256), *rest], row)
    nameless = nameless.withColumn("doc_id", F.col(row) + F.lit(least - 1)).select(*[f"`{c}`" for c in docs.columns])
    named = docs.filter(F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    out = stage(named.unionByName(nameless))
    return out.withColumns({c: F.when(F.col(c) < least, F.col(c)).cast(kind) for c in ids})


BATCH = "4m"
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the session's Python workers this package (once per application),
    so that tasks can import it wherever they run.  Where the session has not
    chosen a size, batches between the JVM and Python get one of ``BATCH``: the
    default of 64 MB is held several times over in every task."""
    if spark.conf.get(_BATCH_CONF, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_CONF, BATCH)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="loanscope-code-")) / "loanscope_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
