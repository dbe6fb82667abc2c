"""Session helpers: a local session for tests/bench, and the shared folder
for materialised intermediates.

On a cluster the shared folder is the one named by ``spark.checkpoint.dir``
(or set with ``SparkContext.setCheckpointDir``).  Only a local session
without one gets a private temporary folder; a cluster session without one
gets no folder and callers fall back to fully lazy plans.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int = 8, shuffle_partitions: int | None = None, app: str = "loanscope") -> SparkSession:
    """Session for tests and the bench (local mode, UI off, AQE on)."""
    parts = shuffle_partitions or cores
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return (spark.conf.get("spark.master", "") or "").startswith("local")


def app_id(spark: SparkSession) -> str:
    """Identifier of the session's application."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # a remote (Spark Connect) session has no SparkContext
        return spark.conf.get("spark.app.id", "remote")


def shared_dir(spark: SparkSession) -> str | None:
    """The session's checkpoint folder (unique per application), or None.

    Reads the session's setting; sets a private one only for a local
    session that has none.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # remote session: only the configured folder is known
        return conf_dir
    d = sc.getCheckpointDir()
    if d:
        return d
    conf_dir = conf_dir or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if _is_local(spark):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loanscope-ckpt-"))
        return sc.getCheckpointDir()
    return None


def require_shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, or an error asking for
    spark.checkpoint.dir."""
    d = shared_dir(spark)
    if d is None:
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder shared by all executors"
        )
    return d


def scale_conf(shuffle_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Shuffle and scan settings sized to the data, for a cluster session.

    ``shuffle_bytes`` is the largest shuffle of the job (for the cleaning
    job: the order rows plus one partial-sum row per order).  Partitions
    start at about ``target_partition_bytes`` each and never below twice
    the core count; AQE then coalesces small ones and splits skewed ones.
    """
    parts = max(2 * total_cores, -(-shuffle_bytes // target_partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
    }
