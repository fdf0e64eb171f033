"""Session construction and the shared scratch folder.

Queries that write (sinks) need a folder every executor can reach.  On a
cluster that is the folder named by ``spark.checkpoint.dir``; we read it from
the session and only fall back to a fresh local folder (and register it as
the checkpoint folder) when it is unset, which happens in local tests.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_SCRATCH_SUBDIR = "tableflow-scratch"


def build_session(
    master: str = "local[*]",
    shuffle_partitions: int = 8,
    app_name: str = "tableflow",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with the settings the operators are designed around.

    AQE re-plans joins from runtime sizes (broadcast only when the measured
    side is under ``autoBroadcastJoinThreshold``) and splits skewed shuffle
    partitions of sort-merge joins; ``shuffle_partitions`` should be sized so
    one partition is ~128-256 MB at the target scale.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        # Broadcast is decided by a size check: a side estimated under the
        # threshold is broadcast, anything larger stays a sort-merge join.
        # Parquet decompresses to several times its file size, so count it
        # three-fold when estimating.
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        .config("spark.sql.sources.fileCompressionFactor", "3.0")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(input_bytes: int, total_cores: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a cluster run, sized from the input volume.

    Shuffle partitions start at ``input_bytes / partition_bytes`` (at least
    3 per core) so no reducer holds more than ~``partition_bytes`` before
    AQE coalesces small ones back to the advisory size.  A skewed partition
    is one over 4x the advisory size (and 5x the median); AQE splits it.
    Pass the result as ``build_session(..., extra=cluster_conf(...))``.
    """
    partitions = max(3 * total_cores, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }


def shared_dir(spark: SparkSession) -> str:
    """Base folder shared by driver and executors.

    ``spark.checkpoint.dir`` when the cluster names one; otherwise the folder
    already registered with ``setCheckpointDir``; otherwise a new local folder
    that is registered as the checkpoint folder (local mode only; a cluster
    without a shared folder is refused).
    """
    conf_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir.rstrip("/")
    registered = spark.sparkContext.getCheckpointDir()
    if registered:
        return registered.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="tableflow-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, never reused folder under the shared folder (the name is
    reduced to characters that are not path globs)."""
    safe = re.sub(r"[^A-Za-z0-9_.-]+", "-", name)
    return f"{shared_dir(spark)}/{_SCRATCH_SUBDIR}/{safe}-{uuid.uuid4().hex}"
