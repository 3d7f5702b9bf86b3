"""Session construction and the shared staging folder."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings every job relies on: zone-free timestamps, AQE for runtime
# re-planning (partition coalescing, sort-merge -> broadcast conversion with
# measured sizes, skew-join splitting), and no web UI.
_BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Profile for a large cluster (~1000 executors, ~100 TB of input).  Sizes
# are per task: a scan split of 512 MB, post-shuffle partitions of ~256 MB
# (AQE coalesces from a high initial count, it cannot split beyond it), a
# partition 5x the median and over 1 GB counts as skewed and is split.  The
# broadcast threshold stays small: only true dimensions qualify, and AQE
# re-checks it with measured sizes.  Executor loss: decommissioning migrates
# shuffle blocks off a leaving executor; otherwise the lost map outputs are
# recomputed from lineage, with enough retries to ride out several losses.
CLUSTER_CONF = {
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.shuffle.partitions": "16384",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "65536",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.sources.fileCompressionFactor": "3.0",
    "spark.decommission.enabled": "true",
    "spark.storage.decommission.enabled": "true",
    "spark.storage.decommission.shuffleBlocks.enabled": "true",
    "spark.task.maxFailures": "8",
    "spark.stage.maxConsecutiveAttempts": "8",
}


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "innsight",
    extra: dict[str, str] | None = None,
    profile: str = "local",
) -> SparkSession:
    """Create (or reuse) a session with the settings the queries assume.

    On a cluster, leave ``master`` as ``None`` so the launcher decides, and
    pass ``profile="cluster"`` for :data:`CLUSTER_CONF`.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_BASE_CONF)
    if profile == "cluster":
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", os.environ.get("INNSIGHT_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def staging_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints and staged tables.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint dir).  The library never invents a machine-local folder; a
    caller that has none (a unit test) must set one first.
    """
    d = spark.sparkContext.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        raise RuntimeError(
            "no shared staging folder: set spark.checkpoint.dir "
            "(or SparkContext.setCheckpointDir) to a folder all executors can reach"
        )
    return d.rstrip("/")
