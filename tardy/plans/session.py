"""Session construction with the settings the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for the plans this library builds:
# - AQE re-plans joins/partition counts from real shuffle sizes,
# - skew-join splitting keeps a hot key (a third of all rows) off one task,
# - ANSI stays on; the library uses try_cast / try_to_date / try_divide.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Cluster-only launch settings.  Fused stages over wide plans generate
# methods above HotSpot's 8 KB JIT limit; without this flag they run
# interpreted.  Measured on the six-join enrichment stage at sf0.1 with the
# stage repeated: 6.6 s -> 2.7 s.  For single short queries on small data the
# extra compile time eats the gain (alternating local A/B runs of the bench
# set were within noise), so it is applied only off local mode, where tasks
# run long over 128 MB+ splits.
CLUSTER_CONF = {
    "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    # splits and post-shuffle partitions of ~256 MB: few enough tasks for a
    # 100 TB scan (~400k splits), small enough to stay in executor memory;
    # AQE coalesces the (deliberately high) shuffle partition count down to
    # this size per stage and splits skewed partitions above 5x the median
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
}

# Shuffle partitions on a cluster: total shuffled bytes of the largest stage
# / 256 MB (about 20k for a full pass over 100 TB of trips before partial
# aggregation shrinks it); AQE coalesces smaller stages automatically.
CLUSTER_SHUFFLE_PARTITIONS = 20000


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None,
                  app_name: str = "tardy", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    local = master.startswith("local")
    if not local:
        conf.update(CLUSTER_CONF)
    if shuffle_partitions is None:
        shuffle_partitions = 8 if local else CLUSTER_SHUFFLE_PARTITIONS
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


# Runtime SQL settings the plans rely on; applied to any session handed to
# the library (a caller's own session included).
RUNTIME_SQL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in RUNTIME_SQL_CONF.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names reliable shared storage and is always
    honoured.  Only when it is unset *and* the master is local (tests,
    benchmarks on one machine) a scratch folder is created.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: no context; use the setting
        if configured:
            return configured
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="tardy-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path
