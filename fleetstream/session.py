"""Session helpers: a configured SparkSession and the shared scratch folder.

Jobs that must cut lineage or stage files (fixtures, stream checkpoints,
result tables) write under the folder the cluster names in
``spark.checkpoint.dir``.  We only pick a folder ourselves when the session
has none (local tests); on a cluster that setting points at shared storage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _cores(master: str) -> int:
    import os
    inner = master[master.find("[") + 1:master.find("]")] if "[" in master else "1"
    if inner in ("*", ""):
        return os.cpu_count() or 8
    try:
        return int(inner.split(",")[0])
    except ValueError:
        return os.cpu_count() or 8


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8,
              app: str = "fleetstream", **extra: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        # external tasks must run once per file: no speculative copies
        .config("spark.speculation", "false")
        # listing many folders/files (file streams, one file per task) runs as
        # a Spark job; one task per path (default 10000) is all overhead
        .config("spark.sql.sources.parallelPartitionDiscovery.parallelism",
                str(max(8, 4 * _cores(master))))
    )
    for k, v in extra.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_session_defaults(spark: SparkSession) -> None:
    """Settings the operators rely on for exact results."""
    # events.ts is TIMESTAMP_NTZ; epoch millis must not shift with the zone
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def ensure_listing_defaults(spark: SparkSession) -> None:
    """Listing: some tasks a core (by default Spark runs one for each of up to
    10,000 paths, also for the files of a stream's batch), and none for a few
    hundred paths.  A stream's log of the files it has seen is written whole at
    every hundredth batch, not every tenth.  On the session, since a file stream's
    source reads the settings of the session that loaded it, at every batch."""
    key = "spark.sql.sources.parallelPartitionDiscovery"
    for k, v in ((f"{key}.parallelism", max(8, 4 * cluster_cores(spark))), (f"{key}.threshold", 256),
                 ("spark.sql.streaming.fileSource.log.compactInterval", 100)):
        if not spark.sparkContext.getConf().contains(k):
            spark.conf.set(k, str(v))


def cluster_cores(spark: SparkSession) -> int:
    """Cores that the cluster offers now (executors come and go)."""
    sc = spark.sparkContext
    tasks = int(sc.getConf().get("spark.task.cpus", "1"))
    try:
        per = int(sc.getConf().get("spark.executor.cores", "0"))
        executors = sc._jsc.sc().getExecutorMemoryStatus().size() - 1  # less the driver
        if per and executors > 0:
            return max(1, per * executors // tasks)
    except Exception:  # noqa: BLE001 - e.g. a Connect session has no JVM view
        pass
    return max(1, sc.defaultParallelism)


def spread(df, least: int | None = None):
    """Rows that each cost seconds of work (external tasks): dealt round-robin
    over at least ``least`` partitions (default: the shuffle partitions)."""
    n = least or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, cluster_cores(df.sparkSession)))


def spread_if_narrow(df, min_partitions: int | None = None):
    """For the small tables behind the registered queries' fixtures only: one
    file with one row group is one split, however many cores there are.  An
    input with more splits than one is returned unchanged."""
    try:
        sc = df.sparkSession.sparkContext
        want = min_partitions or sc.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - e.g. a Connect session has no RDD view
        return df
    return df.repartition(want) if have == 1 and want > 1 else df


def shared_root(spark: SparkSession) -> str:
    """Folder on shared storage for this application (from spark.checkpoint.dir)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if not current:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
        if not configured:
            if not sc.master.startswith("local"):
                raise ValueError("fleetstream: set spark.checkpoint.dir to a folder that driver and executors share")
            # only reached when nothing is configured, as in local tests
            configured = tempfile.mkdtemp(prefix="fleetstream-ckpt-")
        sc.setCheckpointDir(configured)
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder name under the shared root."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def to_local_path(uri: str) -> str:
    """``file:/x`` or ``file:///x`` -> ``/x``; other strings pass unchanged."""
    if uri.startswith("file://"):
        return uri[len("file://"):]
    if uri.startswith("file:"):
        return uri[len("file:"):]
    return uri


_MATERIALIZED: dict[str, list[str]] = {}


def materialize(df, name: str = "materialized"):
    """Cut lineage by writing ``df`` as a parquet table in the shared folder
    (``spark.checkpoint.dir``) and reading it back.  Unlike ``checkpoint()``
    (row blocks), later passes read only the columns they need, compressed;
    the files survive the loss of any executor.  They stay until
    ``release_materialized`` deletes them, since a result may still read them."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _MATERIALIZED.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def release_materialized(spark: SparkSession) -> None:
    """Delete the tables that this application has materialized: call it when
    results that read them have been written."""
    for path in _MATERIALIZED.pop(spark.sparkContext.applicationId, []):
        hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)
