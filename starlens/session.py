"""Session helpers.

The library never creates machine-local scratch space on a cluster: everything that has to
outlive a task (checkpoints, landed intermediate tables) goes under ``spark.checkpoint.dir``
as configured by the cluster.  Only tests and the local benchmark set that key themselves,
and only when it is unset.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark (UI off, AQE on, UTC)."""
    parts = shuffle_partitions or (int(cpus) if str(cpus) != "*" else 8)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("starlens")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors once per application, for the functions that run in Python workers."""
    try:
        sc = spark.sparkContext
    except Exception:  # remote session: the package has to be installed there
        return
    if sc.applicationId in _shipped:
        return
    folder = _shipped[sc.applicationId] = tempfile.TemporaryDirectory(prefix="starlens-py-")  # the driver's own; Spark serves it
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(folder.name, "starlens.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(top, f), os.path.relpath(os.path.join(top, f), os.path.dirname(package)))
    sc.addPyFile(path)


def configure(spark: SparkSession) -> SparkSession:
    """Settings every query relies on; safe to call on a cluster session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    size_shuffles(spark)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


# Partitions per core for the first shuffle of every exchange; AQE coalesces them to the advisory size.
PARTITIONS_PER_CORE = 8
ADVISORY_PARTITION_BYTES = str(128 * 1024 * 1024)


def size_shuffles(spark: SparkSession) -> None:
    """On a cluster, start every shuffle wide and let AQE merge it down.

    ``spark.sql.shuffle.partitions`` defaults to 200, far too few for terabytes: each reducer would hold
    hundreds of GB and spill.  Unless the cluster already chose values, exchanges start with
    ``PARTITIONS_PER_CORE`` partitions per core (at least ``spark.sql.shuffle.partitions``) and AQE
    coalesces them to about 128 MB each and splits skewed join partitions at run time.  Local sessions (tests,
    benchmark) keep their own settings.
    """
    try:
        if is_local(spark):
            return
        cores = spark.sparkContext.defaultParallelism
    except Exception:  # no SparkContext (remote session): leave the cluster's settings alone
        return
    unset = lambda k: spark.conf.get(k, None) in (None, "")
    if unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum"):
        base = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(base, PARTITIONS_PER_CORE * cores)))
    if unset("spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", ADVISORY_PARTITION_BYTES)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def is_local(spark: SparkSession) -> bool:
    """True only where driver and executors are one process, so that a machine-local folder is shared."""
    try:
        master = spark.sparkContext.master
    except Exception:  # remote session
        return False
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a scratch one only on a ``local`` master that names none."""
    current = spark.conf.get(CHECKPOINT_KEY, None)
    if not current:
        if not is_local(spark):
            raise RuntimeError(f"{CHECKPOINT_KEY} is not set: name a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="starlens-ckpt-")
        spark.conf.set(CHECKPOINT_KEY, current)
    try:
        spark.sparkContext.setCheckpointDir(current)
    except Exception:  # remote sessions have no SparkContext; written tables still use the folder
        pass
    return current


def scratch_root(spark: SparkSession) -> str:
    """This application's own folder in the shared checkpoint folder."""
    try:
        owner = spark.sparkContext.applicationId
    except Exception:  # remote session
        owner = "remote"
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/starlens-{owner}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of this application's scratch folder (never reused)."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove_scratch(spark: SparkSession) -> bool:
    """Deletes what this application has written as intermediate tables, once its results are no longer read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    return root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(root, True)


def materialise(df, name: str, codec: str = "snappy"):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` but computes the plan a single time (a reliable RDD checkpoint of
    an unpersisted plan recomputes it for the write) and gives the reader file statistics.  ``codec`` is Parquet's; zstd halves digests in hex digits.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    written = df.sparkSession.read.parquet(path)
    written._scratch = path
    return written


def discard(*written) -> None:
    """Deletes the tables that ``materialise`` returned, once nothing is left to read them; other frames are left alone."""
    for df in written:
        path = getattr(df, "_scratch", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession):
    """Queries that run inside leave no shuffle files: for written tables, whose readers never come back to the shuffle."""
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
