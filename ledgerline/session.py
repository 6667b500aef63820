"""SparkSession construction and cluster-facing settings.

Everything here is plain Spark configuration. On a cluster the session is
normally created by the platform; ``configure`` only fills settings that are
still unset, so a cluster's own choices always win.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the engine relies on. Values are conservative defaults for a large
# cluster; AQE coalesces the initial shuffle partition count down at runtime,
# so a high starting count costs little on small inputs.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Runtime (post-shuffle) broadcast conversion is size-checked by AQE.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Set when a session is built (not changeable on a running one): remove
# lineage-cut checkpoint files once their data is no longer referenced.
STARTUP_DEFAULTS = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}

# Removes an execution's shuffle files when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply DEFAULTS where the session has no value of its own."""
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerline") -> SparkSession:
    """Session for tests and the local bench: UI off, UTC, small shuffle count."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LEDGERLINE_DRIVER_MEMORY", "8g"))
    )
    for key, value in {**DEFAULTS, **STARTUP_DEFAULTS}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    Read from ``spark.checkpoint.dir`` (set by the cluster). When it is unset,
    a fresh scratch folder is created for a local master only (driver and
    tasks share one disk there) and recorded in the session so later calls
    agree; on any other master a machine-local folder would lose data, so
    that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    scratch = tempfile.mkdtemp(prefix="ledgerline-ckpt-")
    spark.conf.set("spark.checkpoint.dir", scratch)
    spark.sparkContext.setCheckpointDir(scratch)
    return scratch


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, from whatever folder the driver was started.

    The package is zipped once per application and handed to Spark, which
    distributes it to every executor (also to those that join later).
    """
    context = spark.sparkContext
    if getattr(context, "_ledgerline_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="ledgerline-zip-"), "ledgerline")
    archive = shutil.make_archive(base, "zip", root_dir=os.path.dirname(package), base_dir=os.path.basename(package))
    context.addPyFile(archive)
    context._ledgerline_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared checkpoint folder for one written table."""
    import uuid

    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if scopes := spark.__dict__.get("_ledgerline_scopes"):
        scopes[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch tables made inside at its end: what is read later must be written to a path from outside."""
    scopes = spark.__dict__.setdefault("_ledgerline_scopes", [])
    scopes.append(made := [])
    try:
        yield
    finally:
        scopes.remove(made)
        for name in made:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Removes the shuffle files of each execution inside when it has ended."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, name: str, path: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Used where an expensive intermediate (e.g. parsed log lines) feeds several
    branches of a plan: it is computed once, lineage is cut, readers prune its
    columns, and a lost executor re-reads files instead of recomputing. The
    shuffle files behind it are removed once it is written. ``path``: where,
    instead of a fresh scratch path; ``codec``: Parquet compression, if not the
    session's.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def cached_handle(spark: SparkSession, key: tuple, build):
    """Reuse one DataFrame handle per session for a read-only input (no data is cached).

    Opening an input (file listing, footer/schema read) costs driver time on
    every call; the returned DataFrame is immutable and re-reads the files
    each time it runs. A handle is opened anew when the modification time of
    the last item of ``key``, a path, has changed.
    """
    handles = spark.__dict__.setdefault("_ledgerline_handles", {})
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(key[-1])
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    stamp = (status.getModificationTime(), status.getLen())
    if key not in handles or handles[key][0] != stamp:
        handles[key] = (stamp, build())
    return handles[key][1]
