"""Session helpers: reading tables, the shared folder, size checks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per context, so that they can
    import it wherever the driver was started. The driver serves the archive itself."""
    context = spark.sparkContext
    if getattr(context, "_gaugeworks_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="gaugeworks-code-")) / "gaugeworks.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(path.relative_to(root.parent)))
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
    context.addPyFile(str(target))
    context._gaugeworks_shipped = True


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One of the tables below ``base``."""
    return spark.read.parquet(f"{base}/{name}.parquet")


#: Paths in shared folders that this process made, to be deleted at its end.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, from ``spark.checkpoint.dir``.

    Where the setting is absent, a session on this machine alone (as in tests) gets a
    temporary folder of this process; on a cluster, whose executors wouldn't see that,
    it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if context.isDefined():
        return context.get().rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    own = "file://" + tempfile.mkdtemp(prefix="gaugeworks-")
    spark.sparkContext.setCheckpointDir(own)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses; it lives as long as this process."""
    if not _MADE:
        atexit.register(clean_up)
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    _MADE.append(path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString())
    return _MADE[-1]


def clean_up() -> None:
    """Delete what :func:`fresh_path` gave out; frames that read it are of no use after."""
    context = SparkContext._active_spark_context
    while _MADE:
        path = _MADE.pop()
        try:
            if path.startswith("file:") or "://" not in path:
                shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
            elif context is not None:
                at = context._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            continue


def materialised(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage
    in a way that survives the loss of executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a frame of which the size bound is part of the contract.

    Raises ValueError if it has more than ``limit`` rows, so nothing unbounded
    ever reaches the driver.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it can't be broadcast")
    return rows


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over enough partitions to keep all cores at work on costly rows.

    A scan that already has two partitions a core stays as it is. Fewer mean a small input
    (or few row groups), which is hashed by ``key``: the same rows land in the same
    place if a task is run again.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(3 * cores, key)


def local_session(cpus: int = 8, app: str = "gaugeworks") -> SparkSession:
    """A session for tests and benchmarks on this machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GAUGEWORKS_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
