"""Session settings, the package on workers, and tables in the folder that all machines share.

On a cluster the session comes from outside; the only setting made there bounds Arrow batches by
bytes, where the session does not.
"""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder used only by local sessions that name none (tests on one machine).
FALLBACK_DIR = "/tmp/inkstone-checkpoints"
#: Bytes of an Arrow batch: few long rows, or many short ones, reach a Python worker at a time.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
#: Tasks a core that rows are dealt to, and rows from which on that is worth a shuffle.
TASKS, WORTH = 4, 1000


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests rely on (UTC, few shuffle partitions)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("inkstone")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", os.environ.get("INKSTONE_CHECKPOINT_DIR", "/tmp/inkstone-checkpoints"))
        .getOrCreate()
    )


def _hadoop(spark: SparkSession, path: str):
    """(file system, path object) of a path in any store that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable for Python workers on any machine; does nothing the second time.

    The packed package goes to the shared folder, never to a folder of one machine."""
    context = spark.sparkContext
    if context.getConf().get(BATCH_SETTING) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    if getattr(context, "_inkstone_shipped", False):
        return spark
    home = Path(__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(home.rglob("*.py")):
            archive.write(path, f"{home.name}/{path.relative_to(home)}")
    files, at = _hadoop(spark, f"{_own_dir(spark)}/inkstone-{hashlib.sha256(packed.getvalue()).hexdigest()[:16]}.zip")
    out = files.create(at, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    context.addPyFile(files.makeQualified(at).toString())  # the driver serves it to executors
    context._inkstone_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, from spark.checkpoint.dir; FALLBACK_DIR for a local session without one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return named or FALLBACK_DIR


def _own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; deleted when the driver ends."""
    context = spark.sparkContext
    path = f"{shared_dir(spark)}/inkstone-{context.applicationId}"
    if not getattr(context, "_inkstone_cleaned", False):
        context._inkstone_cleaned = True
        context._inkstone_stored = []
        atexit.register(_cleared, spark, path)
    return path


def _cleared(spark: SparkSession, path: str) -> None:
    """Deletes a folder; at the driver's end the JVM may be gone already, which leaves the folder to its owner."""
    try:
        files, at = _hadoop(spark, path)
        files.delete(at, True)
    except Exception:  # noqa: BLE001
        return


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table in the shared folder; ``finished`` and the driver's end delete what is there."""
    path = f"{_own_dir(spark)}/{uuid.uuid4().hex}/{name}"
    spark.sparkContext._inkstone_stored.append(path)
    return path


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table is at path, in any store that Spark reaches."""
    files, at = _hadoop(spark, f"{path}/_SUCCESS")
    return files.exists(at)


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors.

    compression is the session's unless given: zstd takes a little more time and much less room for texts and vectors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to TASKS tasks a core, if one task would read more than twice its share; else as it is.

    A Parquet file is read by as many tasks as it has row groups, whatever its size, and heavy columns make that the longest step.
    Rows are counted from the files' footers alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    if sum(sizes) < WORTH or max(sizes) * cores <= 2 * sum(sizes):
        return df
    return df.repartition(max(TASKS * cores, len(sizes)), *keys)


def dropped(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Deletes the tables stored since the list had so many entries, but for the last keep ones: nothing may read them any more."""
    paths = spark.sparkContext._inkstone_stored
    gone = paths[since : len(paths) - keep]
    del paths[since : len(paths) - keep]
    for path in gone:
        _cleared(spark, path.rsplit("/", 1)[0])


def tables_stored(spark: SparkSession) -> int:
    _own_dir(spark)
    return len(spark.sparkContext._inkstone_stored)


def finished(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The stored result of make, less the tables that it stored on its way."""
    since = tables_stored(spark)
    out = stored(make(), name)
    dropped(spark, since, keep=1)
    return out
