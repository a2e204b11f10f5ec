"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on: AQE re-plans joins at run time and splits
# skewed shuffle partitions; UTC keeps timestamp text equal to DuckDB's.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "repairmine") -> SparkSession:
    """Build (or reuse) a session with the engine's base settings.

    On a cluster the master and sizes come from spark-submit; locally the
    caller passes ``local[N]`` and a small shuffle width.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        b = b.config("spark.driver.memory", "16g")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that
    functions pickled by reference load whatever folder the job starts from."""
    sc = spark.sparkContext
    if getattr(sc, "_repairmine_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="repairmine-zip-"), "repairmine_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(target)
    sc._repairmine_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names a shared folder. Only a session whose executors are in
    this process (``local[...]``) may go without: a fresh scratch folder is
    then created and set. Anything else fails, because executors would each
    write to a disk of their own.
    """
    ship_package(spark)
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="repairmine-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a written intermediate table inside the shared folder."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def materialize(spark: SparkSession, df, name: str):
    """Cut lineage by writing ``df`` as a parquet table in the shared
    checkpoint folder and reading it back (computed once; a lost executor
    later re-reads files instead of recomputing the plan). Every call gets a
    fresh folder, so concurrent jobs never share one."""
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a table, asked from its store; any other error
    of the store is an error here."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hadoop) and len(fs.listStatus(hadoop)) > 0


def file_stamps(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of every file of a table, from its own store."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return (path,)
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(hadoop))


_WRITTEN: dict = {}


def written_once(spark: SparkSession, name: str, inputs: list[str], build):
    """A derived table that several queries of a session read, written once
    for the present files of its inputs; new files mean a new table."""
    key = (spark.sparkContext.applicationId, name, tuple(file_stamps(spark, p) for p in inputs))
    if key not in _WRITTEN:
        _WRITTEN[key] = materialize(spark, build(), name)
    return _WRITTEN[key]
