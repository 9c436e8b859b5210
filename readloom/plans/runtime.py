"""Session defaults, shared-folder materialisation and size checks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, list[tuple]] = {}
_fallback: dict[str, str] = {}
_shipped: set[str] = set()


def session(app: str = "readloom", cpus: int | str = "*", **conf) -> SparkSession:
    """A local session with the settings the engine expects; a cluster brings its own, ``spark.checkpoint.dir`` too."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": "file://" + _local_dir(),
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="readloom-")
    atexit.register(shutil.rmtree, path, True)
    return path


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, which ``spark.checkpoint.dir`` names.

    Where it is unset, a local session gets a temporary one. On a cluster each machine would see a folder of its own,
    and results would lack rows without a word, so that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + _local_dir()
    return _fallback[app]


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers of this application import the package: from its place, and on a cluster as an archive
    that Spark hands to every executor."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    parts = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, parts)])
    app = spark.sparkContext.applicationId
    if is_local(spark) or app in _shipped:
        return
    name = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(_local_dir(), name), "zip", root, name))
    _shipped.add(app)


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the driver exits."""
    path = f"{shared_dir(spark).rstrip('/')}/readloom-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = []
        atexit.register(_drop_all, app)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _written[app].append((jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath))
    return path


def _drop_all(app: str) -> None:
    for fs, path in _written.pop(app, []):
        try:
            fs.delete(path, True)
        except Exception:  # the driver's JVM is gone; the folder's owner cleans up
            return


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read, not a recomputation, and lets a frame that is used
    more than once be computed once. Columnar and compressed, so it takes less disk than an RDD checkpoint.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with column ``name`` computed once a row.

    A projected expression is copied into every filter and join condition behind it, to be computed anew in each, for rows
    that the join then drops too. The optimizer does not copy through a generator.
    """
    return df.select(*(c for c in df.columns if c != name), F.explode_outer(F.array(value)).alias(name))


def rows_at_most(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows; reads no more than ``bound + 1`` of them."""
    return df.limit(bound + 1).count() <= bound


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work far dearer than moving its rows.

    Files of few row groups give few partitions, however many cores wait. Inputs that have enough are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def drop_materialized(spark: SparkSession) -> None:
    """Delete what this application wrote by :func:`materialize`; frames that read it are void then."""
    _drop_all(spark.sparkContext.applicationId)


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
