"""Session helpers: a configured session and durable lineage cuts."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def build_session(app_name: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, adaptive execution, Arrow)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for durable intermediate data.

    It is the one named by ``spark.checkpoint.dir``. Only a local session, whose
    executors share the driver's disk, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="plumbline-")
    context.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the checkpoint folder and read it back.

    The result no longer depends on the lineage of ``df``, so lost executors
    cannot change it, and later passes read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the copy behind a frame that ``materialize`` returned; nothing may read it any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    for folder in folders:
        if not folder.rsplit("/", 1)[-1].startswith("table-"):
            raise ValueError(f"{folder} is no intermediate copy")
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few driver-side rows as a local relation, whose size the optimizer knows."""
    if not rows:
        return spark.createDataFrame([], schema)
    parsed = T.StructType.fromDDL(schema)
    columns = {name: list(values) for name, values in zip(parsed.names, zip(*rows))}
    return spark.createDataFrame(pa.table(columns), parsed)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the package to the executors of a session that was started without it.

    Needed once per application, for the operators with Python tasks, unless
    the package is installed on the cluster or was submitted with --py-files.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{root.name}", "zip", root.parent, root.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
