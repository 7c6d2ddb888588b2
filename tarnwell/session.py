"""Sessions, and tables written between the steps of a long plan."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tarnwell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library expects: UTC, AQE, Arrow. Keywords use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset, as in tests on one machine, a temporary folder is used; on a cluster that is an error.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + os.path.join(tempfile.gettempdir(), f"tarnwell-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files behind a table that ``written`` made, once nothing will read it."""
    spark = df.sparkSession
    jvm, root = spark._jvm, shared_folder(spark)
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if f.startswith(root) or f.replace("file:///", "file:/").startswith(root.replace("file:///", "file:/")):
            p = jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once a session, so that nothing depends on their PYTHONPATH."""
    sc = spark.sparkContext
    if getattr(sc, "_tarnwell_shipped", False):
        return
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="tarnwell-"), "tarnwell")
    sc.addPyFile(shutil.make_archive(target, "zip", root, "tarnwell"))
    sc._tarnwell_shipped = True
