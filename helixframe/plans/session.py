"""Session helpers: the one place where Spark settings are chosen."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "helixframe", cpus: str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benches; on a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each context; local ones have the driver's folders, and others those of PYTHONPATH."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    path = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if context.master.startswith("local["):
        path.add(Path(".").resolve())
    if root in path or getattr(context, "_helixframe_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="helixframe-py-")
    atexit.register(shutil.rmtree, folder, True)
    context.addPyFile(shutil.make_archive(f"{folder}/helixframe", "zip", root, "helixframe"))
    context._helixframe_shipped = True


def _folder(df: DataFrame) -> str:
    """The checkpoint folder, from spark.checkpoint.dir or, where that is unset (tests on local masters), a temporary one."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not folder:
            folder = tempfile.mkdtemp(prefix="helixframe-cut-")
            atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """checkpoint(): computes a small table once and cuts its plan, in the shared folder."""
    _folder(df)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """A large table that several steps read, written once as Parquet in the shared folder, so that each reads its columns only."""
    path = f"{_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
