"""What the text operators share: Arrow mapping by batch, durable cuts of the lineage, connected components."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of one Arrow batch between the JVM and Python, the same for all operators; Spark also ends a batch at 64 MB.
BATCH_ROWS = 512
#: Tables between steps are written in at most so many files for each core of the cluster.
TASKS_PER_CORE = 8
#: UTF-8 white space that separates words in the contracts that split on [\x20\x09-\x0D]; bytes.split() splits on just these.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def release() -> None:
    """Gives freed memory of a Python worker back to the system, where the C library can; workers outlive their tasks."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def small_batches(df: DataFrame) -> DataFrame:
    """df, in whose session Arrow batches have BATCH_ROWS rows, whichever operator's plan runs first."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def numbers(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[np.ndarray]:
    """The rows of batches of whole numbers, as arrays of some `rows` rows or what is left."""
    held, size = [], 0
    for batch in batches:
        held.append(np.stack([c.to_numpy() for c in batch.columns], 1).astype(np.int64, copy=False))
        size += batch.num_rows
        if size >= rows:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """Applies a Python function to every row, a batch at a time.

    make() runs once per task and returns a function of the row's columns that yields result tuples;
    the result has `schema`. A batch holds BATCH_ROWS rows or 64 MB, so memory doesn't grow with the partition.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            rows = [out for row in zip(*(c.to_pylist() for c in batch.columns)) for out in f(*row)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)
        release()

    return small_batches(df).mapInArrow(run, schema)


def filter_rows(df: DataFrame, make: Callable[[], Callable[..., bool]], columns: list[str]) -> DataFrame:
    """The rows of df, all columns kept as they are, for which a Python function of some columns is true.

    The function runs in mapInArrow over whole batches, so nothing is shuffled and rows without a key stay apart.
    """
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            yield batch.filter(pa.array([bool(f(*row)) for row in zip(*(batch.column(i).to_pylist() for i in at))], pa.bool_()))
        release()

    return small_batches(df).mapInArrow(run, df.schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place and sc._jsc.sc().getCheckpointDir().isDefined():
        place = os.path.dirname(sc._jsc.sc().getCheckpointDir().get())  # the folder that was set; Spark adds one of its own
    if not place:
        place = getattr(sc, "_helixframe_dir", None)
        if place is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if place is None:
            place = sc._helixframe_dir = tempfile.mkdtemp(prefix="helixframe-")
            atexit.register(shutil.rmtree, place, True)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(place)
    return place


def _fewer(df: DataFrame) -> DataFrame:
    """df in at most TASKS_PER_CORE partitions a core: whole partitions follow one another in a task, so it holds no more at once.

    Where executors come and go by demand, the cores of the moment say nothing, and df stays as it is.
    """
    if df.sparkSession.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false") == "true":
        return df
    return df.coalesce(max(TASKS_PER_CORE, TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism))


def cut(df: DataFrame) -> DataFrame:
    """checkpoint(): computes df once, in the shared folder, and cuts its lineage."""
    shared_dir(df.sparkSession)
    return _fewer(df).checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as Parquet in the shared folder, and its path; for wide intermediate tables, and where the size decides how they are joined.

    What dropped() doesn't delete goes when the driver's Python ends.
    """
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/helixframe-{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_helixframe_tables", None) != top:
        spark.sparkContext._helixframe_tables = top
        atexit.register(dropped, spark, top)
    path = f"{top}/{uuid.uuid4().hex}"
    _fewer(df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder that written() made, if the JVM still runs."""
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the gateway is closed: nothing is left to delete it with
        pass


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an undirected graph that aren't the smallest of their component, and that smallest."""
    node, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    one, two = at[: len(a)], at[len(a) :]
    root = np.arange(len(node))
    while True:
        least = np.minimum(root[one], root[two])
        new = root.copy()
        for side in (one, two):
            np.minimum.at(new, root[side], least)
        while (jumped := new[new] < new).any():
            new = np.where(jumped, new[new], new)
        new = new[root]
        if (new == root).all():
            above = root != np.arange(len(node))
            return node[above], node[root[above]]
        root = new


def _forest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of one task to (a, b, own): its nodes with the smallest of their component; own if the node came as an a."""
    a = b = mine = np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def settle():
        nonlocal a, b, mine, held, size
        mine = np.unique(np.concatenate((mine, *(x for x, _ in held))))
        a, b = _roots(*(np.concatenate(x) for x in zip((a, b), *held)))
        held, size = [], 0

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size > max(1_000_000, 2 * len(a)):
            settle()
    if held:
        settle()
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.isin(a, mine, assume_unique=True))], ["a", "b", "own"])
    release()


def local_forests(edges: DataFrame, by: str) -> DataFrame:
    """Edges (a, b) to stars (a, b) that join the same nodes, for the edges of each value of a column that holds few of them."""
    return edges.select("a", "b", by).repartition(by).select("a", "b").mapInArrow(_forest_of, "a long, b long, own boolean").select("a", "b")


def connected_components(edges: DataFrame) -> DataFrame:
    """Roots of an undirected graph: edges (a, b) of long to (node, root), root the smallest node reachable.

    Each round deals the edges out by their larger node, replaces those of each task by a forest of depth one, and
    lets each node skip its parent to that one's least parent. A node's parents meet in one task, its children don't, so a component of a third
    of all nodes is dealt out evenly, and adaptive execution splits the join at its root; a forest that is small is
    joined without a shuffle. It ends when no parent has a parent and no node two: after logarithmically many rounds,
    each cut by a written table. Self-loops are allowed; nodes without edges don't appear.
    """
    spark = edges.sparkSession
    edge, old = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), None
    while True:
        forest, path = written(edge.repartition("a").mapInArrow(_forest_of, "a long, b long, own boolean"))
        if old:
            dropped(spark, old)
        above = forest.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("c"))  # one parent each, so the join adds no rows
        if not forest.where("not own").limit(1).count() and not forest.join(above, "b", "left_semi").limit(1).count():
            return forest.select(F.col("a").alias("node"), F.col("b").alias("root")).union(forest.select("b", "b").distinct())
        edge, old = forest.join(above, "b", "left").select("a", F.coalesce("c", "b").alias("b")), path
