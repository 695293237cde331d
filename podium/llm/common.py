"""Helpers shared by the operators: tables, scratch tables in the shared
folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: ASCII white space, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder the cluster names (spark.checkpoint.dir)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, survives lost executors, and gives the planner a measured size."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete files of our own that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def task_count(spark: SparkSession, amount: int, few: int, many: int) -> int:
    """Tasks for an amount of work that the planner can't see in the size of the rows:
    ``few`` a task up to ``spark.sql.shuffle.partitions`` tasks, never over ``many``."""
    spare = min(-(-amount // few), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(1, spare, -(-amount // many))


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it a query's shuffle files go when the query ends, not when the driver
    collects garbage; for queries that write a table which is then read."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session (as --py-files would)."""
    sc = spark.sparkContext
    if getattr(sc, "_podium_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    at = f"{tempfile.mkdtemp(prefix='podium-')}/podium.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(at)
    sc._podium_shipped = True


def map_batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow with this package on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def words_of(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an undirected edge list; root is the
    smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014).  Every
    step is a grouped minimum (partial aggregation, so a hub costs one row per
    task) and a join back, written to the shared folder; the number of steps
    grows with the logarithm of the longest path.
    """
    def mark(t: DataFrame):
        """Equal for equal sets of edges."""
        return tuple(t.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"),
                           F.expr("bit_xor(xxhash64(v, u))")).first())

    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(),
                    "edges")
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        large = materialize(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        e = materialize(small, "small")
        now = mark(e)
        if now == before:
            break
        before = now
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())


def open_store(path: str):
    """(file system, path in it) of a URI, for byte-range reads and writes in
    tasks; any store pyarrow knows, local paths included."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
