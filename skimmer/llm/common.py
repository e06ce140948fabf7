"""Shared folder tables, connected components and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}
_scopes: list[list[str]] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the application's Python workers, once, so that they needn't have it installed."""
    if spark.sparkContext.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="skimmer-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(spark.sparkContext.applicationId)


def mapped(df: DataFrame, f: Callable, schema: str | StructType) -> DataFrame:
    """df.mapInArrow(f, schema) with the package on the workers: a UDF sees what was shipped before it was made."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def solved(df: DataFrame, keys: Sequence[str], f: Callable, schema: str) -> DataFrame:
    """df.groupBy(keys).applyInArrow(f, schema) with the package on the workers."""
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(f, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, local mode gets a folder of its own and a cluster an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='skimmer-')}"
    return _own_dirs[context.applicationId]


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table or folder of this application; it goes with the scope that it was made in, else when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/skimmer/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    files, where = _hadoop(spark, path)
    files.deleteOnExit(where)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    files, where = _hadoop(spark, path)
    files.delete(where, True)
    files.cancelDeleteOnExit(where)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables made inside are deleted at its end; what is to be kept must be written elsewhere before. After an error they stay until the driver ends."""
    _scopes.append([])
    try:
        yield
        for path in _scopes[-1]:
            _delete(spark, path)
    finally:
        _scopes.pop()


def written(df: DataFrame, name: str = "", path: str | None = None) -> DataFrame:
    """df as a table written in the shared folder, or at path: it cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = path or new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skimmer_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that written() made and that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_skimmer_path", None)
        if path:
            _delete(df.sparkSession, path)


def bounded(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A written table, marked for broadcast if it has at most so many rows; else Spark's join, which splits hot keys, decides."""
    return F.broadcast(df) if df.count() <= rows else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node each node of the undirected edges reaches.

    Alternating large-star and small-star steps.  Each groups with a partial minimum
    and joins edges with one row a node, so a hub splits like any skewed join side.
    Nodes without an edge to another node do not occur.  No edges: no rows.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = written(pairs, "edges")
    size = F.struct(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).alias("x")
    mark = now.select(size).first()["x"]
    while mark[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*").where("u <> v").distinct()
        )
        new = written(small, "edges")
        discard(now)
        now, before = new, mark
        mark = now.select(size).first()["x"]
        if mark == before:
            break
    ends = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return ends.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
