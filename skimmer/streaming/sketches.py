"""Sketches over unbounded input: windowed distinct counts, exact dedupe and incremental merges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import Hasher
from ..functions.sizing import CountMinGeometry, HllGeometry
from ..operators import cms, hll


def windowed_distinct(events: DataFrame, ts: str, column: str, window: str = "1 day", late: str = "2 days", precision: int = 11) -> DataFrame:
    """window_start, window_end, estimate, n_rows of tumbling windows; rows later than the watermark are dropped."""
    out = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window).alias("w")).agg(F.hll_sketch_agg(column, F.lit(precision)).alias("s"), F.count("*").alias("n_rows"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.hll_sketch_estimate("s").alias("estimate"), "n_rows")


def unique_events(events: DataFrame, ts: str, keys: Sequence[str], late: str = "2 days") -> DataFrame:
    """Each key once within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def registers_sink(path: str, column: str, g: HllGeometry, hasher: Hasher = Hasher()) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch's registers go to path/batch=N, replaced if the batch is repeated."""

    def run(batch: DataFrame, number: int) -> None:
        hll.registers(batch, column, g, hasher).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def merged_registers(spark: SparkSession, path: str) -> DataFrame:
    return hll.merge(spark.read.parquet(path).select("reg", "rank"))


def cells_sink(path: str, column: str, g: CountMinGeometry = CountMinGeometry(), hasher: Hasher = Hasher()) -> Callable[[DataFrame, int], None]:
    """As registers_sink, for Count-Min cells."""

    def run(batch: DataFrame, number: int) -> None:
        cms.build(batch, column, g, hasher).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def merged_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("row", "col").agg(F.sum("cnt").alias("cnt"))
