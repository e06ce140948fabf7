"""Counting Bloom filters as relations: keys..., idx, cnt, raw (cnt before saturation)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.hashing import Hasher, exploded_indices, item
from ..functions.sizing import BloomGeometry

PORTABLE = Hasher()


def cap(counter_bits: int) -> int:
    if counter_bits not in (8, 16):
        raise ValueError("counters have 8 or 16 bits")
    return (1 << counter_bits) - 1


def memory_bytes(g: BloomGeometry, counter_bits: int = 8) -> int:
    return g.n_bits * cap(counter_bits).bit_length() // 8


def build(items: DataFrame, column: str, g: BloomGeometry, hasher: Hasher = PORTABLE, counter_bits: int = 8, keys: Sequence[str] = ()) -> DataFrame:
    """Every addition counts, and twice where two indices of an item coincide; counters stop at their cap."""
    raw = exploded_indices(items, item(items, column), hasher, g.n_hashes, g.n_bits, *keys).groupBy(*keys, "idx").agg(F.count("*").alias("raw"))
    return raw.withColumn("cnt", F.least("raw", F.lit(cap(counter_bits))))


def stats(filter_: DataFrame, g: BloomGeometry, counter_bits: int = 8, keys: Sequence[str] = ()) -> DataFrame:
    """keys..., nonzero, n_saturated (additions lost to the cap), fill_ratio, estimated_fp_rate."""
    used = F.count(F.when(F.col("cnt") > 0, 1))
    fill = used / g.n_bits
    return filter_.groupBy(*keys).agg(
        used.alias("nonzero"), F.coalesce(F.sum(F.greatest(F.col("raw") - cap(counter_bits), F.lit(0))), F.lit(0)).alias("n_saturated"),
        fill.alias("fill_ratio"), F.pow(fill, F.lit(g.n_hashes)).alias("estimated_fp_rate"))


def count_estimate(queries: DataFrame, column: str, filter_: DataFrame, g: BloomGeometry, hasher: Hasher = PORTABLE) -> DataFrame:
    """column, estimate (the least of its counters, never below the truth but for the cap), found."""
    q = queries.select(F.col(column).alias("__item")).distinct()
    probe = exploded_indices(q, item(q, "__item"), hasher, g.n_hashes, g.n_bits, "__item")
    out = probe.join(filter_.select("idx", "cnt"), "idx", "left").groupBy("__item").agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))
    return out.select(F.col("__item").alias(column), "estimate", (F.col("estimate") > 0).alias("found"))


def remove(filter_: DataFrame, removals: DataFrame, column: str, g: BloomGeometry, hasher: Hasher = PORTABLE, counter_bits: int = 8) -> tuple[DataFrame, DataFrame]:
    """The filter after a batch of removals, and the distinct refused items.

    A removal is judged against the filter before the batch: an item with a zero counter
    is refused and changes nothing.  Saturated counters stay; no counter goes below zero.
    """
    limit = cap(counter_bits)
    found = count_estimate(removals, column, filter_, g, hasher)
    accepted = removals.join(found.where("found").select(column), column, "left_semi")
    less = exploded_indices(accepted, item(accepted, column), hasher, g.n_hashes, g.n_bits).groupBy("idx").agg(F.count("*").alias("less"))
    after = filter_.join(less, "idx", "left").withColumn("less", F.coalesce("less", F.lit(0)))
    stay = F.col("cnt") >= limit
    left = F.when(stay, F.col("cnt")).otherwise(F.greatest(F.col("cnt") - F.col("less"), F.lit(0)))
    return after.select("idx", F.when(stay, F.col("raw")).otherwise(left).alias("raw"), left.alias("cnt")).where("cnt > 0"), found.where("NOT found").select(column)


def replay(log: DataFrame, column: str, seq: str, delta: str, g: BloomGeometry, hasher: Hasher = PORTABLE, counter_bits: int = 8) -> DataFrame:
    """idx, cnt after an ordered log of +1 and -1: a counter that has once reached the cap stays there.

    Every removal in the log must be of an item that is in.
    """
    steps = exploded_indices(log, item(log, column), hasher, g.n_hashes, g.n_bits, seq, delta)
    order = Window.partitionBy("idx").orderBy(seq, F.desc(delta), "row").rowsBetween(Window.unboundedPreceding, 0)
    run = steps.withColumn("run", F.sum(delta).over(order))
    top = run.groupBy("idx").agg(F.max("run").alias("peak"), F.sum(delta).alias("net"))
    return top.select("idx", F.when(F.col("peak") >= cap(counter_bits), F.lit(cap(counter_bits))).otherwise(F.greatest("net", F.lit(0))).cast("bigint").alias("cnt"))


def merge(a: DataFrame, b: DataFrame, counter_bits: int = 8) -> DataFrame:
    """The filter of both filters' additions."""
    return a.unionByName(b).groupBy("idx").agg(F.sum("raw").alias("raw")).withColumn("cnt", F.least("raw", F.lit(cap(counter_bits))))
