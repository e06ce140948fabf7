"""Count-Min sketches as relations: keys..., row, col, cnt; merging is a sum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import Hasher, exploded_indices, item
from ..functions.sizing import CountMinGeometry

PORTABLE = Hasher()


def build(items: DataFrame, column: str, g: CountMinGeometry = CountMinGeometry(), hasher: Hasher = PORTABLE, weight: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """A negative weight fails the whole batch; weight 0 is allowed. Items are counted before they are hashed."""
    w = F.lit(1).cast("bigint") if weight is None else F.when(F.assert_true(F.col(weight) >= 0, "weights must not be negative").isNull(), F.col(weight).cast("bigint"))
    each = items.select(*keys, F.col(column).alias("__item"), w.alias("__w")).groupBy(*keys, "__item").agg(F.sum("__w").alias("__w"))
    cells = exploded_indices(each, item(each, "__item"), hasher, g.depth, g.width, *keys, "__w", index="col")
    return cells.groupBy(*keys, "row", "col").agg(F.sum("__w").alias("cnt"))


def merge(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return a.unionByName(b).groupBy(*keys, "row", "col").agg(F.sum("cnt").alias("cnt"))


def total(sketch: DataFrame) -> DataFrame:
    """One row: the total weight (any row of the grid holds all of it)."""
    return sketch.where("row = 0").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))


def estimate(queries: DataFrame, column: str, sketch: DataFrame, g: CountMinGeometry = CountMinGeometry(), hasher: Hasher = PORTABLE) -> DataFrame:
    """column, estimate: the least of an item's cells, never below its weight; an absent cell is 0."""
    q = queries.select(F.col(column).alias("__item")).distinct()
    probe = exploded_indices(q, item(q, "__item"), hasher, g.depth, g.width, "__item", index="col")
    return probe.join(sketch, ["row", "col"], "left").groupBy("__item").agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate")).withColumnRenamed("__item", column)


def estimate_with_bound(queries: DataFrame, column: str, sketch: DataFrame, g: CountMinGeometry = CountMinGeometry(), hasher: Hasher = PORTABLE) -> DataFrame:
    """estimate, error_bound (epsilon times the total weight), lower_bound."""
    out = estimate(queries, column, sketch, g, hasher).join(F.broadcast(total(sketch)))  # one row
    bound = F.lit(g.epsilon) * F.col("total")
    return out.select(column, "estimate", bound.alias("error_bound"), F.greatest(F.lit(0.0), F.col("estimate") - bound).alias("lower_bound"))


def heavy_hitters(candidates: DataFrame, column: str, sketch: DataFrame, fraction: float = 0.01, g: CountMinGeometry = CountMinGeometry(), hasher: Hasher = PORTABLE) -> DataFrame:
    """Candidates whose estimate is at least the fraction of the total weight, heaviest first."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must be above 0 and at most 1")
    out = estimate(candidates, column, sketch, g, hasher).join(F.broadcast(total(sketch)))  # one row
    return out.where(F.col("estimate") >= fraction * F.col("total")).select(column, "estimate").orderBy(F.desc("estimate"), column)


def top_k(items: DataFrame, column: str, k: int) -> DataFrame:
    """The exact k most frequent items; ties go to the smaller item."""
    return items.groupBy(column).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), column).limit(k)


def top_k_native(items: DataFrame, column: str, k: int) -> DataFrame:
    """Spark's one-pass approximate top k."""
    return items.agg(F.explode(F.expr(f"approx_top_k(`{column}`, {int(k)})")).alias("x")).select(F.col("x.item").alias(column), F.col("x.count").alias("cnt"))
