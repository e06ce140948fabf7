"""Signed feature hashing as a sparse relation: row_id, bucket, weight."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import Hasher

PORTABLE = Hasher()
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _check(buckets: int) -> None:
    if buckets < 1:
        raise ValueError("there must be at least one bucket")


def bucket_of(token: Column, buckets: int, hasher: Hasher = PORTABLE) -> Column:
    _check(buckets)
    return F.pmod(hasher.h(token), F.lit(buckets))


def sign_of(token: Column, hasher: Hasher = PORTABLE, alternate: bool = True) -> Column:
    """+1 or -1 by the hash's top bit; +1 always where signs are off."""
    return F.when(F.getbit(hasher.h(token), F.lit(hasher.bits - 1)) == 0, 1).otherwise(-1) if alternate else F.lit(1)


def tokens(rows: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """row_id, token, weight: numbers weigh their column's name, an array column gives its elements, others ``name=value``."""
    types, parts = dict(rows.dtypes), []
    for c in columns:
        if types[c] in NUMBERS:
            parts.append(F.array(F.struct(F.lit(c).alias("token"), F.col(c).cast("double").alias("weight"))))
        elif types[c].startswith("array"):
            parts.append(F.transform(F.coalesce(c, F.array().cast(types[c])), lambda x: F.struct(x.cast("string").alias("token"), F.lit(1.0).alias("weight"))))
        else:
            value = F.initcap(F.col(c).cast("string")) if types[c] == "boolean" else F.col(c).cast("string")
            parts.append(F.array(F.struct(F.concat(F.lit(f"{c}="), F.coalesce(value, F.lit("None"))).alias("token"), F.lit(1.0).alias("weight"))))
    return rows.select(row_id, F.explode(F.concat(*parts)).alias("t")).select(row_id, "t.token", "t.weight").where("weight IS NOT NULL")


def map_tokens(rows: DataFrame, row_id: str, column: str) -> DataFrame:
    """row_id, token, weight of a MAP<STRING, DOUBLE or STRING> column."""
    number = dict(rows.dtypes)[column].endswith((",double>", ",int>", ",bigint>", ",float>"))
    pairs = rows.select(row_id, F.explode(column).alias("k", "v"))
    if number:
        return pairs.select(row_id, F.col("k").alias("token"), F.col("v").cast("double").alias("weight"))
    return pairs.select(row_id, F.concat("k", F.lit("="), F.coalesce(F.col("v").cast("string"), F.lit("None"))).alias("token"), F.lit(1.0).alias("weight"))


def transform(rows: DataFrame, row_id: str, buckets: int = 256, hasher: Hasher = PORTABLE, alternate: bool = True) -> DataFrame:
    """row_id, bucket, weight of (row_id, token, weight) rows: the signed sums."""
    signed = sign_of(F.col("token"), hasher, alternate) * F.col("weight")
    return rows.select(row_id, bucket_of(F.col("token"), buckets, hasher).alias("bucket"), signed.alias("w")).groupBy(row_id, "bucket").agg(F.sum("w").alias("weight"))


def dense(hashed: DataFrame, row_id: str, buckets: int) -> DataFrame:
    """row_id, features: ARRAY<DOUBLE> of the given width."""
    cells = hashed.groupBy(row_id).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    return cells.select(row_id, F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("bigint")), F.lit(0.0))).alias("features"))


def assignments(rows: DataFrame, token: str, buckets: int, hasher: Hasher = PORTABLE) -> DataFrame:
    """token, bucket of the distinct tokens."""
    return rows.select(F.col(token).alias("token")).distinct().withColumn("bucket", bucket_of(F.col("token"), buckets, hasher))


def collision_rate(rows: DataFrame, token: str, buckets: int, hasher: Hasher = PORTABLE) -> DataFrame:
    """n_tokens, collision_rate: 1 - distinct buckets / distinct tokens (0 without tokens)."""
    a = assignments(rows, token, buckets, hasher)
    return a.agg(F.count("*").alias("n_tokens"), F.coalesce(1 - F.countDistinct("bucket") / F.nullif(F.count("*"), F.lit(0).cast("bigint")), F.lit(0.0)).alias("collision_rate"))


def colliding_groups(rows: DataFrame, token: str, buckets: int, hasher: Hasher = PORTABLE) -> DataFrame:
    """bucket, tokens (sorted) of the buckets with more than one token."""
    return assignments(rows, token, buckets, hasher).groupBy("bucket").agg(F.sort_array(F.collect_list("token")).alias("tokens")).where("size(tokens) > 1")


def memory_bytes(n_rows: int, buckets: int) -> int:
    return n_rows * buckets * 8


def gram(hashed: DataFrame, row_id: str) -> DataFrame:
    """i, j, value: the Gram matrix of a sparse relation, by a self-join on the row."""
    left, right = (hashed.select(row_id, F.col("bucket").alias(x), F.col("weight").alias(f"w_{x}")) for x in "ij")
    return left.join(right, row_id).groupBy("i", "j").agg(F.sum(F.col("w_i") * F.col("w_j")).alias("value"))


def ridge_r2(train: DataFrame, test: DataFrame, target: str, row_id: str, buckets: int, alpha: float = 1.0) -> float:
    """R squared on test of the ridge fit (no intercept) on train; NaN if test has no variance.

    train and test: row_id, bucket, weight and target on each row.  Gram matrix and
    moments are summed in Spark; the driver solves one system of ``buckets`` unknowns.
    """
    if buckets > 4096:
        raise ValueError("the driver solves for at most 4096 buckets")
    a, b = alpha * np.eye(buckets), np.zeros(buckets)
    for r in gram(train, row_id).toLocalIterator():
        a[r["i"], r["j"]] += r["value"]
    for r in train.groupBy("bucket").agg(F.sum(F.col("weight") * F.col(target)).alias("v")).toLocalIterator():
        b[r["bucket"]] = r["v"]
    weights = train.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(np.linalg.solve(a, b))], "bucket bigint, beta double")
    fitted = test.join(F.broadcast(weights), "bucket").groupBy(row_id, target).agg(F.sum(F.col("weight") * F.col("beta")).alias("fit"))
    r = fitted.agg(F.sum(F.pow(F.col(target) - F.col("fit"), F.lit(2))).alias("e"), F.var_pop(target).alias("v"), F.count("*").alias("n")).first()
    return float("nan") if not r["n"] or not r["v"] else 1 - r["e"] / (r["v"] * r["n"])
