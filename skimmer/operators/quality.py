"""Diagnostics of hash functions: bucket histograms, chi square, avalanche."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import HashFunction


def bucket_counts(values: DataFrame, column: str, buckets: int, h: HashFunction, seed: int = 0) -> DataFrame:
    """bucket, n for every bucket, empty ones included."""
    n = values.groupBy(F.pmod(h(F.col(column), seed), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"))
    return values.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def chi_square(values: DataFrame, column: str, buckets: int, h: HashFunction, seed: int = 0) -> DataFrame:
    """n_values, statistic, dof, max_over_expected. No values: fails."""
    t = bucket_counts(values, column, buckets, h, seed).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("s"), F.max("n").alias("x"))
    e = F.col("n") / buckets
    ok = F.assert_true(F.col("n") > 0, "no values").isNull()
    return t.select(F.when(ok, F.col("n")).alias("n_values"), (F.col("s") / e - F.col("n")).alias("statistic"), F.lit(buckets - 1).cast("bigint").alias("dof"), (F.col("x") / e).alias("max_over_expected"))


def p_value(statistic: float, dof: int) -> float:
    """Upper tail of chi square: the regularised incomplete gamma function by series or continued fraction."""
    a, x = dof / 2, statistic / 2
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - scale * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    f = d
    for i in range(1, 10_000):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b or 1e-300)
        c = b + n / c or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return scale * f


def is_uniform(statistic: float, dof: int, level: float = 0.01) -> bool:
    return p_value(statistic, dof) > level


def avalanche(samples: DataFrame, column: str, h: HashFunction, bits: int = 64, input_bits: int = 64) -> DataFrame:
    """bit_in, bit_out, rate: how often flipping an input bit of a BIGINT flips each output bit of its hash."""
    flips = samples.select(F.col(column).cast("bigint").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(input_bits - 1))).alias("bit_in"))
    d = h(F.col("x").cast("string"), 0).bitwiseXOR(h(F.col("x").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit_in"))).cast("string"), 0))
    ones = flips.select("bit_in", d.alias("d")).groupBy("bit_in").agg(F.count("*").alias("n"), *[F.sum(F.getbit("d", F.lit(o)).cast("bigint")).alias(f"b{o}") for o in range(bits)])
    return ones.select("bit_in", F.posexplode(F.array(*[F.col(f"b{o}") / F.col("n") for o in range(bits)])).alias("bit_out", "rate"))


def avalanche_summary(samples: DataFrame, column: str, h: HashFunction, bits: int = 64, input_bits: int = 64) -> DataFrame:
    """mean_rate, worst_deviation from one half."""
    return avalanche(samples, column, h, bits, input_bits).agg(F.avg("rate").alias("mean_rate"), F.max(F.abs(F.col("rate") - 0.5)).alias("worst_deviation"))


def avalanches(worst_deviation: float, n_samples: int) -> bool:
    return worst_deviation <= 5 * math.sqrt(0.25 / n_samples)
