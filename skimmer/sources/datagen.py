"""Seeded generators with exact ground truth.

Random values derive from hashes of row numbers, so the rows don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def unit(seed: int, *parts: Column) -> Column:
    """A double in (0, 1) drawn by hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) + 0.5) / float(1 << 53)


def _name(prefix: str, width: int, c: Column) -> Column:
    return F.format_string(f"{prefix}%0{width}d", c)


def stream(spark: SparkSession, n_items: int, n_unique: int, seed: int = 0, distribution: str = "zipf", exponent: float = 1.2, prefix: str = "item-") -> DataFrame:
    """item: each of n_unique items once, the rest drawn by weight, in hash order of position."""
    if n_items < n_unique:
        raise ValueError("n_items must not be below n_unique")
    if distribution not in ("zipf", "uniform"):
        raise ValueError(f"unknown distribution {distribution!r}")
    u = unit(seed, F.col("id"))
    if distribution == "uniform":
        drawn = F.floor(u * n_unique)
    else:
        # the rank of a power law by inversion of its continuous form, which needs no table of weights
        top = (n_unique + 0.5) ** (1 - exponent) - 0.5 ** (1 - exponent)
        drawn = F.pow(u * top + 0.5 ** (1 - exponent), F.lit(1 / (1 - exponent))) - 0.5 if exponent != 1 else 0.5 * F.pow(F.lit(2.0 * n_unique + 1), u) - 0.5
        drawn = F.least(F.floor(drawn + 0.5), F.lit(n_unique - 1))
    rank = F.when(F.col("id") < n_unique, F.col("id")).otherwise(drawn).cast("bigint")
    return spark.range(n_items).select(_name(prefix, 8, rank).alias("item"))


def absent_items(spark: SparkSession, n: int, prefix: str = "absent-") -> DataFrame:
    return spark.range(n).select(_name(prefix, 9, F.col("id")).alias("item"))


def unique_items(spark: SparkSession, n: int, seed: int = 0, prefix: str = "user-") -> DataFrame:
    """id: n distinct names; their order carries no meaning."""
    return spark.range(n).select(_name(prefix, 9, F.col("id")).alias("id"))


def text_corpus(spark: SparkSession, n_docs: int, n_near_duplicates: int, doc_words: int = 60, edit_fraction: float = 0.04, vocabulary: int = 400, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) and the planted pairs (a, b): the last documents are edited copies of the first ones."""
    if n_near_duplicates > n_docs:
        raise ValueError("more copies than documents")
    originals = n_docs - n_near_duplicates
    of = F.when(F.col("id") >= originals, (F.col("id") - originals) % max(1, originals)).otherwise(F.col("id"))
    places = F.sequence(F.lit(0), F.lit(doc_words - 1))
    edits = max(1, round(doc_words * edit_fraction))

    def word(i: Column) -> Column:
        original = F.floor(unit(seed, of, i) * vocabulary)
        # the edited places are a run of strides from a drawn start
        step = F.pmod(i - F.floor(unit(seed + 1, F.col("id")) * doc_words).cast("int"), F.lit(doc_words))
        changed = (F.col("id") >= originals) & (step < edits)
        return F.concat(F.lit("word"), F.when(changed, F.floor(unit(seed + 2, F.col("id"), i) * vocabulary)).otherwise(original).cast("string"))

    docs = spark.range(n_docs).select(F.col("id").alias("doc_id"), F.array_join(F.transform(places, word), " ").alias("text"))
    pairs = spark.range(originals, n_docs).select(of.alias("a"), F.col("id").alias("b"))
    return docs, pairs


def categorical_table(spark: SparkSession, n_rows: int, n_categories: int, n_informative: int, noise: float = 0.3, seed: int = 0) -> DataFrame:
    """row_id, user_id, city, device, y: y is linear in the informative users, city and device, plus Gaussian noise."""
    user = F.floor(unit(seed, F.col("id"), F.lit(0)) * n_categories)
    city, device = F.floor(unit(seed, F.col("id"), F.lit(1)) * 20), F.floor(unit(seed, F.col("id"), F.lit(2)) * 3)
    normal = lambda *p: F.sqrt(-2 * F.log(unit(seed + 7, *p, F.lit(0)))) * F.cos(unit(seed + 7, *p, F.lit(1)) * 6.283185307179586)
    effect = lambda kind, c: normal(F.lit(kind), c)
    y = F.when(user < n_informative, 2 * effect("user", user)).otherwise(0) + effect("city", city) + effect("device", device) + noise * normal(F.lit("row"), F.col("id"))
    return spark.range(n_rows).select(
        F.col("id").alias("row_id"), _name("user-", 6, user).alias("user_id"), F.concat(F.lit("city-"), city.cast("string")).alias("city"),
        F.element_at(F.array(F.lit("desktop"), F.lit("mobile"), F.lit("tablet")), device.cast("int") + 1).alias("device"), y.alias("y"))


def sets_with_jaccard(spark: SparkSession, targets: list[float], size: int, seed: int = 0) -> DataFrame:
    """target, side (left, right), shingle: sets of ``size`` elements that share round(2 size J / (1 + J))."""
    out = None
    for t in targets:
        shared = min(size, max(0, round(2 * size * t / (1 + t))))
        left = spark.range(size).select(F.lit(t).alias("target"), F.lit("left").alias("side"), F.format_string(f"{seed} a %d", "id").alias("shingle"))
        right = spark.range(size).select(F.lit(t), F.lit("right"), F.when(F.col("id") < shared, F.format_string(f"{seed} a %d", "id")).otherwise(F.format_string(f"{seed} b %d", "id")))
        both = left.union(right)
        out = both if out is None else out.union(both)
    return out
