"""Quality classifier: importance resampling with hashed n-gram models.

Uni- and bigrams hash to buckets.  The raw model counts all documents, the target
model the labelled good ones; target counts are shrunk towards the raw model by
pseudo-counts, ``prior`` times as many as the target's n-grams.  A document's log weight is the log ratio of its
probabilities under the two; Gumbel noise keyed by doc_id and top-k make the kept
rows a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec
from .common import mapped, written


@dataclass(frozen=True)
class ResampleParams:
    """label_rows bounds the labelled rows that the target model is fitted on and that are broadcast.

    The share kept is that of good rows among the labels, plus margin.
    """

    buckets: int = 1 << 16
    prior: float = 2.0
    label_rows: int = 50_000
    margin: float = 0.02
    seed: int = 7


def _features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every uni- and bigram, and the words of each row."""
    h, at = textvec.words(texts)
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    follows = np.flatnonzero(row[1:] == row[:-1])
    pairs = textvec.mix64(h[follows] * np.uint64(textvec.WINDOW_BASE) + h[follows + 1])
    both = np.concatenate([h, pairs])
    return (both % np.uint64(buckets)).astype(np.int64), np.concatenate([row, row[follows]]), n


def _labels(labels: DataFrame, p: ResampleParams) -> tuple[DataFrame, float]:
    """(__id, __good) of a bounded, hash-ordered sample of labelled ids, and the good share of all labels.

    An id is good if each of its labels has quality 1; toxic ones stay out of the
    target model.  Labels with a null id or quality take no part.
    """
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    share = one.agg(F.avg((F.col("q") == 1).cast("double"))).first()[0]
    sample = one.orderBy(F.xxhash64("__id"), "__id").limit(p.label_rows).select("__id", ((F.col("q") == 1) & (F.col("t") == 0)).alias("__good"))
    return sample.where("__good"), 1.0 if share is None else share


def models(docs: DataFrame, good: DataFrame, p: ResampleParams) -> np.ndarray:
    """The log ratio of target and raw probability of each bucket."""
    buckets = p.buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            chosen = b.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for lo, hi in textvec.row_slices(b.column(0)):
                f, row, _ = _features(b.column(0).slice(lo, hi - lo), buckets)
                raw += np.bincount(f, minlength=buckets)
                target += np.bincount(f[chosen[lo:hi][row]], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, raw[seen], target[seen])], ["bucket", "raw", "target"])

    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text")).join(F.broadcast(good), "__id", "left").select("text", "__good")
    # one row a bucket: at most ``buckets`` of them
    out = mapped(rows, count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[out["bucket"]], target[out["bucket"]] = out["raw"], out["target"]
    if not raw.sum() or not target.sum():
        return np.zeros(buckets)
    q, mass = raw / raw.sum(), p.prior * target.sum()
    ratio = np.log((target + mass * q) / (target.sum() + mass), where=raw > 0, out=np.zeros(buckets))
    return ratio - np.log(q, where=raw > 0, out=np.zeros(buckets))


def weights(docs: DataFrame, labels: DataFrame, p: ResampleParams = ResampleParams()) -> tuple[DataFrame, float]:
    """docs plus __words, __weight and __key = weight + Gumbel noise; and the share to keep."""
    good, share = _labels(labels, p)
    ratio, buckets = models(docs, written(good, "good"), p), p.buckets

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in textvec.row_slices(b.column(1)):
                f, row, n = _features(b.column(1).slice(lo, hi - lo), buckets)
                w = np.bincount(row, ratio[f], minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(n), pa.array(w)], ["doc_id", "__digest", "__words", "__weight"])

    text = F.col("text").cast("string")
    out = mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("__digest")), score, "doc_id long, __digest long, __words long, __weight double")
    noise = -F.log(-F.log((F.shiftrightunsigned(F.xxhash64(F.lit(p.seed), "doc_id", "__digest"), 11) + 0.5) / float(1 << 53)))
    return out.withColumn("__key", F.col("__weight") + noise), min(1.0, share + p.margin)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """The exact k-th largest value of a double column, by histograms narrowed around it."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if k <= 0 or low is None:
        return float("inf")
    above, rows = 0, df
    while low < high:
        step = (high - low) / bins
        at = F.least(F.floor((F.col(column) - low) / step), F.lit(bins - 1)).cast("int")
        found = rows.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("at")).collect()  # at most ``bins`` rows
        for r in found:
            if above + r["n"] >= k:
                break
            above += r["n"]
        low, high = r["low"], r["high"]
        rows = rows.where((F.col(column) >= low) & (F.col(column) <= high))
        if r["n"] <= few and low < high:
            return sorted((x[0] for x in rows.select(column).collect()), reverse=True)[k - above - 1]
    return low


def resampled(docs: DataFrame, labels: DataFrame, p: ResampleParams = ResampleParams()) -> DataFrame:
    """(doc_id, n_words, log_weight, key, digest) of the kept rows.

    k is the rounded share of the rows of docs; the k largest keys stay, and rows whose
    key equals the k-th stay with it (copies under one doc_id have one key).  Empty
    and null texts weigh 0; a null doc_id only loses its noise of its own.  Without
    labels all rows stay.
    """
    scored, share = weights(docs, labels, p)
    scored = written(scored, "weights")
    least = kth_largest(scored, "__key", round(share * scored.count()))
    return scored.where(F.col("__key") >= least).select("doc_id", F.col("__words").alias("n_words"), F.col("__weight").alias("log_weight"), F.col("__key").alias("key"), F.col("__digest").alias("digest"))


def kept(docs: DataFrame, labels: DataFrame, p: ResampleParams = ResampleParams()) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns.

    A row is kept by its doc_id and text, as resampled() says: repeated rows stay or go
    together, rows that share a doc_id with other texts each by their own weight, rows
    without a doc_id by their text, and null and empty texts by their noise alone.
    """
    ids = resampled(docs, labels, p).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__digest"))
    return docs.join(ids, same, "left_semi")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, log_weight of the kept documents."""
    return resampled(docs, labels).select("doc_id", "n_words", F.round("log_weight", 6).alias("log_weight"))
