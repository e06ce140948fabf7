"""Near copies by exact shingle similarity: MinHash bands for candidates, sets for the verdict.

Texts are first reduced to distinct sets of shingles.  A set's ``bands`` keys of ``rows``
MinHash values each deal it to buckets; two sets of Jaccard similarity s share none with
probability (1 - s**rows)**bands, 3 in 100,000 at 0.8.  Buckets with the same members
count once.  Inside a bucket each set reached is compared with all that aren't yet, so
the links are those of all pairs though no pair becomes a row.  A large bucket is cut
into pieces of bounded size, and each two of them meet in a task.  SimHash comes
first, where a radius is given: sets whose fingerprints are linked within it meet like
members of a bucket, together with a few bands; of the other bands, which find what
lies beyond the radius, only buckets move whose members aren't linked by then.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import simhash, textvec
from .common import bounded, connected_components, discard, mapped, new_path, scope, written


@dataclass(frozen=True)
class NearCopyParams:
    """piece_shingles bounds the shingles of a piece of a bucket, as far as one text allows; first is how many bands come first.

    radius is that of the SimHash step, None without one.
    """

    shingle: int = 5
    threshold: float = 0.8
    bands: int = 20
    rows: int = 4
    first: int = 4
    seed: int = 42
    piece_shingles: int = 1_000_000
    radius: int | None = None


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all windows of a few rows at a time, and each row's first."""
    for a, b in textvec.row_slices(column):
        yield textvec.windows(*textvec.words(column.slice(a, b - a)), shingle)


def _node(shingles: np.ndarray) -> int:
    """The name of a set: the XXH64 of its sorted hashes."""
    return xxhash.xxh64_intdigest(shingles.tobytes())


def band_keys(h: np.ndarray, first: np.ndarray, p: NearCopyParams) -> np.ndarray:
    """Keys of the rows' bands; rows without shingles get some that mean nothing."""
    factors = np.random.default_rng(p.seed).integers(1, 1 << 63, (p.bands, p.rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, p.bands), np.uint64)
    for band in range(p.bands if len(full) else 0):
        key = np.full(len(full), band + 1, np.uint64)
        for factor in factors[band]:
            key = textvec.mix64(key ^ np.minimum.reduceat(h * factor, first[full]))
        out[full, band] = key
    return out


def fingerprint(shingles: np.ndarray) -> int:
    """The SimHash of a set of hashes: a bit is set if it is set in over half of them."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 8192):
        count += np.unpackbits(shingles[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(shingles), bitorder="little").view("<u8")[0])


def marks(docs: DataFrame, p: NearCopyParams = NearCopyParams()) -> DataFrame:
    """(doc_id, digest, fp, n, keys, sim): each row's set of shingles by name, size, bands and SimHash (0 without a radius), and its text's XXH64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes, keys, sims = [], [], [], []
            for h, first in shingle_sets(b.column(2), p.shingle):
                own = [np.unique(h[x:y]) for x, y in zip(first, first[1:])]
                names += map(_node, own)
                sizes += map(len, own)
                sims += map(fingerprint, own) if p.radius is not None else [0] * len(own)
                keys += [k if len(s) else [] for k, s in zip(band_keys(h, first, p).view(np.int64).tolist(), own)]
            columns = [b.column(0), b.column(1), pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(sims, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "fp", "n", "keys", "sim"])

    text = F.col("text").cast("string")
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text")), run, "doc_id long, digest long, fp long, n long, keys array<long>, sim long")


def sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(fp, shingles): the distinct shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, first in shingle_sets(b.column(0), shingle):
                own = [np.unique(h[x:y]) for x, y in zip(first, first[1:])]
                at = np.concatenate(([0], np.cumsum([len(s) for s in own])))
                lists = pa.LargeListArray.from_arrays(pa.array(at), pa.array(np.concatenate(own).view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.array([_node(s) for s in own], np.uint64).view(np.int64)), lists], ["fp", "shingles"])

    return mapped(texts.select("text"), run, "fp long, shingles array<long>")


def stars(names: np.ndarray, shingles: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (name, a name of its component) over all pairs of sets with a Jaccard similarity of the threshold or more."""
    sizes = np.array([len(s) for s in shingles])
    words, codes = np.unique(np.concatenate(shingles), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [codes[e - n : e] for e, n in zip(ends, sizes)]
    held, a, b = np.zeros(len(words), bool), [], []
    left, flat = np.arange(len(names)), codes
    while len(left) > 1:
        root, todo = left[0], [left[0]]
        left, flat = left[1:], flat[sizes[left[0]] :]
        while todo and len(left):
            at = todo.pop()
            held[own[at]] = True
            shared = np.add.reduceat(held[flat], np.cumsum(sizes[left]) - sizes[left], dtype=np.int64)
            held[own[at]] = False
            near = shared >= threshold * (sizes[at] + sizes[left] - shared) - 1e-9
            if near.any():
                found = left[near]
                a.append(names[found])
                b.append(np.full(len(found), names[root]))
                todo += found.tolist()
                flat = flat[np.repeat(~near, sizes[left])]
                left = left[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def linked(docs: DataFrame, rows: DataFrame, p: NearCopyParams = NearCopyParams()) -> DataFrame:
    """(a, b): edges over the sets of ``rows``, the marks of docs, whose components are those of all pairs in a bucket."""
    distinct = rows.groupBy("fp").agg(F.min_by("keys", "digest").alias("keys"), F.min_by("n", "digest").alias("n"), F.min_by("sim", "digest").alias("sim"), F.min("digest").alias("digest"))
    distinct = written(distinct, "shingle-sets")
    members = distinct.select("fp", "n", "digest", F.col("fp").alias("group"), F.explode(F.slice("keys", 1, p.first)).alias("key"))
    near = None
    if p.radius is not None:
        near = simhash_groups(distinct.where("n > 0"), p.radius)
        members = members.unionByName(distinct.join(near, "fp").select("fp", "n", "digest", F.col("fp").alias("group"), F.xxhash64(F.lit("simhash"), "near").alias("key")))
    one = _met(docs, members, p)
    groups = written(connected_components(one), "components")
    label = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", "n", "digest", F.coalesce("component", "fp").alias("group"), "keys")
    two = _met(docs, label.select("fp", "n", "digest", "group", F.explode(F.slice("keys", p.first + 1, p.bands)).alias("key")), p)
    discard(distinct, groups, near)
    return one.unionByName(two)


def simhash_groups(distinct: DataFrame, radius: int) -> DataFrame:
    """(fp, near): the sets (fp, sim) by the component of their fingerprints, which vantage-point trees link within the radius."""
    values = written(distinct.select(F.col("sim").alias("fp")).distinct(), "fingerprints")
    groups = written(connected_components(simhash.linked(values, simhash.SimHashParams(radius=radius))), "components")
    out = written(distinct.select("fp", "sim").join(groups, F.col("sim") == F.col("node"), "left").select("fp", F.coalesce("component", "sim").alias("near")), "near")
    discard(values, groups)
    return out


def _met(docs: DataFrame, members: DataFrame, p: NearCopyParams) -> DataFrame:
    """(a, b): edges among members (fp, n, digest, group, key) that meet under a key, as a written table. Buckets of one group have nothing to add."""
    size = (F.count("*").alias("size"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "fp")).alias("y"))
    buckets = members.groupBy("key").agg(*size, F.min("group").alias("low"), F.max("group").alias("high")).where("low < high")
    buckets = buckets.groupBy("size", "total", "x", "y").agg(F.min("key").alias("key"))
    pieces = F.ceil(F.col("total") / p.piece_shingles).cast("int")
    kept = written(members.join(buckets.select("key", pieces.alias("pieces")), "key"), "members")
    need = written(kept.select(F.col("digest").alias("__digest")).distinct(), "needed")
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64(F.col("text").cast("string")).alias("__digest"))
    known = written(sets(texts.join(bounded(need), "__digest", "left_semi"), p.shingle).dropDuplicates(["fp"]), "sets")
    mine = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    meet = kept.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    meet = meet.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp")
    threshold = p.threshold

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        a, b = stars(group["fp"].to_numpy(np.int64), [np.asarray(s) for s in group["shingles"]], threshold)
        return pd.DataFrame({"a": a, "b": b})

    out = written(meet.join(known, "fp").groupBy("key", "lo", "hi").applyInPandas(solve, "a long, b long"), "links")
    discard(kept, need, known)
    return out


def components(docs: DataFrame, p: NearCopyParams = NearCopyParams()) -> DataFrame:
    """(doc_id, fp, component_id): as simhash.components, but fp names the set of shingles, and sets link by their similarity."""
    return _grouped(docs, p).select("doc_id", "fp", "component_id")


def pages(docs: DataFrame, p: NearCopyParams = NearCopyParams()) -> DataFrame:
    """(page, group): the group of near copies of each distinct text, by the XXH64 of the text."""
    path = new_path(docs.sparkSession, "pages")
    with scope(docs.sparkSession):
        rows = _grouped(docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))), p)
        return written(rows.groupBy(F.col("digest").alias("page")).agg(F.min("group").alias("group")), path=path)


def _grouped(docs: DataFrame, p: NearCopyParams) -> DataFrame:
    rows = written(marks(docs, p), "marks")
    return simhash.named(rows.select("doc_id", "digest", "fp"), linked(docs, rows, p))


def deduplicated(docs: DataFrame, p: NearCopyParams = NearCopyParams()) -> DataFrame:
    """One row of each component, chosen as in simhash.deduplicated; texts without words are copies of each other."""
    return simhash.lowest(docs, _grouped(docs, p))
