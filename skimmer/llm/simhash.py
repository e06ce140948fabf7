"""SimHash near-duplicates: exact pairs of fingerprints by vantage-point trees.

Fingerprints are first reduced to distinct values.  A vantage-point tree fitted on a
bounded, hash-ordered sample deals them to shards: at a node with vantage point p
and radius m, values with d(p, x) <= m go inside, others outside, and those with
m < d <= m + r, whose partners may be inside, are copied inside as well; the triangle
inequality makes every pair within r meet in a shard.  A shard continues the same
recursion in memory down to small blocks compared directly.  A node that no vantage
point can divide (a dense ball of near copies) is solved exactly through shared
one-bit neighbours, in time linear in its size (for r = 2).  Shards return spanning
stars, never all pairs, and components are joined in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from . import textvec
from .common import bounded, connected_components, discard, mapped, written

BLOCK = 512


@dataclass(frozen=True)
class SimHashParams:
    """max_shards bounds the tree and sample_per_shard * max_shards the sample sent to the driver.

    Beyond max_shards * shard_rows distinct values shards grow; each is 8 bytes a value in one task.
    """

    shingle: int = 3
    seed: int = 42
    radius: int = 2
    shard_rows: int = 20_000
    sample_per_shard: int = 64
    max_shards: int = 65_536


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint; a bit is set if it is set in over half the shingles' XXH64."""
    words = textvec.word_bytes(text)
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    ends, one, count, n = ends[shingle - 1 :].tolist(), xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 8192):
        h = np.fromiter((one(joined[s:e], seed) for s, e in zip(starts[at : at + 8192], ends[at : at + 8192])), np.uint64, min(8192, n - at))
        count += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """(doc_id, digest, fp): the signed fingerprint of each row's whole text, and the text's XXH64."""
    shingle, seed = p.shingle, p.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "digest", "fp"])

    text = F.col("text").cast("string")
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text")), run, "doc_id long, digest long, fp long")


def _divide(fps: np.ndarray, radius: int, tries: int = 8) -> tuple[np.uint64, int] | None:
    """The vantage point and radius that leave the smallest larger side, or None if none divides."""
    best, n = (0.9, None), len(fps)
    for vp in fps[np.linspace(0, n - 1, min(tries, n)).astype(int)]:
        upto = np.cumsum(np.bincount(np.bitwise_count(fps ^ vp), minlength=65 + radius))
        for m in range(64):
            cost = max(upto[m + radius], n - upto[m]) / n
            if cost < best[0]:
                best = (cost, (vp, m))
    return best[1]


@dataclass
class Tree:
    """Node i: vp, radius, children; a leaf has inside = -1, its shard in outside and its density."""

    vp: list
    mid: list
    inside: list
    outside: list
    dense: list

    @classmethod
    def fit(cls, sample: np.ndarray, shards: int, radius: int) -> Tree:
        out, small = cls([], [], [], [], []), max(1, len(sample) // max(1, shards))
        leaves = 0

        def add(fps: np.ndarray, depth: int) -> int:
            nonlocal leaves
            at = len(out.vp)
            for x in (out.vp, out.mid, out.inside, out.outside, out.dense):
                x.append(0)
            cut = _divide(fps, radius) if shards > 1 and len(fps) > 1.5 * small and depth < 40 else None
            if cut is None:
                out.inside[at], out.outside[at], out.dense[at] = -1, leaves, int(len(fps) > 8 * small)
                leaves += 1
            else:
                d = np.bitwise_count(fps ^ cut[0])
                out.vp[at], out.mid[at] = int(cut[0]), int(cut[1])
                out.inside[at] = add(fps[d <= cut[1] + radius], depth + 1)
                out.outside[at] = add(fps[d > cut[1]], depth + 1)
            return at

        add(sample, 0)
        return out

    def deal(self, fps: np.ndarray, radius: int) -> Iterator[tuple[int, bool, np.ndarray]]:
        """(shard, dense, indices) of the shards that fps fall into."""
        todo = [(0, np.arange(len(fps)))]
        while todo:
            at, index = todo.pop()
            if not len(index):
                continue
            if self.inside[at] < 0:
                yield self.outside[at], bool(self.dense[at]), index
                continue
            d = np.bitwise_count(fps[index] ^ np.uint64(self.vp[at]))
            todo += [(self.inside[at], index[d <= self.mid[at] + radius]), (self.outside[at], index[d > self.mid[at]])]


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent after linking a[i] with b[i]; every entry points at its root."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def _shared_neighbour(fps: np.ndarray, index: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of values within two bits: both are within one bit of some common value."""
    flips = np.concatenate(([0], np.uint64(1) << np.arange(64, dtype=np.uint64))).astype(np.uint64)
    rounds = max(1, len(index) * 65 // 4_000_000)
    for k in range(rounds):
        keys = fps[index][:, None] ^ flips
        who = np.broadcast_to(index[:, None], keys.shape)
        if rounds > 1:
            here = textvec.mix64(keys) % np.uint64(rounds) == k
            keys, who = keys[here], who[here]
        keys, who = keys.ravel(), who.ravel()
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        yield who[order][1:][same], who[order][:-1][same]


def stars(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, smallest value of its component) over all pairs of fps within radius bits."""
    fps = np.unique(fps)
    parent, todo, held, waiting = np.arange(len(fps)), [np.arange(len(fps))], [], 0
    while todo:
        index = todo.pop()
        found: list | Iterator = []
        if len(index) <= BLOCK:
            near = np.bitwise_count(fps[index][:, None] ^ fps[index]) <= radius
            i, j = np.nonzero(np.triu(near, 1))
            found = [(index[i], index[j])]
        elif (cut := _divide(fps[index], radius)) is not None:
            d = np.bitwise_count(fps[index] ^ cut[0])
            todo += [index[d <= cut[1] + radius], index[d > cut[1]]]
        elif radius == 2:
            found = _shared_neighbour(fps, index)
        else:
            found = ((index[at + i], index[j]) for at in range(0, len(index), BLOCK) for i, j in [np.nonzero(np.bitwise_count(fps[index[at : at + BLOCK]][:, None] ^ fps[index]) <= radius)])
        for pair in found:
            held.append(pair)
            waiting += len(pair[0])
            if waiting > 1_000_000:
                parent, held, waiting = _join(parent, *map(np.concatenate, zip(*held))), [], 0
    if held:
        parent = _join(parent, *map(np.concatenate, zip(*held)))
    # fps are in unsigned order; components are named by the smallest signed value
    signed = fps.view(np.int64)
    name = np.full(len(fps), np.iinfo(np.int64).max)
    np.minimum.at(name, parent, signed)
    moved = name[parent] != signed
    return signed[moved], name[parent][moved]


def linked(distinct: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """(a, b): edges over the distinct fingerprints ``fp`` whose components are those of all pairs within the radius."""
    radius, n = p.radius, distinct.count()
    shards = int(min(p.max_shards, max(1, -(-n // p.shard_rows))))
    sample = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(shards * p.sample_per_shard).toPandas()["fp"].to_numpy(np.int64).view(np.uint64) if shards > 1 else np.zeros(1, np.uint64)
    tree = Tree.fit(sample, shards, radius)
    parts = max(1, n * 65 // 2_000_000)
    flips = np.concatenate(([0], np.uint64(1) << np.arange(64, dtype=np.uint64))).astype(np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for shard, dense, index in tree.deal(fps, radius):
                mine, key, to = fps[index], np.zeros(len(index), np.uint64), np.full(len(index), shard * (parts + 1), np.int64)
                if dense and radius == 2:
                    key = (mine[:, None] ^ flips).ravel()
                    mine, to = np.repeat(mine, 65), shard * (parts + 1) + 1 + (textvec.mix64(key) % np.uint64(parts)).astype(np.int64)
                for at in range(0, len(mine), 100_000):
                    cut = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(to[cut]), pa.array(mine[cut].view(np.int64)), pa.array(key[cut].view(np.int64))], ["shard", "fp", "key"])

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] % (parts + 1):  # one-bit neighbours of a dense shard: equal keys link
            rows = rows.sort_values(["key", "fp"], ignore_index=True)
            first = rows.groupby("key")["fp"].transform("first").to_numpy()
            a, b = rows["fp"].to_numpy()[(apart := first != rows["fp"].to_numpy())], first[apart]
        else:
            a, b = stars(rows["fp"].to_numpy(np.int64).view(np.uint64), radius)
        return pd.DataFrame({"a": a, "b": b})

    return mapped(distinct.select("fp"), deal, "shard long, fp long, key long").groupBy("shard").applyInPandas(solve, "a long, b long")


def _grouped(docs: DataFrame, p: SimHashParams) -> DataFrame:
    """(doc_id, digest, fp, component_id, group): group is a fingerprint that names the component."""
    marks = written(fingerprints(docs, p), "fingerprints")
    distinct = written(marks.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    return _labelled(marks, distinct, linked(distinct, p))


def named(marks: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, digest, fp, component_id, group) of marks (doc_id, digest, fp) by the components of edges (a, b) over fp."""
    return _labelled(marks, written(marks.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct"), edges)


def _labelled(marks: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    groups = written(connected_components(edges), "components")
    # one row a component, and the rows of a large component stay where they are if that is few
    named = written(groups.join(distinct, groups["node"] == distinct["fp"]).groupBy("component").agg(F.min("low").alias("lowest")), "named")
    label = (
        distinct.join(groups, distinct["fp"] == groups["node"], "left").join(bounded(named), "component", "left")
        .select("fp", F.coalesce("component", "fp").alias("group"), F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("lowest")).alias("component_id"))
    )
    labels = written(label, "labels")
    discard(groups, named, distinct)
    return marks.join(labels, "fp").select("doc_id", "digest", "fp", "component_id", "group")


def components(docs: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """(doc_id, fp, component_id): one row a row of docs.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the
    smallest doc_id reachable, the row's own included.  Empty and null texts have
    fingerprint zero and link like others.  Repeated rows each give a row; a null
    doc_id never names a component (component_id is null where all its doc_ids are).
    Only doc_id and text are read.  No rows: no rows.
    """
    return _grouped(docs, p).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """One row of each component, that of the smallest doc_id, with all columns of docs.

    Where several rows have that doc_id, the one with the smallest hash of its text
    stays.  Rows without a doc_id all stay: they can't be named.
    """
    return lowest(docs, _grouped(docs, p))


def lowest(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of docs that deduplicated() keeps, given their groups."""
    best = grouped.where("doc_id = component_id").groupBy("group").agg(F.min("doc_id").alias("__id"), F.min("digest").alias("__digest"))
    # the join and the window deal rows by the same columns, so that texts move once
    keyed = docs.withColumns({"__key": F.col("doc_id").cast("long"), "__text": F.xxhash64(F.col("text").cast("string"))})
    out = keyed.join(best.select("__id", "__digest").distinct(), (F.col("__key") == F.col("__id")) & (F.col("__text") == F.col("__digest")), "left_semi")
    order = F.row_number().over(Window.partitionBy("__key", "__text").orderBy("__text"))
    out = out.withColumn("__rank", order).where("__rank = 1").drop("__rank", "__key", "__text")
    return out.unionByName(docs.where(F.col("doc_id").isNull()))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 lowercase hex digits, component_id."""
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
