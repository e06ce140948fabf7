"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are dealt to shells of similar norm and lifted onto their shell's sphere (one
more coordinate evens out the norms, so the largest inner product is the smallest
angle), turned by pseudo-rotations (sign flips and fast Hadamard transforms) and
assigned to the nearest signed axis.  Tables differ by rotation.  An index vector goes
to one bucket a table, a query to the ``probes`` buckets nearest it, and all that meet
in a bucket are compared exactly.

The number of buckets follows from the number of vectors.  Tables and probes are
calibrated: a bounded sample of queries is answered exactly, and the cheapest setting
that finds ``target`` of the answers is taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import mapped, solved, written


@dataclass(frozen=True)
class CrossPolytopeParams:
    """axes: coordinates kept of a rotation (2 * axes signed ones); depth: axes joined to a bucket.

    axes and depth 0: chosen so that a bucket holds about ``bucket_rows`` vectors, but for
    at least 128 buckets.  tables and probes 0: calibrated to ``target`` on ``sample``
    queries, with max_tables and max_probes at most; where these don't do, the buckets
    are made coarser until they do.  Buckets are shuffled in groups of about group_rows;
    a group of more than block_rows index vectors, or queries, is dealt to blocks.
    Shells are shell_ratio wide, from the largest norm down; the last holds the rest.
    """

    k: int = 20
    target: float = 0.95
    sample: int = 128
    tables: int = 0
    probes: int = 0
    axes: int = 0
    depth: int = 0
    max_tables: int = 8
    max_probes: int = 4096
    bucket_rows: int = 64
    group_rows: int = 16_384
    block_rows: int = 20_000
    shells: int = 16
    shell_ratio: float = 1.2
    seed: int = 5

    @property
    def buckets(self) -> int:
        return (2 * self.axes) ** self.depth


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of the rows, in steps of up to 16 places; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        step = min(16, n // h)
        block = np.ones((1, 1))
        while len(block) < step:
            block = np.block([[block, block], [block, -block]])
        x = np.matmul(block, x.reshape(len(x), n // (step * h), step, h)).reshape(len(x), n)
        h *= step
    return x / np.sqrt(n)


def rotations(x: np.ndarray, table: int, p: CrossPolytopeParams) -> Iterator[np.ndarray]:
    """The kept coordinates of each of the table's rotations of the rows."""
    width = 1 << max(int(np.ceil(np.log2(max(2, x.shape[1])))), int(np.ceil(np.log2(p.axes))))
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    for level in range(p.depth):
        signs, y = np.random.RandomState([p.seed, table, level]), padded
        for _ in range(3):
            y = hadamard(y * signs.choice([-1.0, 1.0], width))
        yield y[:, : p.axes]


def buckets(x: np.ndarray, table: int, p: CrossPolytopeParams, probes: int) -> np.ndarray:
    """(rows, probes): the buckets nearest each row, nearest first."""
    keys, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for y in rotations(x, table, p):
        both = np.concatenate((y, -y), 1)
        if probes == 1:
            near = both.argmax(1)[:, None]
        else:
            near = np.argsort(-both, 1, kind="stable")[:, : min(probes, both.shape[1])]
        far = both.max(1, keepdims=True) - np.take_along_axis(both, near, 1)
        # both lists ascend, so the pair (i, j) has (i + 1) (j + 1) - 1 pairs before it
        i, j = np.nonzero(np.outer(np.arange(1, cost.shape[1] + 1), np.arange(1, near.shape[1] + 1)) <= probes)
        cost, keys = cost[:, i] + far[:, j] ** 2, keys[:, i] * (2 * p.axes) + near[:, j]
        best = np.argsort(cost, 1, kind="stable")[:, :probes]
        cost, keys = np.take_along_axis(cost, best, 1), np.take_along_axis(keys, best, 1)
    return keys


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed component by component, so that they depend on nothing else."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def best_of(queries: np.ndarray, wanted: list[np.ndarray], ids: np.ndarray, fine: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query's index, id, score) arrays of the k nearest ids in the ``wanted`` buckets of each query, ties to the smaller id."""
    order = np.lexsort((ids, fine))
    ids, fine, vectors = ids[order], fine[order], vectors[order]
    names, begin = np.unique(fine, return_index=True)
    end = np.append(begin[1:], len(fine))
    room = 1e-12 * np.sqrt((vectors**2).sum(1).max(initial=0.0))
    norms = np.sqrt((queries**2).sum(1))
    step = max(1, 2_000_000 // max(1, len(ids)))
    for at in range(0, len(queries), step):
        q, lists = queries[at : at + step], wanted[at : at + step]
        asked, who = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        by = np.argsort(asked, kind="stable")
        asked, who = asked[by], who[by]
        s = np.full((len(q), len(ids)), -np.inf)
        for name, x, y in zip(names, begin, end):
            mine = who[np.searchsorted(asked, name) : np.searchsorted(asked, name, "right")]
            if len(mine):
                s[mine, x:y] = q[mine] @ vectors[x:y].T
        least = -np.inf
        if s.shape[1] > k:  # the products of a block may differ in the last bits: a little room, and exact products after
            least = -np.partition(-s, k - 1, 1)[:, k - 1 : k] - room * norms[at : at + step, None]
        row, col = np.nonzero((s >= least) & (s > -np.inf))
        value = np.concatenate([np.zeros(0), *(products(q[row[i : i + 65_536]], vectors[col[i : i + 65_536]]) for i in range(0, len(row), 65_536))])
        by = np.lexsort((ids[col], -value, row))
        row, one, value = row[by], ids[col[by]], value[by]
        if len(np.unique(ids)) < len(ids):  # an id of several vectors counts once
            first = np.sort(np.unique(np.stack((row, one)), axis=1, return_index=True)[1])
            row, one, value = row[first], one[first], value[first]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield row[keep] + at, one[keep], value[keep]


def _usable(vectors: DataFrame) -> tuple[DataFrame, int, str]:
    """(vec_id, v, h, g) of the vectors that take part, h and g their digest; their dimension and component type."""
    kind = "double" if "double" in dict(vectors.dtypes)["embedding"] else "float"
    v = F.col("embedding").cast(f"array<{kind}>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    d = sizes["d"] if sizes else 0
    return rows.where(F.size("v") == d).select("vec_id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")), d, kind


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)


def _packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Binary values of the runs of a flat array."""
    raw = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer((edges * raw.itemsize).astype(np.int64)), pa.py_buffer(raw)])


class Space:
    """How vectors of d components are placed: shells up to the largest norm squared, and the shells in use."""

    def __init__(self, d: int, top: float, there: np.ndarray, p: CrossPolytopeParams) -> None:
        self.d, self.top, self.there, self.p = d, top, there, p

    def shell_of(self, norm: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.clip(0.5 * np.log(self.top / norm) / np.log(self.p.shell_ratio), 0, self.p.shells - 1).astype(np.int64)

    def index_keys(self, x: np.ndarray, table: int, p: CrossPolytopeParams) -> np.ndarray:
        norm = (x * x).sum(1)
        limit = self.top / p.shell_ratio ** (2 * self.shell_of(norm))
        return buckets(np.concatenate((x, np.sqrt(np.maximum(0, limit - norm))[:, None]), 1), table, p, 1)[:, 0]

    def query_keys(self, x: np.ndarray, table: int, p: CrossPolytopeParams, probes: int) -> np.ndarray:
        return buckets(np.concatenate((x, np.zeros((len(x), 1))), 1), table, p, probes)


def geometry(n: int, p: CrossPolytopeParams, coarser: int = 0) -> CrossPolytopeParams:
    """p with axes and depth for n vectors, the number of buckets halved ``coarser`` times."""
    if p.axes and p.depth:
        return p
    bits = max(1, max(7, math.ceil(math.log2(max(2, n) / p.bucket_rows))) - coarser)
    depth = -(-bits // 7)
    return replace(p, axes=1 << max(0, -(-bits // depth) - 1), depth=depth)


def calibrated(index: DataFrame, queries: DataFrame, n: int, space: Space, p: CrossPolytopeParams) -> CrossPolytopeParams:
    """p with axes, depth, tables and probes for the n rows of index (vec_id, v).

    The sample is the ``sample`` queries of the smallest hash; they scan the index, and
    the driver sees k + 1 rows a query.  Cost: inner products, copies of vectors at 32 of
    them, and answers of a group, each of k + 1 rows, at 16.
    """
    if p.tables and p.probes:
        return geometry(n, p)
    d, k = space.d, p.k + 1
    chosen = queries.orderBy(F.xxhash64("h", "g"), "h", "g").limit(p.sample).select("vec_id", "v").collect()
    q = np.array([r["v"] for r in chosen], np.float64).reshape(-1, d)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, ids, rows = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0, d))
        for b in batches:
            x, own = _matrix(b.column(1), d), b.column(0).to_numpy()
            for at in range(0, len(x), 8192):
                s = q @ x[at : at + 8192].T
                top = np.argpartition(-s, k, 1)[:, :k] if s.shape[1] > k else np.broadcast_to(np.arange(s.shape[1]), s.shape)
                score = np.concatenate((score, np.take_along_axis(s, top, 1)), 1)
                ids, rows = np.concatenate((ids, own[at : at + 8192][top]), 1), np.concatenate((rows, x[at : at + 8192][top]), 1)
                if score.shape[1] > k:
                    top = np.argpartition(-score, k, 1)[:, :k]
                    score, ids, rows = np.take_along_axis(score, top, 1), np.take_along_axis(ids, top, 1), np.take_along_axis(rows, top[:, :, None], 1)
        m = score.size
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), score.shape[1]).astype(np.int32)), pa.array(score.ravel()), pa.array(ids.ravel()), _packed(rows.ravel(), np.arange(m + 1) * d).cast(pa.binary())], ["q", "score", "vec_id", "v"])

    found = mapped(index.select("vec_id", "v"), scan, "q int, score double, vec_id long, v binary")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    near = [r for r in found.withColumn("place", place).where(F.col("place") <= k).collect() if r["vec_id"] != chosen[r["q"]]["vec_id"] and r["place"] <= k]
    if not near:
        return replace(geometry(n, p), tables=1, probes=1)
    asked = np.array([r["q"] for r in near])
    x = np.stack([np.frombuffer(r["v"], np.float64) for r in near])
    every = n / max(1, queries.count())
    for coarser in range(64):
        g = geometry(n, p, coarser)
        most = min(g.buckets, p.max_probes)
        ranks, best = np.full(len(x), most), None
        for table in range(p.tables or p.max_tables):
            probes, mine = space.query_keys(q, table, g, most), space.index_keys(x, table, g)
            at = probes[asked] == mine[:, None]
            ranks = np.minimum(ranks, np.where(at.any(1), at.argmax(1), most))
            need, tables = int(np.sort(ranks)[math.ceil(p.target * len(ranks)) - 1]) + 1, table + 1
            if need <= most and tables >= p.tables and tables.bit_count() == 1 or tables == p.tables:
                groups = min(need, max(1, n // p.group_rows))
                cost = tables * (min(need, g.buckets) * n / g.buckets + (32 + 16 * k) * groups + 32 * every)
                if need <= most and (best is None or cost < best[0]):
                    best = (cost, tables, need)
        if best or g.axes == p.axes or g.buckets <= 2:
            return replace(g, tables=best[1] if best else p.max_tables, probes=p.probes or (best[2] if best else most))
    raise AssertionError("two buckets are always enough")


def nearest(vectors: DataFrame, every: int = 20, p: CrossPolytopeParams = CrossPolytopeParams()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of the vectors whose vec_id is divisible by ``every``.

    Nearness is the inner product of the original vectors in double precision, summed in
    order of the components; ties go to the smaller vec_id.  A query that meets fewer
    than k candidates in its buckets is compared with all vectors.  Null, zero and
    non-finite vectors and null ids take no part, nor do vectors of another dimension
    than the most common.  A vec_id names a row: rows that share one, with the same
    vector or others, are one query and one candidate, whose score is the largest of
    the pairs that met.  No rows: no rows.

    Equal vectors are searched for once, and of their rows only the k + 1 smallest ids
    can be among any k nearest, so that copies don't fill buckets.
    """
    spark = vectors.sparkSession
    rows, d, kind = _usable(vectors)
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    k, digest_ = p.k + 1, ["h", "g"]
    many = written(rows.groupBy(*digest_).agg(F.count("*").alias("n")).where(F.col("n") > k).select(*digest_), "many")
    first = F.row_number().over(Window.partitionBy(*digest_).orderBy("vec_id"))
    copies = rows.join(many, digest_, "left_semi").dropDuplicates(["vec_id", *digest_]).withColumn("place", first).where(F.col("place") <= k).drop("place")
    index = written(rows.join(many, digest_, "left_anti").unionByName(copies), "vectors")
    asked = written(rows.where(F.col("vec_id") % every == 0).select("vec_id", *digest_).distinct(), "asked")
    queries = written(rows.where(F.col("vec_id") % every == 0).groupBy(*digest_).agg(F.min("vec_id").alias("vec_id"), F.first("v").alias("v")), "queries")

    dot = F.aggregate(F.transform("v", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x)
    top, n, least = index.agg(F.max(dot), F.count("*"), F.count_distinct("vec_id")).first()
    space = Space(d, top, np.zeros(0, np.int64), p)

    def shells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.unique(np.concatenate([np.zeros(0, np.int64), *(space.shell_of((_matrix(b.column(0), d) ** 2).sum(1)) for b in batches)]))
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32))], ["s"])

    there = np.array([r["s"] for r in mapped(index.select("v"), shells, "s int").distinct().collect()], np.int64)  # at most ``shells`` rows
    space = Space(d, top, there, p)
    g = calibrated(index, queries, n, space, p)
    number = np.float64 if kind == "double" else np.float32
    per = max(1, g.buckets // (1 << max(0, int(math.log2(max(1, n // p.group_rows))))))  # buckets a group

    def index_rows(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(table, bucket, shell) of a batch's index vectors."""
        x = _matrix(b.column(1), d)
        shell = space.shell_of((x * x).sum(1))
        for t in range(g.tables):
            yield t, space.index_keys(x, t, g), shell

    def query_rows(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(table, row, group, place in the sorted buckets) of each group that a query probes, the sorted buckets last."""
        x = _matrix(b.column(1), d)
        for t in range(g.tables):
            keys = np.sort(space.query_keys(x, t, g, g.probes), 1)
            new = np.ones(keys.shape, bool)
            new[:, 1:] = keys[:, 1:] // per != keys[:, :-1] // per
            row, at = np.nonzero(new)
            yield t, row, keys[row, at] // per, np.append(row * keys.shape[1] + at, keys.size), keys.ravel()

    def count_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, key, _ in index_rows(b):
                yield counted(t, key // per, False)

    def query_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 1_000_000 // g.probes // max(1, len(there)))
        for b in batches:
            yield from (b.slice(start, step) for start in range(0, b.num_rows, step))

    def count_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in query_slices(batches):
            for t, _, group, _, _ in query_rows(b):
                yield counted(t, group, True)

    def counted(t: int, group: np.ndarray, query: bool) -> pa.RecordBatch:
        names, many_ = np.unique(group, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(names), t, np.int32)), pa.array(names), pa.array(np.full(len(names), query)), pa.array(many_)], ["t", "grp", "query", "n"])

    size = "t int, grp long, query boolean, n long"
    counts = mapped(index.select("vec_id", "v"), count_index, size).unionByName(mapped(queries.select("vec_id", "v"), count_queries, size)).groupBy("t", "grp")
    blocks = lambda query: F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("query") == query, F.col("n"))) / p.block_rows)).cast("int")
    large = written(counts.agg(blocks(False).alias("blocks"), blocks(True).alias("parts")).where("blocks > 1 OR parts > 1"), "large-groups")

    schema = "t int, grp long, query boolean, vec_id long, h long, g long, at binary, v binary"
    names = ["t", "grp", "query", "vec_id", "h", "g", "at", "v"]

    def vector_bytes(b: pa.RecordBatch) -> pa.Array:
        return _packed(_matrix(b.column(1), d).astype(number).ravel(), np.arange(b.num_rows + 1) * d).cast(pa.binary())

    def spread_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, m = vector_bytes(b), b.num_rows
            for t, key, shell in index_rows(b):
                at = _packed(key * p.shells + shell, np.arange(m + 1)).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, t, np.int32)), pa.array(key // per), pa.array(np.zeros(m, bool)), b.column(0), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), at, v], names)

    def spread_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in query_slices(batches):
            v = vector_bytes(b)
            for t, row, group, edges, keys in query_rows(b):
                at, take = _packed((keys[:, None] * p.shells + there).ravel(), edges * len(there)).cast(pa.binary()), pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), t, np.int32)), pa.array(group), pa.array(np.ones(len(row), bool)), b.column(0).take(take), b.column(2).take(take), b.column(3).take(take), at, v.take(take)], names)

    def rank(group: pa.Table) -> pa.Table:
        query = group["query"].to_numpy()
        v = np.frombuffer(b"".join(group["v"].to_pylist()), number).reshape(-1, d).astype(np.float64)
        at = [np.frombuffer(x, np.int64) for x in group["at"].to_pylist()]
        asks, holds = np.flatnonzero(query), np.flatnonzero(~query)
        found = list(best_of(v[asks], [at[i] for i in asks], group["vec_id"].to_numpy()[holds], np.array([at[i][0] for i in holds]), v[holds], k)) if len(asks) and len(holds) else []
        row, one, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        who = pa.array(asks[row])
        return pa.table({"h": group["h"].take(who), "g": group["g"].take(who), "vec_id": pa.array(one), "score": pa.array(score)})

    result = "h long, g long, vec_id long, score double"

    def answers(sides: DataFrame) -> DataFrame:
        """The k nearest of each vector that is asked for, and one more: a query isn't its own neighbour."""
        found = solved(sides, ["t", "grp", "block"], rank, result)
        once = found.groupBy(*digest_, "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("place", F.row_number().over(Window.partitionBy(*digest_).orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k).drop("place")

    def best(found: DataFrame) -> DataFrame:
        each = asked.withColumnRenamed("vec_id", "query_id").join(found, digest_).where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return each.withColumn("rank", place).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")

    def dealt(sides: DataFrame) -> DataFrame:
        """sides with a block for each pair of pieces that a row takes part in; pieces by the row's hash."""
        piece = lambda m: F.pmod(F.xxhash64("vec_id", "h"), F.col(m).cast("long")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("blocks")).otherwise(F.col("parts")) - 1))
        block = F.when(F.col("query"), F.col("other") * F.col("parts") + piece("parts")).otherwise(piece("blocks") * F.col("parts") + F.col("other"))
        return sides.withColumn("other", other).withColumn("block", block).drop("other", "blocks", "parts")

    sides = mapped(index.select("vec_id", "v"), spread_index, schema).unionByName(mapped(queries.select("vec_id", "v", *digest_), spread_queries, schema))
    one = lambda c: F.coalesce(F.col(c), F.lit(1)).alias(c)
    sides = sides.join(large, ["t", "grp"], "left").select(*names, one("blocks"), one("parts"))
    found = written(best(written(answers(dealt(sides)), "answers")), "neighbours")
    want = min(p.k, least - 1)
    have = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"))
    short = written(asked.join(have, "vec_id", "left").where(F.coalesce("n", F.lit(0)) < want).select(*asked.columns), "short")
    few = short.select("vec_id").distinct().count()
    if not few or want < 1:
        return found
    # exact: blocks of all vectors against blocks of the short queries, in one bucket
    bound = [F.lit(-(-n // p.block_rows)).alias("blocks"), F.lit(-(-few // p.block_rows)).alias("parts")]
    zero, raw = F.lit(bytes(8)).alias("at"), F.col("v")
    all_ = index.select(F.lit(0).alias("t"), F.lit(0).cast("long").alias("grp"), F.lit(False).alias("query"), "vec_id", F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("g"), zero, raw, *bound)
    mine = queries.join(short.select(*digest_).distinct(), digest_, "left_semi").select(F.lit(0).alias("t"), F.lit(0).cast("long").alias("grp"), F.lit(True).alias("query"), "vec_id", *digest_, zero, raw, *bound)

    def scan(group: pa.Table) -> pa.Table:
        flat = np.concatenate([np.asarray(x, number) for x in group["v"].to_pylist()])
        return rank(group.set_column(group.schema.get_field_index("v"), "v", _packed(flat, np.arange(group.num_rows + 1) * d)))

    rest = solved(dealt(all_.unionByName(mine)), ["t", "grp", "block"], scan, result)
    alone = short.withColumnRenamed("vec_id", "query_id").join(rest, digest_).where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    alone = alone.withColumn("rank", place).where(F.col("rank") <= p.k)
    return found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(alone.select(*found.columns))


def digest(vectors: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score."""
    return nearest(vectors).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
