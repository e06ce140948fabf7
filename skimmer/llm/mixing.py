"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's documents are dealt to shards of a bounded number of words and laid
end to end in seeded order; the shard is cut into blocks of ``block_words``.  The
blocks of the mix are allocated to sources, and a source's to its shards, by the
highest quotients v / (2 s + 1).  A shard with quota q of n blocks gives each of them
q // n times, and q % n of them, evenly spaced from a seeded start, once more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, written


@dataclass(frozen=True)
class MixParams:
    """weights go to the sources in code point order, null last, and repeat.

    The driver apportions one row a source and shard.  A shard has shard_words, or more
    where the corpus would else have over max_shards of them, so both stay bounded.
    """

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    repeats: int = 2
    block_words: int = 32
    shard_words: int = 250_000
    max_shards: int = 1_000_000
    seed: int = 11


def targets(sizes: list[int], weights: list[float], total: float, repeats: float) -> list[float]:
    """Shares of total in proportion to weights, none above repeats times its size; the excess is reshared."""
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0], float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > repeats * sizes[i]}
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in full]
    return out


def sainte_lague(votes: np.ndarray, limits: np.ndarray, seats: int | np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Seats by the highest quotients votes / (2 s + 1), none above its limit; ties go to the earlier.

    With group (0, 1, ... in order) each group has seats of its own; all are bisected at once.
    """
    votes, limits = np.asarray(votes, float), np.where(np.asarray(votes, float) > 0, limits, 0).astype(np.int64)
    if not len(votes):
        return np.zeros(0, np.int64)
    group = np.zeros(len(votes), int) if group is None else np.asarray(group, int)
    begin = np.flatnonzero(np.diff(group, prepend=-1))
    group = np.cumsum(np.diff(group, prepend=group[0]) != 0)
    total = lambda x: np.add.reduceat(x, begin)
    seats = np.minimum(np.broadcast_to(np.asarray(seats, np.int64), len(begin)), total(limits))

    def at_least(divisor: np.ndarray) -> np.ndarray:
        d = divisor[group]
        n = np.floor((votes / d + 1) / 2).astype(np.int64)
        for step in (1, -1):  # the floor may be off by one where a quotient equals the divisor
            more = n + (step == 1)
            ok = votes / np.maximum(2 * more - 1, 1) >= d
            n = np.where(ok if step == 1 else ~ok & (n > 0), n + step, n)
        return np.minimum(n, limits)

    some = np.where(votes > 0, votes, np.inf)
    low = np.minimum.reduceat(some, begin) / (4.0 * np.maximum.reduceat(limits, begin) + 4)
    high = np.maximum.reduceat(votes, begin) * 2
    low, high = np.where(np.isfinite(low), low, 1.0), np.where(high > 0, high, 2.0)
    for _ in range(200):
        mid = (low + high) / 2
        if not ((mid != low) & (mid != high)).any():
            break
        enough = total(at_least(mid)) >= seats
        low, high = np.where(enough, mid, low), np.where(enough, high, mid)
    out = at_least(high)  # fewer than seats; the rest have quotients of low, and tie
    rest = at_least(low) > out
    before = np.cumsum(rest) - rest
    out += rest & (before - before[begin][group] < (seats - total(out))[group])
    return np.where((seats > 0)[group], out, 0)


def sizes(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, *carry): the words of each whole text, null counting none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("size"), *carry)


def _order(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string")))


def mixed(docs: DataFrame, p: MixParams = MixParams(), carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, passes, begin, offset, quota, blocks, taken, *carry), one row a row of docs.

    carry: columns of docs that go along, as the text does where the mix is written.

    taken is the words the mix takes of the document, repeats counted: it is passes
    times the size, plus what the chosen blocks hold of its words (begin is the place of
    its first word in its shard).  Documents that share doc_id and size are
    interchangeable.  Documents without words take none; a source without words has
    target 0; a null source is a source, however many null or empty texts it has.  Repeated
    rows each count.  No rows: no rows.
    """
    spark = docs.sparkSession
    rows = written(sizes(docs), "sizes")
    found = sorted(rows.groupBy("source").agg(F.sum("size").alias("n")).limit(p.max_shards + 1).collect(), key=lambda r: (r["source"] is None, r["source"]))
    if len(found) > p.max_shards:
        raise ValueError(f"more than {p.max_shards} sources")
    weight, n = [p.weights[i % len(p.weights)] for i in range(len(found))], [r["n"] for r in found]
    goal = targets(n, weight, p.share * sum(n), p.repeats)
    words = max(p.shard_words, -(-sum(n) // p.max_shards))
    table = spark.createDataFrame([(i, r["source"], r["n"], goal[i], max(1, -(-r["n"] // words))) for i, r in enumerate(found)], "sid int, __source string, source_size long, target double, shards int")
    dealt = (sizes(docs, carry) if carry else rows).join(F.broadcast(table), F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("place", _order(p.seed))
    dealt = dealt.withColumn("shard", F.pmod(F.conv(F.substring("place", 1, 8), 16, 10).cast("long"), F.col("shards").cast("long")).cast("int"))

    shards = dealt.select("sid", "shard", "size").groupBy("sid", "shard").agg(F.sum("size").alias("n")).where("n > 0").toPandas().sort_values(["sid", "shard"], ignore_index=True)
    blocks = -(-shards["n"].to_numpy(np.int64) // p.block_words)
    limit = np.zeros(len(found), np.int64)
    np.add.at(limit, shards["sid"].to_numpy(int), p.repeats * blocks)
    quotas = sainte_lague(np.array(goal), limit, int(p.share * sum(n) / p.block_words + 0.5))
    shards["blocks"], shards["quota"] = blocks, 0
    if len(shards):
        shards["quota"] = sainte_lague(shards["n"].to_numpy(float), p.repeats * blocks, quotas[shards["sid"].unique()], shards["sid"].to_numpy())
    quota = spark.createDataFrame(list(shards[["sid", "shard", "blocks", "quota"]].itertuples(index=False, name=None)), "__sid int, __shard int, blocks long, quota long")

    before = Window.partitionBy("sid", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # documents without words have no place in a shard, however many a source has
    laid = dealt.where("size > 0").withColumn("begin", F.sum("size").over(before) - F.col("size")).unionByName(dealt.where("size = 0").withColumn("begin", F.lit(0).cast("long")))
    laid = laid.join(F.broadcast(quota), (F.col("sid") == F.col("__sid")) & (F.col("shard") == F.col("__shard")), "left")
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(p.seed), "sid", "shard")), 1, 8), 16, 10).cast("long")
    laid = laid.withColumn("offset", F.coalesce(F.pmod(start, F.col("blocks")), F.lit(0)))
    taken = F.expr("passes * size") + _chosen(F.col("begin") + F.col("size"), p) - _chosen(F.col("begin"), p)
    return (
        laid.withColumn("passes", F.coalesce(F.expr("quota div blocks"), F.lit(0)))
        .withColumn("taken", F.coalesce(taken, F.lit(0)).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "passes", "begin", "offset", "quota", "blocks", "taken", *carry)
    )


def _before(k: Column) -> Column:
    """How many of a shard's first k blocks are chosen."""
    return _div(k * F.expr("quota % blocks") + F.col("offset"), F.col("blocks"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _chosen(at: Column, p: MixParams) -> Column:
    """How many words before a place in a shard are in chosen blocks."""
    k = _div(at, F.lit(p.block_words))
    return _before(k) * p.block_words + F.when(_before(k + 1) > _before(k), at - k * p.block_words).otherwise(0)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mixed(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid,
             greatest(1, ceil(sum(size) / greatest(250000, ceil(sum(sum(size)) OVER () / 1000000))))::BIGINT AS shards FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][1 + sid % 3] AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2 * n / weight, sid) AS i, sum(weight) OVER (ORDER BY 2 * n / weight DESC, sid DESC) AS open_weight,
             1.5::DOUBLE * sum(n) OVER () - coalesce(sum(2 * n) OVER (ORDER BY 2 * n / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
      FROM w WHERE n > 0),
u AS (SELECT arg_min(room / open_weight, i) FILTER (WHERE room / open_weight * weight <= 2 * n) AS unit FROM o),
g AS (SELECT w.*, CASE WHEN n > 0 THEN least(2.0::DOUBLE * n, weight * unit) ELSE 0 END AS target FROM w, u),
r AS (SELECT d.*, g.sid, g.n AS source_size, g.target, md5('11:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.size) AS place,
             ('0x' || substr(md5('11:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.size), 1, 8))::BIGINT % g.shards AS shard
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
h AS (SELECT sid, shard, sum(size)::BIGINT AS n, ceil(sum(size) / 32.0)::BIGINT AS blocks FROM r GROUP BY sid, shard HAVING sum(size) > 0),
q AS (SELECT sid, count(*) AS quota FROM (
        SELECT sid, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, sid) AS place
        FROM (SELECT g.sid, g.target, unnest(range(2 * b)) AS k FROM g JOIN (SELECT sid, sum(blocks)::BIGINT AS b FROM h GROUP BY sid) USING (sid)))
      WHERE place <= (SELECT floor(1.5 * sum(n) / 32 + 0.5) FROM s) GROUP BY sid),
e AS (SELECT sid, shard, count(*) FILTER (WHERE place <= quota) AS quota, blocks FROM (
        SELECT sid, shard, blocks, q.quota, row_number() OVER (PARTITION BY sid ORDER BY n::DOUBLE / (2 * k + 1) DESC, shard) AS place
        FROM (SELECT *, unnest(range(2 * blocks)) AS k FROM h) LEFT JOIN q USING (sid))
      GROUP BY sid, shard, blocks),
l AS (SELECT r.*, quota, blocks, ('0x' || substr(md5('11:' || r.sid || ':' || r.shard), 1, 8))::BIGINT % blocks AS o,
             sum(size) OVER (PARTITION BY r.sid, r.shard ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS stop
      FROM r LEFT JOIN e ON r.sid = e.sid AND r.shard = e.shard),
p AS (SELECT *, stop - size AS start, quota % blocks AS m FROM l),
k AS (SELECT *, (start // 32 * m + o) // blocks AS c0, ((start // 32 + 1) * m + o) // blocks AS d0,
             (stop // 32 * m + o) // blocks AS c1, ((stop // 32 + 1) * m + o) // blocks AS d1 FROM p)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target,
       coalesce(quota // blocks * size + c1 * 32 + (d1 - c1) * (stop % 32) - c0 * 32 - (d0 - c0) * (start % 32), 0)::BIGINT AS taken
FROM k
"""
