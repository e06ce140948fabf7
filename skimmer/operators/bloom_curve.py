"""Bloom filters of several geometries, built and asked over one scan of the keys.

The indices of all keys go to parts of 2**23 bits as 6 bytes each: 4 of place, 2 that say
whose.  A part's task sets the members' bits and returns the keys that miss one, so that
no bitmap moves and no task holds more than a part.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import Hasher, item
from ..functions.sizing import BloomGeometry

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have the package

PART, CHUNK = 1 << 23, 1 << 16
_DEALT = pa.schema([("geometry", pa.int32()), ("part", pa.int64()), ("chunk", pa.int64()), ("asked", pa.int32()), ("absent", pa.int32()), ("places", pa.binary()), ("owners", pa.binary())])


def keys(members: DataFrame, asked: DataFrame, column: str, hasher: Hasher = Hasher()) -> DataFrame:
    """(kind, h1, h2) of each distinct key that isn't null: kind 0 is a member, 1 one that is asked, 2 asked and no member."""
    both = members.select(column, F.lit(1).alias("m"), F.lit(0).alias("a")).unionByName(asked.select(column, F.lit(0).alias("m"), F.lit(1).alias("a")))
    one = both.where(F.col(column).isNotNull()).groupBy(column).agg(F.max("m").alias("m"), F.max("a").alias("a"))
    h1, h2 = hasher.pair(item(one, column))
    # in one order, so that a task that is run again deals the same chunks
    return one.sortWithinPartitions(column).select(F.when(F.col("m") == 0, 2).otherwise(F.col("a")).alias("kind"), h1.alias("h1"), h2.alias("h2"))


def _dealer(shapes: list[tuple[int, int]]):
    def chunk(number: int, kind: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(kind, kind="stable")
        kind, h1, h2 = kind[order], h1[order], h2[order]
        asked, absent = np.searchsorted(kind, (1, 2)).tolist()
        for g, (m, k) in enumerate(shapes):
            index = ((h1 % m)[:, None] + np.arange(k) * (h2 % m)[:, None]) % m
            owner, index = np.repeat(np.arange(len(kind), dtype=np.uint16), k), index.ravel()
            part = index // PART
            by = np.argsort(part, kind="stable")
            names, at = np.unique(part[by], return_index=True)
            place, owner = (index % PART).astype(np.uint32)[by], owner[by]
            cuts = list(zip(at, [*at[1:], len(by)]))
            n = len(cuts)
            columns = [[g] * n, names.tolist(), [number] * n, [asked] * n, [absent] * n, [place[x:y].tobytes() for x, y in cuts], [owner[x:y].tobytes() for x, y in cuts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DEALT)], schema=_DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
            n += b.num_rows
            while n >= CHUNK:
                whole = [np.concatenate(c) for c in zip(*held)]
                yield from chunk(number, *(c[:CHUNK] for c in whole))
                number, held, n = number + 1, [[c[CHUNK:] for c in whole]], n - CHUNK
        if n:
            yield from chunk(number, *(np.concatenate(c) for c in zip(*held)))

    return run


def _part(rows: pa.Table) -> pa.Table:
    """(geometry, chunk, absent, missed, bits): the keys of each chunk that miss a bit of the part, and in chunk -1 its bits."""
    held = np.zeros(PART, bool)
    parts = [(r["chunk"], r["asked"], r["absent"], np.frombuffer(r["places"], np.uint32), np.frombuffer(r["owners"], np.uint16)) for r in rows.to_pylist()]
    for _, _, absent, place, owner in parts:
        held[place[owner < absent]] = True
    out = [(-1, 0, b"", int(held.sum()))]
    for number, asked, absent, place, owner in parts:
        missed = np.unique(owner[(owner >= asked) & ~held[place]])
        if len(missed):
            out.append((number, absent, missed.tobytes(), 0))
    columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.int64()))]
    return pa.table([pa.array([rows.column("geometry")[0].as_py()] * len(out), pa.int32()), *columns], ["geometry", "chunk", "absent", "missed", "bits"])


def _chunk(rows: pa.Table) -> pa.Table:
    """(geometry, bits, members, others): bits set, or the distinct keys of a chunk that miss a bit."""
    missed = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in rows.column("missed")]))
    members = int((missed < rows.column("absent")[0].as_py()).sum())
    return pa.table({"geometry": rows.column("geometry")[:1], "bits": [sum(rows.column("bits").to_pylist())], "members": [members], "others": [len(missed) - members]})


def measured(keys: DataFrame, geometries: Sequence[BloomGeometry]) -> list[tuple[int, int, float | None]]:
    """Bits set, members not found and the share of asked others found (None without any) of each geometry's filter of the members."""
    parts = keys.mapInArrow(_dealer([(g.n_bits, g.n_hashes) for g in geometries]), "geometry int, part long, chunk long, asked int, absent int, places binary, owners binary")
    found = parts.groupBy("geometry", "part").applyInArrow(_part, "geometry int, chunk long, absent int, missed binary, bits long")
    sums = found.groupBy("geometry", "chunk").applyInArrow(_chunk, "geometry int, bits long, members long, others long").groupBy("geometry").agg(F.sum("bits"), F.sum("members"), F.sum("others"))
    got = {r[0]: tuple(r)[1:] for r in sums.collect()}
    others = keys.where("kind = 2").count()
    return [(bits, lost, (others - far) / others if others else None) for bits, lost, far in (got.get(i, (0, 0, 0)) for i in range(len(geometries)))]
