"""Benchmark decontamination: size-partitioned MinHash containment search.

An item with n distinct shingles is contained in a document if at least m = ceil(t n)
of them occur in it.  Then at most n - m are missing, so of any n - m + 1 shingles one
occurs.  Items are partitioned by size; each partition keeps the bottom-k MinHash
sketch of its items with the k that makes the search exact for its largest one.
Documents, however long, aren't sketched: each of their shingles probes the sketches,
and the pairs found are verified by exact shingle containment.  An item with fewer words
than a shingle is one shingle of all its words, and documents are probed by windows of
that length too.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec
from .common import bounded, mapped, ship, written


@dataclass(frozen=True)
class ContainmentParams:
    """block_shingles bounds the item shingles that one pass over the documents sends to the tasks, broadcast_rows the ids of documents that a join broadcasts."""

    shingle: int = 5
    threshold: float = 0.8
    block_shingles: int = 500_000
    broadcast_rows: int = 1_000_000


def needed(n: int, threshold: float) -> int:
    """The least number of n shingles that makes a containment of the threshold or more."""
    return max(1, math.ceil(n * threshold - 1e-9))


class Index:
    """Bottom-k sketches of a block of items, by size partition, and their exact shingles.

    items: item_id, the words of its shingles, the distinct shingles.
    """

    def __init__(self, items: list[tuple[int | None, int, frozenset[bytes]]], p: ContainmentParams) -> None:
        self.p, self.items = p, items
        sizes = defaultdict(list)
        for k, (_, length, shingles) in enumerate(items):
            sizes[length, len(shingles).bit_length()].append(k)
        found = defaultdict(list)
        for (length, _), members in sizes.items():
            largest = max(len(items[k][2]) for k in members)
            depth = max(n - needed(n, p.threshold) + 1 for n in range(1, largest + 1))
            for k in members:
                h = np.sort(np.unique(self._hashes(items[k][2], length)))[:depth]
                found[length].append((h, np.full(len(h), k)))
        self.sketches = {}
        for length, parts in sorted(found.items()):
            h, who = (np.concatenate(x) for x in zip(*parts))
            order, bits = np.argsort(h, kind="stable"), np.zeros(1 << 20, bool)
            bits[(h >> np.uint64(44)).astype(np.int64)] = True
            self.sketches[length] = (h[order], who[order], bits)

    @staticmethod
    def _hashes(shingles: frozenset[bytes], length: int) -> np.ndarray:
        column = pa.array([s.decode("utf-8", "surrogatepass") for s in shingles])
        return textvec.windows(*textvec.words(column), length)[0]

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of the items contained in each text."""
        words, at = textvec.words(texts)
        pairs = defaultdict(lambda: defaultdict(set))
        for length, (hashes, who, bits) in self.sketches.items():
            h, first = textvec.windows(words, at, length)
            maybe = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
            left, right = (np.searchsorted(hashes, h[maybe], side) for side in ("left", "right"))
            hit = right > left
            for i, a, b in zip(maybe[hit], left[hit], right[hit]):
                pairs[int(np.searchsorted(first, i, "right")) - 1][length].update(who[a:b].tolist())
        for row in sorted(pairs):
            text = textvec.word_bytes(texts[row].as_py())
            for length, found in sorted(pairs[row].items()):
                own = set(textvec.shingle_bytes(text, length))
                for k in sorted(found):
                    shared = len(self.items[k][2] & own)
                    if shared >= needed(len(self.items[k][2]), self.p.threshold):
                        yield row, k, shared


def _blocks(items: DataFrame, p: ContainmentParams) -> Iterator[Index]:
    """The items' shingles in blocks of bounded size, one at a time; items without words have none and match nothing."""
    ship(items.sparkSession)
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        words = textvec.word_bytes(row[1])
        shingles = frozenset(textvec.shingle_bytes(words, p.shingle))
        if shingles:
            block.append((row[0], min(len(words), p.shingle), shingles))
            size += len(shingles)
        if size >= p.block_shingles:
            yield Index(block, p)
            block, size = [], 0
    if block:
        yield Index(block, p)


PAIR = "doc_id long, doc long, item_id long, n_shingles long, n_shared long"


def _searched(docs: DataFrame, items: DataFrame, p: ContainmentParams) -> DataFrame:
    """(doc_id, doc, item_id, n_shingles, n_shared), doc the text's XXH64.

    The pairs of each block are written before the next block is read, so that the driver
    and every task hold one block.
    """
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("doc"))
    out = None
    for index in _blocks(items, p):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(b.column(0)[r].as_py(), b.column(2)[r].as_py(), index.items[k][0], len(index.items[k][2]), n) for r, k, n in index.search(b.column(1))]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found) if found else ([],) * 5)], ["doc_id", "doc", "item_id", "n_shingles", "n_shared"])

        one = written(mapped(source, run, PAIR), "contained")
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], PAIR) if out is None else out


def contained(docs: DataFrame, items: DataFrame, p: ContainmentParams = ContainmentParams()) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared): items of which a document has a share of the threshold or more.

    Shares are of the item's distinct shingles, anywhere in the whole document.  An item
    with fewer words than a shingle is contained where its words follow one another.
    Empty and null texts match nothing.  Repeated rows of either side each give their
    pairs; null ids stay null.  The items are the stated query set: block by block they
    pass over all documents.  No rows of either: no rows.
    """
    return _searched(docs, items, p).drop("doc")


def decontaminated(docs: DataFrame, items: DataFrame, p: ContainmentParams = ContainmentParams()) -> DataFrame:
    """The rows of docs that contain no item, with all their columns; nulls and empty texts stay."""
    hit = written(_searched(docs, items, p).select(F.col("doc_id").alias("__id"), F.col("doc").alias("__doc")).distinct(), "contaminated")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__doc"))
    return docs.join(bounded(hit, p.broadcast_rows), same, "left_anti")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment of each contaminated pair."""
    return contained(docs, items).withColumn("containment", F.round(F.col("n_shared") / F.col("n_shingles"), 6))


ORACLE = r"""
WITH t AS (
  SELECT 0 AS side, doc_id AS id, row_number() OVER () AS r, text FROM documents
  UNION ALL SELECT 1, item_id, row_number() OVER (), text FROM benchmark),
w AS (
  SELECT side, id, r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM t),
i AS (SELECT *, least(len(w), 5) AS k FROM w WHERE side = 1 AND len(w) > 0),
k AS (SELECT DISTINCT k FROM i),
q AS (
  SELECT *, count(*) OVER (PARTITION BY r) AS n
  FROM (SELECT DISTINCT id, r, k, array_to_string(w[j : j + k - 1], ' ') AS s FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS j FROM i))),
d AS (
  SELECT DISTINCT id, r, k, array_to_string(w[j : j + k - 1], ' ') AS s
  FROM (SELECT w.*, k.k, unnest(generate_series(1, len(w) - k.k + 1)) AS j FROM w, k WHERE side = 0 AND len(w) >= k.k))
SELECT d.id AS doc_id, q.id AS item_id, q.n AS n_shingles, count(*) AS n_shared, round(count(*) / q.n, 6) AS containment
FROM q JOIN d ON d.k = q.k AND d.s = q.s
GROUP BY d.id, d.r, q.id, q.r, q.n
HAVING count(*) >= ceil(q.n * 0.8 - 1e-9)
"""
