"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model.

Spark counts: each task reduces its texts to distinct n-grams and sends them, packed, to
the shard of the n-gram's first word; a word that begins a large share of them is split
over shards by the rest.  A shard adds the counts up and sends what its n-grams say of
their contexts and of the n-grams one word shorter (continuation counts) to the shards
of those, level by level.  Shards are written to the shared folder as sorted hash
arrays, which the scoring workers map into memory and search with the sorted hashes of
their texts.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec
from .common import discard, mapped, new_path, solved, written

#: Hashes of what stands before the first and after the last word of a text.
START, END = np.uint64(0x51ED270B7F3A6C11), np.uint64(0xA24BAED4963EE407)


@dataclass(frozen=True)
class NgramParams:
    """A text is held out if crc32 of its doc_id modulo folds is held.

    order: words of an n-gram, 2 or more.  A shard is made of about shard_bytes of text;
    max_shards bounds the rows that the driver sees.  Which words are split over shards is
    decided on texts of about sample_bytes, by hash; it changes no result.
    """

    order: int = 2
    folds: int = 7
    held: int = 2
    shard_bytes: int = 16 << 20
    max_shards: int = 1 << 16
    sample_bytes: int = 32 << 20
    flush_tokens: int = 2_000_000
    slice_tokens: int = 500_000

    def __post_init__(self) -> None:
        if self.order < 2:
            raise ValueError("order must be 2 or more")


def ngrams(column: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The words of the n-gram that ends at every token (words, then one end) of the texts, first word first, and each row's first token.

    Places before a text are START.
    """
    h, at = textvec.words(column)
    current = np.insert(h, at[1:], END)
    first = at + np.arange(len(at))
    out = [current]
    for _ in range(order - 1):
        previous = np.empty_like(current)
        previous[1:] = out[0][:-1]
        previous[first[:-1]] = START
        out.insert(0, previous)
    return out, first


def _key(words: list[np.ndarray]) -> np.ndarray:
    """The hash of n-grams; that of one word is its own."""
    out = words[0]
    for w in words[1:]:
        out = textvec.mix64(out * np.uint64(textvec.WINDOW_BASE) + w)
    return out


def _summed(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, the place of one of each, and sums of the weights."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))
    return k[first], order[first], [np.add.reduceat(w[order], first) if len(first) else w[:0] for w in weights]


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash, by its top bits; shards is a power of two."""
    return (h >> np.uint64(65 - shards.bit_length())).astype(np.int64) if shards > 1 else np.zeros(len(h), np.int64)


def _place(words: list[np.ndarray], shards: int, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shard of n-grams: that of the first word, or of its part for a word in ``hot`` (words in order, parts)."""
    h = words[0]
    if len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], h), len(hot[0]) - 1)
        split = np.flatnonzero(hot[0][at] == h)
        part = _key([w[split] for w in words[1:]]) % hot[1][at[split]]
        h = h.copy()
        h[split] = textvec.mix64(h[split] + part)
    return _shard(h, shards)


def _pack(*columns: np.ndarray) -> bytes:
    """Small counts as bytes, others with their place; hashes as they are. The first column's length comes first."""
    out = [np.int64(len(columns[0])).tobytes()]
    for c in columns:
        if c.dtype == np.uint64:
            out.append(c.tobytes())
        else:
            big = np.flatnonzero(c >= 255)
            out += [np.minimum(c, 255).astype(np.uint8).tobytes(), np.int64(len(big)).tobytes(), big.astype(np.int32).tobytes(), c[big].astype(np.int64).tobytes()]
    return b"".join(out)


def _unpack(blob: bytes, kinds: str) -> list[np.ndarray]:
    """kinds: h for hashes, c for counts."""
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []

    def take(kind: type, k: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(blob, kind, k, at)
        at += x.nbytes
        return x

    for kind in kinds:
        if kind == "h":
            out.append(take(np.uint64, n))
        else:
            c = take(np.uint8, n).astype(np.int64)
            k = int(take(np.int64, 1)[0])
            place = take(np.int32, k)
            c[place] = take(np.int64, k)
            out.append(c)
    return out


def _small(x: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as hold the largest."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _save(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Each array as a file of its own, in place at once: a repeated task writes the same again."""
    for key, x in arrays.items():
        path, other = f"{folder}/{name}-{key}.npy", f"{folder}/.{name}-{key}-{uuid.uuid4().hex}.npy"
        np.save(other, x)
        os.replace(other, path)


def _split_counts(c: np.ndarray) -> dict[str, np.ndarray]:
    big = np.flatnonzero(c >= 255)
    return {"count": np.minimum(c, 255).astype(np.uint8), "place": big, "large": c[big]}


def _slices(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` tokens, or of one row."""
    row = 0
    while row < len(at) - 1:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, end
        row = end


def _folder(docs: DataFrame) -> str:
    path = new_path(docs.sparkSession, "ngram")
    if "://" in path and not path.startswith("file://"):
        raise ValueError("workers map the model into memory: spark.checkpoint.dir must be a mounted file system")
    path = path.removeprefix("file://").removeprefix("file:")
    Path(path).mkdir(parents=True)
    return path


def _discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more from the numbers of counts 1 to 4; usual values where these are lacking."""
    out = np.array([0.0, 0.5, 1.0, 1.5])
    if n[0] > 0 and n[1] > 0:
        y = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            if n[k - 1] > 0 and n[k] > 0:
                out[k] = min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.01), k)
    return out


@dataclass(frozen=True)
class Model:
    """Where the shards are and which exist, and the totals; discounts by level, from one word up."""

    folder: str
    order: int
    shards: int
    hot: tuple[np.ndarray, np.ndarray]
    present: dict[str, np.ndarray]
    tokens: int
    vocabulary: int
    discounts: tuple[np.ndarray, ...]
    continuations: int
    spare: float

    def _map(self, name: str, cache: dict = {}) -> np.ndarray:  # noqa: B006  one map a process
        path = f"{self.folder}/{name}.npy"
        if path not in cache:
            if len(cache) > 16 * self.order * max(1024, self.shards):
                cache.clear()
            cache[path] = np.load(path, mmap_mode="r")  # a shard that was written and isn't there is an error
        return cache[path]

    def _find(self, table: str, shard: np.ndarray, keys: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """(shard name, indices of keys found in it, their places)."""
        for s in np.unique(shard):
            if not self.present[table][s]:
                continue
            here = np.flatnonzero(shard == s)
            have = self._map(f"{table}-{s}-key")
            order = here[np.argsort(keys[here], kind="stable")]
            at = np.searchsorted(have, keys[order])
            hit = have[np.minimum(at, len(have) - 1)] == keys[order]
            yield f"{table}-{s}", order[hit], at[hit]

    def _counts(self, name: str, at: np.ndarray) -> np.ndarray:
        c = self._map(f"{name}-count")[at].astype(np.int64)
        large = c == 255
        if large.any():
            c[large] = self._map(f"{name}-large")[np.searchsorted(self._map(f"{name}-place"), at[large])]
        return c

    def log_probabilities(self, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 p(last word | the words before), the training count of the last word, and its base log10 probability."""
        words, back = np.unique(grams[-1], return_inverse=True)
        count, after = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for name, index, at in self._find("word", _shard(words, self.shards), words):
            count[index], after[index] = self._map(f"{name}-tokens")[at], self._map(f"{name}-contexts")[at]
        one = self.discounts[0]
        p = (np.maximum(after - one[np.minimum(after, 3)], 0) / max(1, self.continuations) + self.spare / (self.vocabulary + 1))[back]
        for level in range(2, self.order + 1):
            mine, discount = grams[-level:], self.discounts[level - 1]
            contexts, where = np.unique(_key(mine[:-1]), return_inverse=True)
            total, stats = np.zeros(len(contexts), np.int64), np.zeros((len(contexts), 3))
            for name, index, at in self._find(f"context{level}", _shard(contexts, self.shards), contexts):
                total[index], stats[index] = self._map(f"{name}-total")[at], self._map(f"{name}-stats")[at]
            share = np.where(total > 0, stats @ discount[1:] / np.maximum(total, 1), 1.0)
            keys, first, gram = np.unique(_key(mine), return_index=True, return_inverse=True)
            seen = np.zeros(len(keys), np.int64)
            for name, index, at in self._find(f"gram{level}", _place([w[first] for w in mine], self.shards, self.hot), keys):
                seen[index] = self._counts(name, at)
            p = np.maximum(seen - discount[np.minimum(seen, 3)], 0)[gram] / np.maximum(total[where], 1) + share[where] * p
        base = np.log10((count + 1) / (self.tokens + 1 * (self.vocabulary + 1)))
        return np.log10(p), count[back], base[back]


def _hot(text: DataFrame, size: int, shards: int, p: NgramParams) -> tuple[np.ndarray, np.ndarray]:
    """Words with over a quarter of a shard's share of a sample's tokens, START among them, and the parts that each is split into: at most 4 * shards words."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if shards == 1:
        return none

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in textvec.row_slices(b.column(0)):
                word, n = np.unique(ngrams(b.column(0).slice(lo, hi - lo), 2)[0][0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    some = text.where(F.pmod(F.xxhash64("text"), F.lit(max(1, size // p.sample_bytes))) == 0)
    counts = written(mapped(some, count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "sampled-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") * 4 * shards > total).collect()
    discard(counts)
    if not found:
        return none
    word = np.array([r["word"] for r in found], np.int64).view(np.uint64)
    parts = np.array([-(-4 * shards * r["n"] // total) for r in found], np.uint64)
    order = np.argsort(word)
    return word[order], parts[order]


#: A row of counting: n-grams of ``kind`` words, the contexts of n-grams of kind - CONTEXT words, or, below zero, what the shard of -kind has written, and sums of it.
ROW, CONTEXT = "kind int, shard int, first binary, second binary, v array<long>", 100


def _rows(rows: list[tuple[int, int, bytes, bytes, list[int] | None]]) -> list[pa.Array]:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]


def _sent(kind: int, words: list[np.ndarray], n: np.ndarray, place: np.ndarray, shards: int) -> list[tuple]:
    """n-grams as one row a shard, the first words in runs."""
    order = np.lexsort((*reversed(words), place))
    words, n = [w[order] for w in words], n[order]
    edges, out = np.searchsorted(place[order], np.arange(shards + 1)), []
    for s in np.flatnonzero(np.diff(edges)):
        a, b = edges[s], edges[s + 1]
        word, _, (runs,) = _summed(words[0][a:b], np.ones(b - a, np.int64))
        out.append((kind, int(s), _pack(word, runs), _pack(*(w[a:b] for w in words[1:]), n[a:b]), None))
    return out


def _sums(kind: int, keys: np.ndarray, columns: list[np.ndarray], shards: int) -> list[tuple]:
    """Keys in order with their sums, one row a shard."""
    edges = np.searchsorted(_shard(keys, shards), np.arange(shards + 1))
    return [(kind, int(s), _pack(*(x[edges[s] : edges[s + 1]] for x in (keys, *columns))), b"", None) for s in np.flatnonzero(np.diff(edges))]


def train(docs: DataFrame, p: NgramParams = NgramParams()) -> Model:
    """The model of the whole texts of docs; null counts as empty, and an empty text as one end.

    Only the column text is read; repeated rows count as often as they occur, and a very
    long text is counted in slices.  N-grams that begin before a text keep their plain
    counts at lower orders, as they have nothing to their left.  No rows: a model that
    gives everything probability 1.
    """
    text = docs.select(F.col("text").cast("string").alias("text"))
    size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, order = 1, p.order
    while shards * p.shard_bytes < size and shards < p.max_shards:
        shards *= 2
    folder, hot = _folder(docs), _hot(text, size, shards, p)
    names = ["kind", "shard", "first", "second", "v"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            words = [np.concatenate(x) for x in zip(*held)]
            _, one, (n,) = _summed(_key(words), np.ones(len(words[0]), np.int64))
            words = [w[one] for w in words]
            return pa.RecordBatch.from_arrays(_rows(_sent(order, words, n, _place(words, shards, hot), shards)), names)

        for b in batches:
            grams, first = ngrams(b.column(0), order)
            for lo, hi in _slices(first, p.slice_tokens):
                held.append([w[first[lo] : first[hi]] for w in grams])
                waiting += len(held[-1][0])
                if waiting >= p.flush_tokens:
                    yield flush()
                    held, waiting = [], 0
        if held:
            yield flush()

    def add(level: int, shard: int, rows: pa.Table) -> list[tuple]:
        """The n-grams of a shard: saved, and what they say of contexts and shorter n-grams."""
        parts = []
        for a, b in zip(rows["first"].to_pylist(), rows["second"].to_pylist()):
            word, runs = _unpack(a, "hc")
            parts.append((np.repeat(word, runs), *_unpack(b, "h" * (level - 1) + "c")))
        *words, n = (np.concatenate(x) for x in zip(*parts))
        keys, one, (n,) = _summed(_key(words), n)
        words = [w[one] for w in words]
        _save(folder, f"gram{level}-{shard}", key=keys, **_split_counts(n))
        context, _, sums = _summed(_key(words[:-1]), n, *((np.minimum(n, 3) == k).astype(np.int64) for k in (1, 2, 3)))
        out = _sums(CONTEXT + level, context, sums, shards)
        shorter = words[1:]
        weight = np.where(shorter[0] == START, n, 1) if level > 2 else np.ones(len(n), np.int64)
        tokens = n if level == order else np.zeros(len(n), np.int64)
        if level > 2:
            _, one, (weight,) = _summed(_key(shorter), weight)
            short = [w[one] for w in shorter]
            out += _sent(level - 1, short, weight, _place(short, shards, hot), shards)
            weight = np.zeros(len(n), np.int64)
        if level in (2, order):
            word, _, (contexts, tokens) = _summed(words[-1], weight, tokens)
            out += _sums(1, word, [contexts, tokens], shards)
        return [*out, (-level, shard, b"", b"", [int((n == k).sum()) for k in (1, 2, 3, 4)])]

    def words_of(shard: int, rows: pa.Table) -> list[tuple]:
        word, contexts, tokens = (np.concatenate(x) for x in zip(*(_unpack(x, "hcc") for x in rows["first"].to_pylist())))
        word, _, (contexts, tokens) = _summed(word, contexts, tokens)
        _save(folder, f"word-{shard}", key=word, contexts=_small(contexts), tokens=_small(tokens))
        return [(-1, shard, b"", b"", [*(int((contexts == k).sum()) for k in (1, 2, 3, 4)), int((contexts >= 3).sum()), int(contexts.sum()), int(tokens.sum()), len(word)])]

    def contexts_of(level: int, shard: int, rows: pa.Table) -> list[tuple]:
        key, *sums = (np.concatenate(x) for x in zip(*(_unpack(x, "hcccc") for x in rows["first"].to_pylist())))
        key, _, sums = _summed(key, *sums)
        _save(folder, f"context{level}-{shard}", key=key, total=_small(sums[0]), stats=_small(np.stack(sums[1:], 1)))
        return [(-CONTEXT - level, shard, b"", b"", [])]

    def step(level: int):
        def run(rows: pa.Table) -> pa.Table:
            kind, shard = rows["kind"][0].as_py(), rows["shard"][0].as_py()
            if kind > CONTEXT:
                out = contexts_of(kind - CONTEXT, shard, rows)
            elif kind == level:
                out = add(level, shard, rows) if level > 1 else words_of(shard, rows)
            else:
                return rows
            return pa.table(_rows(out), names)

        return run

    state = mapped(text, count, ROW)
    for level in range(order, 0, -1):
        state = solved(state, ["kind", "shard"], step(level), ROW)
    done = written(state.select("kind", "shard", "v"), "counted")
    made = done.select("kind", "shard").collect()  # 2 * order rows a shard at most
    sums = {r["kind"]: r["x"] for r in done.groupBy("kind").agg(F.array(*[F.coalesce(F.sum(F.get("v", F.lit(i))), F.lit(0)) for i in range(8)]).alias("x")).collect()}
    discard(done)
    tables = {-1: "word"} | {-k: f"gram{k}" for k in range(2, order + 1)} | {-CONTEXT - k: f"context{k}" for k in range(2, order + 1)}
    present = {name: np.zeros(shards, bool) for name in tables.values()}
    for r in made:
        present[tables[r["kind"]]][r["shard"]] = True
    v = {k: np.array(sums.get(-k, [0] * 8), np.int64) for k in range(1, order + 1)}
    discounts = tuple(_discounts(v[k][:4]) for k in range(1, order + 1))
    one, total = discounts[0], int(v[1][5])
    spare = float(one[1] * v[1][0] + one[2] * v[1][1] + one[3] * v[1][4]) / total if total else 1.0
    return Model(folder, order, shards, hot, present, int(v[1][6]), int(v[1][7]), discounts, total, spare)


def scored(docs: DataFrame, model: Model, p: NgramParams = NgramParams()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row a row of docs.

    Texts are read whole; a null or empty one is one end.  A null doc_id counts as the
    empty string for the fold.  10 ** (-score / n_tokens) is the perplexity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams, first = ngrams(b.column(1), model.order)
            for lo, hi in _slices(first, p.slice_tokens):
                a, z = first[lo], first[hi]
                score, count, base = model.log_probabilities([w[a:z] for w in grams])
                cut = (first[lo:hi] - a).astype(np.int64)
                n = np.diff(first[lo : hi + 1])
                known = np.add.reduceat((count > 0).astype(np.int64), cut)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(known), pa.array(np.add.reduceat(base, cut)), pa.array(np.add.reduceat(score, cut))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    rows = mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return rows.select("doc_id", held_out(p).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(p: NgramParams = NgramParams()):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % p.folds == p.held


def digest(docs: DataFrame) -> DataFrame:
    """Scores of all documents by the model of those not held out."""
    return scored(docs, train(docs.where(~held_out())))
