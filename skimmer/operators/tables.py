"""Hash-table questions over relations: dictionary state from a log, chains, linear probing, growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.hashing import Hasher, item

PORTABLE = Hasher()


def latest(log: DataFrame, key: str, value: str, seq: str, op: str | None = None) -> DataFrame:
    """key, value after the log: the last put of each key, unless a delete came later (op is put or delete)."""
    last = log.groupBy(key).agg(F.max_by(F.struct(value, F.lit("put").alias("__op") if op is None else F.col(op).alias("__op")), seq).alias("x"))
    return last.where("x.__op <> 'delete'").select(key, F.col(f"x.{value}").alias(value))


def lookup(queries: DataFrame, table: DataFrame, key: str, value: str, default=None) -> DataFrame:
    """queries with value, or the default where the key is absent."""
    hit = table.select(key, value, F.lit(True).alias("__hit"))
    return queries.join(hit, key, "left").withColumn(value, F.when(F.col("__hit"), F.col(value)).otherwise(F.lit(default))).drop("__hit")


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def contains(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return keys.join(table.select(key), key, "left_semi")


def slots(keys: DataFrame, key: str, capacity: int, hasher: Hasher = PORTABLE) -> DataFrame:
    """slot, key of the distinct keys."""
    k = keys.select(key).distinct()
    return k.select(hasher.slot(item(k, key), capacity).alias("slot"), key)


def bucket_lengths(keys: DataFrame, key: str, capacity: int, hasher: Hasher = PORTABLE) -> DataFrame:
    """slot, length for every slot, empty ones included."""
    n = slots(keys, key, capacity, hasher).groupBy("slot").agg(F.count("*").alias("n"))
    return keys.sparkSession.range(capacity).withColumnRenamed("id", "slot").join(n, "slot", "left").select("slot", F.coalesce("n", F.lit(0)).cast("bigint").alias("length"))


def chain_histogram(keys: DataFrame, key: str, capacity: int, hasher: Hasher = PORTABLE) -> DataFrame:
    """length, n_slots."""
    return bucket_lengths(keys, key, capacity, hasher).groupBy("length").agg(F.count("*").alias("n_slots"))


def chain_probes(keys: DataFrame, key: str, capacity: int, hasher: Hasher = PORTABLE) -> DataFrame:
    """n_keys, probes, mean_probes, load_factor of looking each key up once: a key costs its place in its chain."""
    n = slots(keys, key, capacity, hasher).groupBy("slot").agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("n_keys"), F.sum((F.col("n") * (F.col("n") + 1) / 2).cast("bigint")).alias("probes")).select(
        "n_keys", "probes", (F.col("probes") / F.col("n_keys")).alias("mean_probes"), (F.col("n_keys") / capacity).alias("load_factor"))


def chain_misses(keys: DataFrame, asked: DataFrame, key: str, capacity: int, hasher: Hasher = PORTABLE) -> DataFrame:
    """n_keys, probes, mean_probes of looking each distinct absent key up once: a miss compares the whole chain of its slot."""
    absent = asked.select(key).distinct().join(keys.select(key).distinct(), key, "left_anti")
    lengths = slots(keys, key, capacity, hasher).groupBy("slot").agg(F.count("*").alias("n"))
    cost = slots(absent, key, capacity, hasher).join(lengths, "slot", "left").agg(F.count("*").alias("n_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("probes"))
    return cost.select("n_keys", "probes", F.coalesce(F.try_divide("probes", "n_keys"), F.lit(0.0)).alias("mean_probes"))


def linear_probing(keys: DataFrame, key: str, capacity: int, hasher: Hasher = PORTABLE) -> DataFrame:
    """slot, arrivals, carry, occupied of a linear-probing table after inserting the distinct keys.

    The overflow of a slot follows q = max(0, q_before + arrivals - 1); over the ring
    unrolled twice it is a prefix sum less its running minimum.  The windows see one
    row a slot, so their single partition is bounded by the table's capacity.
    """
    if keys.select(key).distinct().count() > capacity:
        raise RuntimeError("the table is full")
    lengths = bucket_lengths(keys, key, capacity, hasher)
    ring = lengths.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("lap"), "slot", "length").withColumn("place", F.col("lap") * capacity + F.col("slot"))
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    run = ring.withColumn("s", F.sum(F.col("length") - 1).over(upto)).withColumn("q", F.col("s") - F.least(F.lit(0), F.min("s").over(upto)))
    carry = F.coalesce(F.lag("q").over(Window.orderBy("place")), F.lit(0))
    return run.withColumn("before", carry).where("lap = 1").select("slot", F.col("length").alias("arrivals"), F.col("q").alias("carry"), (F.col("before") + F.col("length") >= 1).alias("occupied"))


def linear_probe_cost(keys: DataFrame, key: str, capacity: int, hasher: Hasher = PORTABLE) -> DataFrame:
    """n_keys, probes, mean_probes, load_factor of looking each key up once; the order of insertion doesn't matter."""
    t = linear_probing(keys, key, capacity, hasher)
    return t.agg(F.sum("arrivals").alias("n_keys"), F.sum(F.col("arrivals") + F.col("carry")).alias("probes")).select(
        "n_keys", "probes", (F.col("probes") / F.col("n_keys")).alias("mean_probes"), (F.col("n_keys") / capacity).alias("load_factor"))


def growth(sizes: DataFrame, n: str, initial: int = 16, max_load: float = 0.75) -> DataFrame:
    """sizes with capacity and n_resizes after that many distinct inserts: the least initial * 2^j that holds them."""
    if initial < 1 or not 0 < max_load <= 1:
        raise ValueError("a table needs a slot, and a load factor above 0 and up to 1")
    steps = F.sequence(F.lit(0), F.lit(40))
    j = F.array_min(F.filter(steps, lambda i: F.col(n) <= F.lit(max_load * initial) * F.pow(F.lit(2.0), i)))
    return sizes.withColumn("n_resizes", j).withColumn("capacity", (F.lit(initial) * F.pow(F.lit(2.0), "n_resizes")).cast("bigint"))


def modelled_bytes(keys: DataFrame, key: str, overhead: int = 100) -> DataFrame:
    """n_keys, memory_bytes: key bytes plus a fixed overhead a key (a model, not a measurement)."""
    k = keys.select(F.col(key).cast("string").alias("k")).distinct()
    return k.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum(F.octet_length("k") + overhead), F.lit(0)).alias("memory_bytes"))


def replay(log: DataFrame, table: str, seq: str, op: str, key: str, capacity: int, hasher: Hasher = PORTABLE) -> DataFrame:
    """table, slot, key, state of open-addressing tables replayed op by op, tombstones included.

    A deletion leaves a tombstone that probes walk past and the next put of a new key
    takes.  The replay is sequential by nature: one Arrow group a table, which must fit a task.
    """
    import pandas as pd

    def run(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cells: list = [None] * capacity
        for r in rows.sort_values("seq").itertuples(index=False):
            free = at = None
            for step in range(capacity):
                i = (r.home + step) % capacity
                if cells[i] is None:
                    free = i if free is None else free
                    break
                if cells[i] == "":
                    free = i if free is None else free
                elif cells[i] == r.key:
                    at = i
                    break
            if r.op == "put" and at is None:
                if free is None:
                    raise RuntimeError("the table is full")
                cells[free] = r.key
            elif r.op == "delete":
                if at is None:
                    raise KeyError(r.key)
                cells[at] = ""
        kept = [(name[0], i, c or None, "tombstone" if c == "" else "key") for i, c in enumerate(cells) if c is not None]
        return pd.DataFrame(kept, columns=["table", "slot", "key", "state"])

    text = F.col(key).cast("string")
    rows = log.select(F.col(table).cast("string").alias("table"), F.col(seq).alias("seq"), F.col(op).alias("op"), text.alias("key"), hasher.slot(text, capacity).alias("home"))
    return rows.groupBy("table").applyInPandas(run, "table string, slot bigint, key string, state string")
