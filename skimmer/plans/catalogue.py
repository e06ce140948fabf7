"""The query catalogue over the tables of a folder, each query beside its SQL for DuckDB.

Every query runs over whole tables under the portable hash, so that another engine can
repeat it bit by bit.  Counts are BIGINT and ratios rounded to six places.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import sizing
from ..functions.hashing import Hasher, clumping, leading_zeros
from ..operators import bloom, bloom_curve, cms, counting_bloom, features, hll, quality, setjoin, similarity, tables
from ..sources import datagen
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def sql_h(e: str, seed: int = 0) -> str:
    return f"('0x' || substr(md5('{seed}:' || {e}), 1, 15))::BIGINT"


def sql_h2(e: str, seed: int = 0) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {e}), 16, 15))::BIGINT | 1)"


def sql_index(e: str, i: str, m: int | str, seed: int = 0) -> str:
    return f"(({sql_h(e, seed)} % {m} + {i} * ({sql_h2(e, seed)} % {m})) % {m})"


H = Hasher()
PORTABLE_FN = lambda c, seed: Hasher(seed=seed).h(c)
CLUMPING_FN = lambda c, seed: clumping(c, seed)

#: Modelled bytes of a set: what modelled_bytes() gives for a column of a relation.
_MODELLED = "(SELECT coalesce(sum(strlen({0}::VARCHAR) + 100), 0)::BIGINT FROM {1})"

# ---- hash functions -------------------------------------------------------------------------


@query(f"""SELECT c_custkey, c_name, {sql_h("c_name")} AS h, {sql_h("c_name")} % 16 AS slot, {sql_h("c_name", 1)} AS other_h,
  {sql_h("c_name")} % 16 = {sql_h("c_name", 1)} % 16 AS same_slot FROM customer""")
def hash_basics(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", H.h(F.col("c_name")).alias("h"), Hasher(seed=1).h(F.col("c_name")).alias("other_h"))
    slot = F.pmod("h", F.lit(16))
    return c.select("c_custkey", "c_name", "h", slot.alias("slot"), "other_h", (slot == F.pmod("other_h", F.lit(16))).alias("same_slot"))


@query("""WITH n AS (SELECT c_mktsegment AS s, c_name FROM customer),
b AS (SELECT s, list_sum([ascii(x) FOR x IN string_split(c_name, '')])::BIGINT AS h, length(c_name) AS k FROM n)
SELECT s AS c_mktsegment, count(DISTINCT h) AS n_hashes, count(*) AS n_names, max(h) AS largest FROM b GROUP BY s""")
def hash_clumping(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_mktsegment", clumping(F.col("c_name")).alias("h"))
    return c.groupBy("c_mktsegment").agg(F.countDistinct("h").alias("n_hashes"), F.count("*").alias("n_names"), F.max("h").alias("largest"))


@query(f"""SELECT b AS bucket, count(c_name) AS n FROM range(64) r(b) LEFT JOIN customer ON {sql_h("c_name")} % 64 = b GROUP BY b""")
def hash_bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.bucket_counts(table(spark, d, "customer"), "c_name", 64, PORTABLE_FN)


def _chi(h: str, name: str) -> str:
    return f"""SELECT '{name}' AS hash, sum(n)::BIGINT AS n_values, round(sum(n * n) / (sum(n) / 64) - sum(n), 6) AS statistic, 63::BIGINT AS dof, round(max(n) / (sum(n) / 64), 6) AS max_over_expected
FROM (SELECT b, count(c_name) AS n FROM range(64) r(b) LEFT JOIN customer ON {h} % 64 = b GROUP BY b)"""


@query(_chi(sql_h("c_name"), "portable") + " UNION ALL " + _chi("list_sum([ascii(x) FOR x IN string_split(c_name, '')])", "clumping"))
def hash_chi_square(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    parts = [quality.chi_square(c, "c_name", 64, f).withColumn("hash", F.lit(n)) for n, f in (("portable", PORTABLE_FN), ("clumping", CLUMPING_FN))]
    return union(parts).select("hash", "n_values", r6(F.col("statistic")).alias("statistic"), "dof", r6(F.col("max_over_expected")).alias("max_over_expected"))


@query()
def hash_quality_report(spark: SparkSession, d: str) -> DataFrame:
    """Chi square with its p-value and avalanche, good and bad hash side by side."""
    names = table(spark, d, "customer")
    rows = []
    for name, f, bits in (("portable", PORTABLE_FN, 60), ("clumping", CLUMPING_FN, 60)):
        x = quality.chi_square(names, "c_name", 64, f).first()
        a = quality.avalanche_summary(names, "c_custkey", f, bits).first()
        p = quality.p_value(x["statistic"], x["dof"])
        rows.append((name, x["statistic"], p, x["max_over_expected"], p > 0.01, a["mean_rate"], a["worst_deviation"], quality.avalanches(a["worst_deviation"], names.count())))
    return spark.createDataFrame(rows, "hash string, chi_square double, p_value double, max_over_expected double, is_uniform boolean, avalanche_mean double, avalanche_worst_deviation double, avalanches boolean")


@query(f"""WITH s AS (SELECT b, xor({sql_h("o_orderkey::VARCHAR")}, {sql_h("xor(o_orderkey, (CASE WHEN b = 63 THEN -9223372036854775808 ELSE 1::BIGINT << b END)::BIGINT)::VARCHAR")}) AS d FROM orders, range(64) r(b))
SELECT b AS bit_in, round(sum(bit_count(d)) / count(*) / 60, 6) AS mean_rate, count(*) AS n_samples FROM s GROUP BY b""")
def hash_avalanche(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey")
    rates = quality.avalanche(orders, "o_orderkey", PORTABLE_FN, 60).groupBy(F.col("bit_in").cast("bigint").alias("bit_in")).agg(r6(F.avg("rate")).alias("mean_rate"))
    return rates.join(F.broadcast(orders.agg(F.count("*").alias("n_samples"))))  # one row


@query(f"""WITH e AS (SELECT ts::DATE AS day, 60 - length(ltrim(bin({sql_h("event_id::VARCHAR")}), '0')) AS z FROM events),
g AS (SELECT day, count(*) AS n, max(z) AS z FROM e GROUP BY day)
SELECT day, sum(n) OVER (ORDER BY day)::BIGINT AS n_items, max(z) OVER (ORDER BY day)::BIGINT AS longest_run, (2 ** max(z) OVER (ORDER BY day))::BIGINT AS estimate FROM g""")
def hash_leading_zeros_trace(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), leading_zeros(H.h(F.col("event_id").cast("string")), 60).alias("z"))
    upto = Window.orderBy("day")  # one row a day
    g = e.groupBy("day").agg(F.count("*").alias("n"), F.max("z").alias("z"))
    run = F.max("z").over(upto)
    return g.select("day", F.sum("n").over(upto).alias("n_items"), run.cast("bigint").alias("longest_run"), F.pow(F.lit(2.0), run).cast("bigint").alias("estimate"))


# ---- hash tables ----------------------------------------------------------------------------

_LOG = "SELECT user_id, value, event_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op FROM events"
_STATE = f"SELECT user_id, arg_max(value, event_id) AS value, arg_max(op, event_id) AS op FROM ({_LOG}) GROUP BY user_id"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "value", "event_id", F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"))


@query(f"SELECT user_id, value FROM ({_STATE}) WHERE op <> 'delete'")
def dict_latest_state(spark: SparkSession, d: str) -> DataFrame:
    return tables.latest(_log(spark, d), "user_id", "value", "event_id", "op")


@query(f"SELECT c_custkey AS user_id, coalesce(CASE WHEN op <> 'delete' THEN value END, -1) AS value FROM customer LEFT JOIN ({_STATE}) s ON user_id = c_custkey")
def dict_lookup_default(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return tables.lookup(asked, dict_latest_state(spark, d), "user_id", "value", -1.0).select("user_id", "value")


@query(f"SELECT user_id, value FROM ({_STATE}) WHERE op <> 'delete' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 50)")
def dict_delete_anti(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "events").where("event_type = 'purchase' AND value > 50").select("user_id").distinct()
    return tables.delete(dict_latest_state(spark, d), gone, "user_id")


@query(f"SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT user_id FROM ({_STATE}) WHERE op <> 'delete')")
def dict_contains(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    return tables.contains(dict_latest_state(spark, d), o, "user_id").select("o_orderkey")


_K = "SELECT DISTINCT o_orderkey::VARCHAR AS k FROM orders"
_CAP = f"(SELECT min(16 * 2 ** j)::BIGINT FROM range(41) r(j) WHERE (SELECT count(*) FROM ({_K})) <= 0.75 * 16 * 2 ** j)"
_N = f"SELECT s, count(k) AS n FROM (SELECT unnest(range({_CAP})) AS s) LEFT JOIN (SELECT {sql_h('k')} % {_CAP} AS slot, k FROM ({_K})) ON slot = s GROUP BY s"


def _orders(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    o = table(spark, d, "orders").select("o_orderkey")
    return o, sizing.table_capacity(o.distinct().count())


@query(f"SELECT n AS length, count(*) AS n_slots FROM ({_N}) GROUP BY n")
def chain_length_hist(spark: SparkSession, d: str) -> DataFrame:
    o, capacity = _orders(spark, d)
    return tables.chain_histogram(o, "o_orderkey", capacity)


@query(f"SELECT sum(n)::BIGINT AS n_keys, sum(n * (n + 1) // 2)::BIGINT AS probes, round(sum(n * (n + 1) / 2) / sum(n), 6) AS mean_probes, round(sum(n) / count(*), 6) AS load_factor FROM ({_N})")
def chain_probe_cost(spark: SparkSession, d: str) -> DataFrame:
    o, capacity = _orders(spark, d)
    return tables.chain_probes(o, "o_orderkey", capacity).withColumns({c: r6(F.col(c)) for c in ("mean_probes", "load_factor")})


_FAR = "SELECT DISTINCT (o_orderkey + 1000000000)::VARCHAR AS k FROM orders"


@query(f"SELECT count(*) AS n_keys, coalesce(sum(n), 0)::BIGINT AS probes, round(coalesce(sum(n), 0) / count(*), 6) AS mean_probes FROM (SELECT {sql_h('k')} % {_CAP} AS slot FROM ({_FAR})) JOIN ({_N}) ON s = slot")
def chain_miss_cost(spark: SparkSession, d: str) -> DataFrame:
    """Probes of keys that the table doesn't hold."""
    o, capacity = _orders(spark, d)
    far = o.select((F.col("o_orderkey") + 1_000_000_000).alias("o_orderkey"))
    return tables.chain_misses(o, far, "o_orderkey", capacity).withColumn("mean_probes", r6(F.col("mean_probes")))


def _probing(cap: str) -> str:
    n = f"SELECT s, count(k) AS n FROM (SELECT unnest(range({cap})) AS s) LEFT JOIN (SELECT {sql_h('k')} % {cap} AS slot, k FROM ({_K})) ON slot = s GROUP BY s"
    return f"""r AS (SELECT l, s, n, l * {cap} + s AS p FROM ({n}), range(2) t(l)),
x AS (SELECT *, sum(n - 1) OVER (ORDER BY p)::BIGINT AS t FROM r),
y AS (SELECT *, t - least(0, min(t) OVER (ORDER BY p)) AS q FROM x),
z AS (SELECT *, coalesce(lag(q) OVER (ORDER BY p), 0) AS before FROM y)"""


@query(f"WITH {_probing(_CAP)} SELECT sum(n)::BIGINT AS n_keys, sum(n + q)::BIGINT AS probes, round(sum(n + q) / sum(n), 6) AS mean_probes, round(sum(n) / count(*), 6) AS load_factor FROM z WHERE l = 1")
def linear_probe_cost(spark: SparkSession, d: str) -> DataFrame:
    o, capacity = _orders(spark, d)
    return tables.linear_probe_cost(o, "o_orderkey", capacity).withColumns({c: r6(F.col(c)) for c in ("mean_probes", "load_factor")})


@query(f"WITH {_probing(_CAP)} SELECT s AS slot, before + n >= 1 AS occupied FROM z WHERE l = 1")
def linear_probe_occupancy(spark: SparkSession, d: str) -> DataFrame:
    o, capacity = _orders(spark, d)
    return tables.linear_probing(o, "o_orderkey", capacity).select("slot", "occupied")


LOADS = (0.3, 0.5, 0.75, 0.9)


def _sweep_sql() -> str:
    parts = []
    for a in LOADS:
        cap = f"(SELECT ceil(count(*) / {a}::DOUBLE)::BIGINT FROM ({_K}))"
        parts.append(f"""SELECT {a}::DOUBLE AS load, round(c.p / c.k, 6) AS chaining, round(o.p / o.k, 6) AS linear, round(1 + {a} / 2, 6) AS chaining_theory, round((1 + 1 / (1 - {a})) / 2, 6) AS linear_theory
FROM (SELECT sum(n * (n + 1) / 2) AS p, sum(n) AS k FROM (SELECT slot, count(*) AS n FROM (SELECT {sql_h('k')} % {cap} AS slot FROM ({_K})) GROUP BY slot)) c,
(WITH {_probing(cap)} SELECT sum(n + q) AS p, sum(n) AS k FROM z WHERE l = 1) o""")
    return " UNION ALL ".join(parts)


@query(_sweep_sql())
def probe_cost_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Mean probes by load factor, both strategies pivoted side by side with their theory."""
    o = table(spark, d, "orders").select("o_orderkey")
    n, parts = o.distinct().count(), []
    for a in LOADS:
        capacity = F.lit(a)
        slots = math.ceil(n / a)
        for name, f in (("chaining", tables.chain_probes), ("linear", tables.linear_probe_cost)):
            parts.append(f(o, "o_orderkey", slots).select(capacity.alias("load"), F.lit(name).alias("strategy"), "mean_probes"))
    wide = union(parts).groupBy("load").pivot("strategy", ["chaining", "linear"]).agg(F.first("mean_probes"))
    return wide.select("load", r6(F.col("chaining")).alias("chaining"), r6(F.col("linear")).alias("linear"), r6(1 + F.col("load") / 2).alias("chaining_theory"), r6((1 + 1 / (1 - F.col("load"))) / 2).alias("linear_theory"))


@query("""SELECT n * 200 AS n, min(j) AS n_resizes, (16 * 2 ** min(j))::BIGINT AS capacity FROM range(101) a(n), range(41) b(j) WHERE n * 200 <= 0.75 * 16 * 2 ** j GROUP BY n""")
def table_growth(spark: SparkSession, d: str) -> DataFrame:
    out = tables.growth(spark.range(0, 20_001, 200).withColumnRenamed("id", "n"), "n")
    return out.select("n", F.col("n_resizes").cast("bigint").alias("n_resizes"), "capacity")


@query("SELECT count(*) AS n_keys, sum(strlen(k) + 100)::BIGINT AS memory_bytes FROM (SELECT DISTINCT c_name AS k FROM customer)")
def table_memory(spark: SparkSession, d: str) -> DataFrame:
    return tables.modelled_bytes(table(spark, d, "customer"), "c_name")


@query()
def table_replay(spark: SparkSession, d: str) -> DataFrame:
    """Open addressing with tombstones, one table an event type, replayed in order: a user's odd visits put, even ones delete."""
    visit = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("event_id"))
    e = table(spark, d, "events").withColumn("op", F.when(visit % 2 == 1, "put").otherwise("delete"))
    users = e.select("user_id").distinct().count()
    return tables.replay(e, "event_type", "event_id", "op", "user_id", 2 * users)


# ---- Bloom filters --------------------------------------------------------------------------

TARGETS = (0.1, 0.05, 0.01, 0.001, 0.0001)
_M, _KK = "greatest(1, ceil(-n * ln(p) / (ln(2) ** 2)))::BIGINT", "greatest(1, round_even(m / n * ln(2), 0))::BIGINT"


@query(f"""WITH g AS (SELECT n, p, {_M} AS m FROM (SELECT unnest([100000, 1000000000]) AS n), (SELECT unnest([0.1, 0.05, 0.01, 0.001, 0.0001]::DOUBLE[]) AS p)), h AS (SELECT *, {_KK} AS k FROM g)
SELECT n::BIGINT AS n_items, p AS target_fp_rate, m AS n_bits, k AS n_hashes, ceil(m / 8)::BIGINT AS memory_bytes, round(m / n, 6) AS bits_per_item, round((1 - exp(-k * n / m)) ** k, 6) AS achieved_fp_rate FROM h""")
def bloom_sizing(spark: SparkSession, d: str) -> DataFrame:
    rows = [sizing.bloom(n, p) for n in (100_000, 1_000_000_000) for p in TARGETS]
    out = spark.createDataFrame([(g.expected_items, g.target_fp_rate, g.n_bits, g.n_hashes, g.memory_bytes, g.bits_per_item, g.achieved_fp_rate) for g in rows], "n_items long, target_fp_rate double, n_bits long, n_hashes long, memory_bytes long, bits_per_item double, achieved_fp_rate double")
    return out.withColumns({c: r6(F.col(c)) for c in ("bits_per_item", "achieved_fp_rate")})


@query(f"""WITH b AS (SELECT avg(strlen(c_name) + 100) AS b FROM (SELECT DISTINCT c_name FROM customer)), g AS (SELECT n, 0.01::DOUBLE AS p, b FROM (SELECT unnest([1000000, 10000000, 100000000, 1000000000]) AS n), b), h AS (SELECT *, {_M} AS m FROM g)
SELECT n::BIGINT AS n_items, round(b * n, 0)::BIGINT AS exact_set_bytes, ceil(m / 8)::BIGINT AS bloom_bytes, round(b * n / ceil(m / 8), 4) AS savings_factor, false AS measured FROM h""")
def bloom_projection(spark: SparkSession, d: str) -> DataFrame:
    """Sizes at scales too large to build; the exact side is modelled from the customers' names."""
    each = table(spark, d, "customer").select("c_name").distinct().agg(F.avg(F.octet_length("c_name") + 100).alias("b"))
    sizes = spark.createDataFrame([(n, sizing.bloom(n, 0.01).memory_bytes) for n in (10**6, 10**7, 10**8, 10**9)], "n_items long, bloom_bytes long")
    return sizes.join(F.broadcast(each)).select("n_items", F.round(F.col("b") * F.col("n_items")).cast("bigint").alias("exact_set_bytes"), "bloom_bytes", F.round(F.col("b") * F.col("n_items") / F.col("bloom_bytes"), 4).alias("savings_factor"), F.lit(False).alias("measured"))


def _bloom_sql(p: float, multiple: float = 1.0) -> str:
    """CTEs m, k, bits over the distinct l_orderkey of lineitem, and f: found by o_orderkey of orders."""
    return f"""c AS (SELECT greatest(1, round_even(count(DISTINCT l_orderkey) / {multiple}, 0))::BIGINT AS n, {p}::DOUBLE AS p FROM lineitem), g AS (SELECT n, {_M} AS m FROM c), h AS (SELECT *, {_KK} AS k FROM g),
i AS (SELECT DISTINCT l_orderkey AS x FROM lineitem),
b AS (SELECT DISTINCT {sql_index('x::VARCHAR', 'j', 'm')} AS bit FROM i, h, (SELECT unnest(range(30)) AS j) WHERE j < k),
q AS (SELECT o_orderkey AS x, o_orderkey IN (SELECT x FROM i) AS member FROM (SELECT DISTINCT o_orderkey FROM orders)),
f AS (SELECT x, member, bool_and(bit IS NOT NULL) AS found FROM (SELECT x, member, {sql_index('x::VARCHAR', 'j', 'm')} AS want FROM q, h, (SELECT unnest(range(30)) AS j) WHERE j < k) LEFT JOIN b ON bit = want GROUP BY x, member)"""


def _member_frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Distinct keys of orders with a line item, and those of all orders."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("x")).distinct(), table(spark, d, "orders").select(F.col("o_orderkey").alias("x")).distinct()


def _bloom_run(spark: SparkSession, d: str, p: float, multiple: float = 1.0):
    members, asked = _member_frames(spark, d)
    g = sizing.bloom(max(1, round(members.count() / multiple)), p)
    filter_ = bloom.build(members, "x", g)
    found = bloom.contains(asked, "x", filter_, g).join(members.withColumn("member", F.lit(True)), "x", "left").withColumn("member", F.coalesce("member", F.lit(False)))
    return g, filter_, found, members


@query(f"WITH {_bloom_sql(0.01)} SELECT member, found, count(*) AS n FROM f GROUP BY member, found")
def bloom_membership(spark: SparkSession, d: str) -> DataFrame:
    _, _, found, _ = _bloom_run(spark, d, 0.01)
    return found.groupBy("member", "found").agg(F.count("*").alias("n"))


def _curve(spark: SparkSession, d: str, name: str, steps: list[tuple[float, float, float]]) -> DataFrame:
    """A row a step (value of the column name, target rate, multiple of overfilling); all filters over one scan of the keys."""
    lines, orders = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("x")), table(spark, d, "orders").select(F.col("o_orderkey").alias("x"))
    keys = bloom_curve.keys(lines, orders, "x").persist()
    n = keys.where("kind < 2").count()
    shapes = [sizing.bloom(max(1, round(n / multiple)), p) for _, p, multiple in steps]
    rows = [
        (float(step[0]), g.n_bits, g.n_hashes, g.memory_bytes, bits, bits / g.n_bits, (bits / g.n_bits) ** g.n_hashes, rate, lost)
        for step, g, (bits, lost, rate) in zip(steps, shapes, bloom_curve.measured(keys, shapes))
    ]
    keys.unpersist()
    out = spark.createDataFrame(rows, f"{name} double, n_bits long, n_hashes long, memory_bytes long, bits_set long, fill_ratio double, estimated_fp_rate double, measured_fp_rate double, false_negatives long")
    return out.withColumns({c: r6(F.col(c)) for c in ("fill_ratio", "estimated_fp_rate", "measured_fp_rate")})


_CURVE = "m AS n_bits, k AS n_hashes, ceil(m / 8)::BIGINT AS memory_bytes, (SELECT count(*) FROM b) AS bits_set, round((SELECT count(*) FROM b) / m, 6) AS fill_ratio, round(((SELECT count(*) FROM b) / m) ** k, 6) AS estimated_fp_rate, round((SELECT avg(found::INT) FROM f WHERE NOT member), 6) AS measured_fp_rate, (SELECT count(*) FROM f WHERE member AND NOT found) AS false_negatives FROM h"


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {_bloom_sql(p)} SELECT {p}::DOUBLE AS target_fp_rate, {_CURVE})" for p in TARGETS))
def bloom_error_curve(spark: SparkSession, d: str) -> DataFrame:
    return _curve(spark, d, "target_fp_rate", [(p, p, 1.0) for p in TARGETS])


MULTIPLES = (0.5, 1.0, 2.0, 5.0)


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {_bloom_sql(0.01, x)} SELECT {x}::DOUBLE AS multiple, {_CURVE})" for x in MULTIPLES))
def bloom_overfill(spark: SparkSession, d: str) -> DataFrame:
    return _curve(spark, d, "multiple", [(x, 0.01, x) for x in MULTIPLES])


@query(f"WITH {_bloom_sql(0.01)} SELECT count(*) AS n_queries, round(avg(found::INT), 6) AS fp_rate FROM f WHERE NOT member")
def bloom_fp_rate(spark: SparkSession, d: str) -> DataFrame:
    members, asked = _member_frames(spark, d)
    g = sizing.bloom(max(1, members.count()), 0.01)
    return bloom.false_positive_rate(asked.join(members, "x", "left_anti"), "x", bloom.build(members, "x", g), g).select("n_queries", r6(F.col("fp_rate")).alias("fp_rate"))


@query(f"WITH {_bloom_sql(0.01)} SELECT bit % 2 = 0 AS even, count(*) AS bits_set FROM b GROUP BY bit % 2 = 0")
def bloom_union(spark: SparkSession, d: str) -> DataFrame:
    """The union of the filters of returned and of other line items' orders, as distinct bits."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("x"), "l_returnflag")
    g = sizing.bloom(max(1, lines.select("x").distinct().count()), 0.01)
    a, b = (bloom.build(lines.where(c), "x", g) for c in ("l_returnflag = 'R'", "l_returnflag <> 'R'"))
    both = bloom.union(a, b)
    places = F.sequence(F.lit(0), F.lit(4095))
    # bits of a bitmap byte by byte: the even ones are in the mask 0b01010101
    bytes_ = F.transform(places, lambda i: F.conv(F.hex(F.substr("bits", i + 1, F.lit(1))), 16, 10).cast("int"))
    ones = lambda mask: F.aggregate(bytes_, F.lit(0), lambda s, x: s + F.bit_count(x.bitwiseAND(F.lit(mask))))
    out = both.select(F.explode(F.array(F.struct(F.lit(True).alias("even"), ones(0b01010101).alias("n")), F.struct(F.lit(False).alias("even"), ones(0b10101010).alias("n")))).alias("e"))
    return out.groupBy("e.even").agg(F.sum("e.n").alias("bits_set"))


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40) GROUP BY l_returnflag")
def bloom_semi_join(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"))
    out = bloom.semi_join(table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_quantity"), part, "l_partkey")
    return out.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


# ---- counting Bloom filters -----------------------------------------------------------------

_CB = f"""c AS (SELECT count(DISTINCT user_id) AS n, 0.01::DOUBLE AS p FROM events), g AS (SELECT n, {_M} AS m FROM c), h AS (SELECT *, {_KK} AS k FROM g),
t AS (SELECT j FROM h, (SELECT unnest(range(30)) AS j) WHERE j < k)"""


def _cb(cte: str, items: str) -> str:
    return f"{cte} AS (SELECT {sql_index('x', 'j', 'm')} AS idx, count(*) AS raw FROM ({items}), h, t GROUP BY 1)"


def _users(spark: SparkSession, d: str) -> tuple[DataFrame, sizing.BloomGeometry]:
    e = table(spark, d, "events")
    return e, sizing.bloom(max(1, e.select("user_id").distinct().count()), 0.01)


_PAIR = "SELECT DISTINCT user_id::VARCHAR AS x, event_type FROM events"


@query(f"WITH {_CB}, {_cb('a', 'SELECT user_id::VARCHAR AS x FROM events')} SELECT count(*) AS nonzero, sum(greatest(raw - 255, 0))::BIGINT AS n_saturated, round(count(*) / (SELECT m FROM h), 6) AS fill_ratio, sum(least(raw, 255))::BIGINT AS total FROM a")
def counting_bloom_saturation(spark: SparkSession, d: str) -> DataFrame:
    e, g = _users(spark, d)
    f = counting_bloom.build(e, "user_id", g)
    return counting_bloom.stats(f, g).join(F.broadcast(f.agg(F.sum("cnt").alias("total")))).select("nonzero", "n_saturated", r6(F.col("fill_ratio")).alias("fill_ratio"), "total")


_AFTER = f"{_CB}, {_cb('a', f'SELECT x FROM ({_PAIR})')}, {_cb('b', _PAIR + chr(32) + 'WHERE event_type = ' + chr(39) + 'click' + chr(39))}, s AS (SELECT a.idx, greatest(least(a.raw, 255) - coalesce(b.raw, 0), 0) AS cnt FROM a LEFT JOIN b ON a.idx = b.idx)"


@query(f"WITH {_AFTER}, u AS (SELECT DISTINCT user_id FROM events) SELECT user_id, min(coalesce(cnt, 0))::BIGINT AS estimate FROM (SELECT user_id, {sql_index('user_id::VARCHAR', 'j', 'm')} AS idx FROM u, h, t) LEFT JOIN s USING (idx) GROUP BY user_id")
def counting_bloom_add_remove(spark: SparkSession, d: str) -> DataFrame:
    """Each user once an event type added, the clickers removed once: estimates after."""
    e, g = _users(spark, d)
    pairs = e.select("user_id", "event_type").distinct()
    after, _ = counting_bloom.remove(counting_bloom.build(pairs, "user_id", g), pairs.where("event_type = 'click'"), "user_id", g)
    return counting_bloom.count_estimate(e, "user_id", after, g).select("user_id", "estimate")


@query(f"WITH {_CB}, {_cb('a', 'SELECT DISTINCT user_id::VARCHAR AS x FROM events')} SELECT c_custkey AS user_id FROM (SELECT c_custkey, {sql_index('c_custkey::VARCHAR', 'j', 'm')} AS idx FROM customer, h, t) LEFT JOIN a USING (idx) GROUP BY c_custkey HAVING bool_or(raw IS NULL)")
def counting_bloom_refused(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose removal from the filter of the events' users is refused."""
    e, g = _users(spark, d)
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return counting_bloom.remove(counting_bloom.build(e.select("user_id").distinct(), "user_id", g), asked, "user_id", g)[1]


@query(f"WITH {_CB} SELECT m AS n_bits, k AS n_hashes, ceil(m / 8)::BIGINT AS bloom_bytes, m AS counting_bytes, round(m / ceil(m / 8), 4) AS multiple FROM h")
def counting_bloom_memory(spark: SparkSession, d: str) -> DataFrame:
    _, g = _users(spark, d)
    n = counting_bloom.memory_bytes(g)
    return spark.createDataFrame([(g.n_bits, g.n_hashes, g.memory_bytes, n, round(n / g.memory_bytes, 4))], "n_bits long, n_hashes long, bloom_bytes long, counting_bytes long, multiple double")


# ---- HyperLogLog ----------------------------------------------------------------------------


def sql_regs(source: str, e: str, p: int, keys: str = "", seed: int = 0) -> str:
    """SELECT of keys, reg, rank."""
    rest, k = 60 - p, f"{keys}, " if keys else ""
    h = sql_h(e, seed)
    low = f"({h} & {(1 << rest) - 1})"
    return f"SELECT {k}({h} >> {rest}) AS reg, max(CASE WHEN {low} = 0 THEN {rest + 1} ELSE {rest} - length(ltrim(bin({low}), '0')) + 1 END) AS rank FROM {source} GROUP BY {k}reg"


def sql_estimate(regs: str, p: int, keys: str = "") -> str:
    m, k = 1 << p, f"{keys}, " if keys else ""
    a = sizing.hll_alpha(m)
    return f"""SELECT {k}v, raw, CASE WHEN raw <= 2.5 * {m} AND v > 0 THEN {m} * ln({m}::DOUBLE / v) ELSE raw END AS est
FROM (SELECT {k}{m} - count(*) AS v, {a * m * m!r} / (sum(2.0::DOUBLE ** -rank) + {m} - count(*)) AS raw FROM ({regs}) {f"GROUP BY {keys}" if keys else ""})"""


G11 = sizing.HllGeometry(11)


@query("""WITH p AS (SELECT unnest(range(4, 19)) AS p), e AS (SELECT unnest([0.05, 0.02, 0.01]::DOUBLE[]) AS e)
SELECT e AS target_error, min(p) AS precision, (2 ** min(p))::BIGINT AS n_registers, round(1.04 / sqrt(2 ** min(p)), 6) AS standard_error, ceil(6 * 2 ** min(p) / 8)::BIGINT AS packed_memory_bytes FROM e, p WHERE 1.04 / sqrt(2 ** p) <= e GROUP BY e""")
def hll_sizing(spark: SparkSession, d: str) -> DataFrame:
    rows = [(e, g.precision, g.m, round(g.standard_error, 6), g.packed_memory_bytes) for e in (0.05, 0.02, 0.01) for g in [sizing.hll_for_error(e)]]
    return spark.createDataFrame(rows, "target_error double, precision long, n_registers long, standard_error double, packed_memory_bytes long")


@query(f"""SELECT v AS zero_registers, round(raw, 6) AS raw_estimate, round(est, 6) AS estimate, round_even(est, 0)::BIGINT AS count, n AS exact, round((est - n) / n, 6) AS relative_error
FROM ({sql_estimate(sql_regs("events", "user_id::VARCHAR", 11), 11)}), (SELECT count(DISTINCT user_id) AS n FROM events)""")
def hll_events_users(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users, estimated and exact: one scan of one column each."""
    e = table(spark, d, "events").select("user_id")
    est = hll.estimate(hll.registers(e, "user_id", G11), G11)
    exact = e.agg(F.countDistinct("user_id").alias("exact"))
    out = est.join(F.broadcast(exact))  # one row each
    return out.select("zero_registers", r6(F.col("raw_estimate")).alias("raw_estimate"), r6(F.col("estimate")).alias("estimate"), "count", "exact", r6((F.col("estimate") - F.col("exact")) / F.col("exact")).alias("relative_error"))


@query(f"""SELECT l_returnflag, l_linestatus, round(est, 6) AS estimate FROM ({sql_estimate(sql_regs("lineitem", "l_partkey::VARCHAR", 11, "l_returnflag, l_linestatus"), 11, "l_returnflag, l_linestatus")})""")
def hll_by_group(spark: SparkSession, d: str) -> DataFrame:
    keys = ["l_returnflag", "l_linestatus"]
    return hll.estimate(hll.registers(table(spark, d, "lineitem"), "l_partkey", G11, keys=keys), G11, keys).select(*keys, r6(F.col("estimate")).alias("estimate"))


@query(" UNION ALL ".join(
    f"SELECT {k} AS l_returnflag, {s} AS l_linestatus, {i}::BIGINT AS level, round(est, 6) AS estimate FROM ({sql_estimate(sql_regs('lineitem', 'l_partkey::VARCHAR', 11, g), 11, g)})"
    for i, (k, s, g) in enumerate((("NULL::VARCHAR", "NULL::VARCHAR", ""), ("l_returnflag", "NULL::VARCHAR", "l_returnflag"), ("l_returnflag", "l_linestatus", "l_returnflag, l_linestatus")))))
def hll_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Every level of a rollup from one set of registers."""
    keys = ["l_returnflag", "l_linestatus"]
    out = hll.rollup(hll.registers(table(spark, d, "lineitem"), "l_partkey", G11, keys=keys), G11, *keys)
    return out.select(*keys, F.col("level").cast("bigint").alias("level"), r6(F.col("estimate")).alias("estimate"))


_HLL_COLUMNS = (("part", "l_partkey"), ("order", "l_orderkey"), ("supplier", "l_suppkey"))


@query(" UNION ALL ".join(
    f"SELECT '{n}' AS item, {p}::BIGINT AS precision, x AS true_cardinality, round(est, 6) AS estimate, round((est - x) / x, 6) AS relative_error, round(1.04 / sqrt({1 << p}), 6) AS standard_error, abs(est - x) / x <= 2 * 1.04 / sqrt({1 << p}) AS within_2_sigma FROM ({sql_estimate(sql_regs('lineitem', f'{c}::VARCHAR', p), p)}), (SELECT count(DISTINCT {c}) AS x FROM lineitem)"
    for n, c in _HLL_COLUMNS for p in (8, 10, 12, 14)))
def hll_error_curve(spark: SparkSession, d: str) -> DataFrame:
    """Precision by cardinality grid; the registers of lower precisions fold out of the same scan of distinct values."""
    lines, parts = table(spark, d, "lineitem"), []
    for name, c in _HLL_COLUMNS:
        values = lines.select(c).distinct()
        exact = values.agg(F.count(c).alias("x"))
        for p in (8, 10, 12, 14):
            g = sizing.HllGeometry(p)
            e = hll.estimate(hll.registers(values, c, g), g).join(F.broadcast(exact))
            error = (F.col("estimate") - F.col("x")) / F.col("x")
            parts.append(e.select(F.lit(name).alias("item"), F.lit(p).cast("bigint").alias("precision"), F.col("x").alias("true_cardinality"), r6(F.col("estimate")).alias("estimate"), r6(error).alias("relative_error"), r6(F.lit(g.standard_error)).alias("standard_error"), (F.abs(error) <= 2 * g.standard_error).alias("within_2_sigma")))
    return union(parts)


_HALF = "'2024-01-11'", "'2024-01-21'"


@query(f"""WITH a AS (SELECT * FROM events WHERE ts < {_HALF[1]}), b AS (SELECT * FROM events WHERE ts >= {_HALF[0]}), x AS ({sql_regs("a", "event_id::VARCHAR", 11)}), y AS ({sql_regs("b", "event_id::VARCHAR", 11)}), u AS (SELECT reg, max(rank) AS rank FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY reg)
SELECT round((SELECT est FROM ({sql_estimate("FROM u", 11)})), 6) AS merged, round((SELECT est FROM ({sql_estimate("FROM x", 11)})) + (SELECT est FROM ({sql_estimate("FROM y", 11)})), 6) AS naive_sum, (SELECT count(*) FROM events) AS exact""")
def hll_merge_days(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping periods merged, against the naive sum."""
    e = table(spark, d, "events")
    a, b = (hll.registers(e.where(c), "event_id", G11) for c in ("ts < timestamp '2024-01-21'", "ts >= timestamp '2024-01-11'"))
    one = lambda regs, name: hll.estimate(regs, G11).select(F.col("estimate").alias(name))
    out = one(hll.merge(a, b), "m").join(F.broadcast(one(a, "a"))).join(F.broadcast(one(b, "b"))).join(F.broadcast(e.agg(F.count("*").alias("exact"))))  # one row each
    return out.select(r6(F.col("m")).alias("merged"), r6(F.col("a") + F.col("b")).alias("naive_sum"), "exact")


@query(f"""WITH e AS (SELECT ts::DATE AS day, event_id FROM events), d AS (SELECT DISTINCT day AS upto FROM e), x AS ({sql_regs("e", "event_id::VARCHAR", 11, "day")}), c AS (SELECT upto, reg, max(rank) AS rank FROM d JOIN x ON day <= upto GROUP BY upto, reg)
SELECT upto AS day, round(est, 4) AS estimate, round(est * (1 - 2 * 1.04 / sqrt(2048)), 4) AS low, round(est * (1 + 2 * 1.04 / sqrt(2048)), 4) AS high FROM ({sql_estimate("FROM c", 11, "upto")})""")
def hll_running_trace(spark: SparkSession, d: str) -> DataFrame:
    """The estimate after each day, with its two-sigma band."""
    out = hll.running(table(spark, d, "events").withColumn("day", F.to_date("ts")), "event_id", "day", G11)
    band = G11.error_band(2)
    return out.select("day", F.round("estimate", 4).alias("estimate"), F.round(F.col("estimate") * (1 - band), 4).alias("low"), F.round(F.col("estimate") * (1 + band), 4).alias("high"))


@query()
def hll_native(spark: SparkSession, d: str) -> DataFrame:
    return hll.native_estimate(table(spark, d, "lineitem"), "l_partkey", 11, ["l_returnflag"])


@query()
def approx_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("estimate"))


# ---- Count-Min ------------------------------------------------------------------------------

CG = sizing.CountMinGeometry()


def sql_cells(items: str, e: str, w: str = "1") -> str:
    return f"SELECT j AS row, {sql_index(e, 'j', CG.width)} AS col, sum({w})::BIGINT AS cnt FROM {items}, range({CG.depth}) r(j) GROUP BY ALL"


def sql_cms(cells: str, asked: str, e: str, key: str) -> str:
    return f"SELECT {key}, min(coalesce(cnt, 0))::BIGINT AS estimate FROM (SELECT DISTINCT {key}, j AS row, {sql_index(e, 'j', CG.width)} AS col FROM {asked}, range({CG.depth}) r(j)) LEFT JOIN ({cells}) USING (row, col) GROUP BY {key}"


_CELLS = sql_cells("lineitem", "l_partkey::VARCHAR")


@query(f"SELECT p_partkey, estimate, n AS total, round(0.001::DOUBLE * n, 6) AS error_bound, round(greatest(0, estimate - 0.001::DOUBLE * n), 6) AS lower_bound FROM ({sql_cms(_CELLS, 'part', 'p_partkey::VARCHAR', 'p_partkey')}), (SELECT count(*) AS n FROM lineitem)")
def cms_estimate(spark: SparkSession, d: str) -> DataFrame:
    sketch = cms.build(table(spark, d, "lineitem"), "l_partkey")
    out = cms.estimate_with_bound(table(spark, d, "part"), "p_partkey", sketch).join(F.broadcast(cms.total(sketch)))
    return out.select("p_partkey", "estimate", "total", r6(F.col("error_bound")).alias("error_bound"), r6(F.col("lower_bound")).alias("lower_bound"))


@query(f"""WITH t AS (SELECT l_partkey, count(*) AS true_count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT l_partkey, true_count, estimate, estimate - true_count AS overshoot, round(0.001::DOUBLE * n, 6) AS error_bound, estimate - true_count <= 0.001 * n AS within_bound, {CG.memory_bytes}::BIGINT AS memory_bytes FROM t JOIN ({sql_cms(_CELLS, 'lineitem', 'l_partkey::VARCHAR', 'l_partkey')}) USING (l_partkey), (SELECT count(*) AS n FROM lineitem)""")
def cms_error_report(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    top, sketch = cms.top_k(lines, "l_partkey", 10).withColumnRenamed("cnt", "true_count"), cms.build(lines, "l_partkey")
    out = top.join(cms.estimate_with_bound(top, "l_partkey", sketch), "l_partkey")
    over = F.col("estimate") - F.col("true_count")
    return out.select("l_partkey", "true_count", "estimate", over.alias("overshoot"), r6(F.col("error_bound")).alias("error_bound"), (over <= F.col("error_bound")).alias("within_bound"), F.lit(CG.memory_bytes).cast("bigint").alias("memory_bytes"))


_USERS = sql_cells("events", "user_id::VARCHAR")


@query(f"""SELECT user_id, estimate, t.n AS true_count FROM ({sql_cms(_USERS, 'events', 'user_id::VARCHAR', 'user_id')}) JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) t USING (user_id) WHERE estimate >= 0.007 * (SELECT count(*) FROM events)""")
def cms_heavy_hitters(spark: SparkSession, d: str) -> DataFrame:
    """Users with at least 0.7 % of the events, with the truth beside."""
    e = table(spark, d, "events")
    heavy = cms.heavy_hitters(e, "user_id", cms.build(e, "user_id"), 0.007)
    return heavy.join(e.groupBy("user_id").agg(F.count("*").alias("true_count")), "user_id").select("user_id", "estimate", "true_count")


@query(sql_cms(sql_cells("lineitem", "l_suppkey::VARCHAR", "l_quantity::BIGINT"), "supplier", "s_suppkey::VARCHAR", "s_suppkey"))
def cms_weighted(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumn("w", F.col("l_quantity").cast("bigint"))
    return cms.estimate(table(spark, d, "supplier"), "s_suppkey", cms.build(lines, "l_suppkey", weight="w"))


@query(f"SELECT row, count(*) AS n_cells, sum(cnt)::BIGINT AS total, max(cnt) AS largest FROM ({_CELLS}) GROUP BY row")
def cms_merge(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    a, b = (cms.build(lines.where(c), "l_partkey") for c in ("l_returnflag = 'R'", "l_returnflag <> 'R'"))
    return cms.merge(a, b).groupBy(F.col("row").cast("bigint").alias("row")).agg(F.count("*").alias("n_cells"), F.sum("cnt").alias("total"), F.max("cnt").alias("largest"))


@query("SELECT l_partkey, count(*) AS cnt FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def topk_exact(spark: SparkSession, d: str) -> DataFrame:
    return cms.top_k(table(spark, d, "lineitem"), "l_partkey", 10)


@query()
def topk_native(spark: SparkSession, d: str) -> DataFrame:
    return cms.top_k_native(table(spark, d, "lineitem"), "l_partkey", 10)


# ---- shingles, MinHash, LSH -----------------------------------------------------------------


def sql_shingles(source: str, id_: str) -> str:
    """SELECT of id, s: the distinct word 5-shingles."""
    return rf"""SELECT DISTINCT id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM (SELECT {id_} AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM {source}) WHERE len(w) > 0)"""


_SH = sql_shingles("documents", "doc_id")


def _digest(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda t, x: t + F.pmod(H.h(x), F.lit(1_000_003)))


@query(f"SELECT doc_id, count(s) AS n_shingles, coalesce(sum({sql_h('s')} % 1000003), 0)::BIGINT AS digest FROM documents LEFT JOIN ({_SH}) ON id = doc_id GROUP BY doc_id")
def shingles_word(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", similarity.shingles(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").cast("bigint").alias("n_shingles"), _digest(F.col("s")).alias("digest"))


@query(rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[\s\x0B\x1C-\x1F\x85\p{{Z}}]+', ' ', 'g')) AS t FROM documents),
s AS (SELECT DISTINCT doc_id, substr(t, i, 5) AS s FROM (SELECT doc_id, t, unnest(generate_series(1, greatest(1, length(t) - 4))) AS i FROM t WHERE length(t) > 0))
SELECT doc_id, count(s) AS n_shingles, coalesce(sum({sql_h('s')} % 1000003), 0)::BIGINT AS digest FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id""")
def shingles_char(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", similarity.shingles(F.col("text"), 5, "char").alias("s"))
    return docs.select("doc_id", F.size("s").cast("bigint").alias("n_shingles"), _digest(F.col("s")).alias("digest"))


_PAIRS = f"""sh AS ({_SH}), sz AS (SELECT id, count(*) AS n FROM sh GROUP BY id), pr AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.id < y.id GROUP BY ALL),
tr AS (SELECT a, b, c / (p.n + q.n - c) AS j FROM pr JOIN sz p ON p.id = a JOIN sz q ON q.id = b WHERE c / (p.n + q.n - c) >= 0.5)"""


@query(f"WITH {_PAIRS} SELECT a, b, round(j, 6) AS jaccard FROM tr")
def jaccard_exact_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.exact_pairs(table(spark, d, "documents"), "doc_id", "text").select("a", "b", r6(F.col("jaccard")).alias("jaccard"))


def sql_signatures(shingles: str, num_perm: int) -> str:
    """SELECT of id and m0...: the portable signature."""
    cols = ", ".join(f"min((x * {a} + {b}) % {similarity.PRIME}) AS m{i}" for i, (a, b) in enumerate(similarity.portable_permutations(num_perm)))
    return f"SELECT id, {cols} FROM (SELECT id, {sql_h('s')} % {similarity.PRIME} AS x FROM ({shingles})) GROUP BY id"


NP = 16


def _signatures(spark: SparkSession, d: str, name: str = "documents", id_: str = "doc_id") -> DataFrame:
    return similarity.text_signatures(table(spark, d, name), id_, "text", NP, "portable")


@query(f"SELECT id AS doc_id, {', '.join(f'm{i}' for i in range(NP))} FROM ({sql_signatures(_SH, NP)})")
def minhash_signatures(spark: SparkSession, d: str) -> DataFrame:
    return _signatures(spark, d).select(F.col("id").alias("doc_id"), *[F.col("sig")[i].alias(f"m{i}") for i in range(NP)])


_SIM = (0.2, 0.4, 0.6, 0.8, 0.95)


@query("WITH " + f"""t AS (SELECT target, round_even(2 * 500 * target / (1 + target), 0)::BIGINT AS c FROM (SELECT unnest({list(_SIM)}::DOUBLE[]) AS target)),
s AS (SELECT target, 'l' AS side, '0 a ' || i AS s FROM t, range(500) r(i) UNION ALL SELECT target, 'r', CASE WHEN i < c THEN '0 a ' ELSE '0 b ' END || i FROM t, range(500) r(i)),
m AS (SELECT target, side, {", ".join(f"min((({sql_h('s')} % {similarity.PRIME}) * {a} + {b}) % {similarity.PRIME}) AS m{i}" for i, (a, b) in enumerate(similarity.portable_permutations(64)))} FROM s GROUP BY target, side)
SELECT t.target AS target, round(c / (1000 - c), 6) AS true_jaccard, round(({" + ".join(f"(l.m{i} = r.m{i})::INT" for i in range(64))}) / 64, 6) AS estimated_jaccard,
abs(({" + ".join(f"(l.m{i} = r.m{i})::INT" for i in range(64))}) / 64 - c / (1000 - c)) <= 3 * sqrt(c / (1000 - c) * (1 - c / (1000 - c)) / 64) + 1e-9 AS within_3_sigma, 512::BIGINT AS signature_bytes
FROM t JOIN m l ON l.target = t.target AND l.side = 'l' JOIN m r ON r.target = t.target AND r.side = 'r'""")
def minhash_error_curve(spark: SparkSession, d: str) -> DataFrame:
    sets = datagen.sets_with_jaccard(spark, list(_SIM), 500).withColumn("id", F.struct("target", "side"))
    sigs = similarity.signatures(sets, 64, "portable")
    left, right = (sigs.where(F.col("id.side") == s).select(F.col("id.target").alias("target"), F.col("sig").alias(s)) for s in ("left", "right"))
    shared = F.bround(1000 * F.col("target") / (1 + F.col("target")))
    out = left.join(right, "target").select("target", (shared / (1000 - shared)).alias("j"), similarity.estimated_jaccard(F.col("left"), F.col("right")).alias("e"))
    sigma = F.sqrt(F.greatest(F.col("j") * (1 - F.col("j")), F.lit(1e-12)) / 64)
    return out.select("target", r6(F.col("j")).alias("true_jaccard"), r6(F.col("e")).alias("estimated_jaccard"), (F.abs(F.col("e") - F.col("j")) <= 3 * sigma + 1e-9).alias("within_3_sigma"), F.lit(512).cast("bigint").alias("signature_bytes"))


@query("""SELECT s / 20 AS similarity, b::BIGINT AS bands, r::BIGINT AS "rows", round(1 - (1 - (s / 20) ** r) ** b, 6) AS probability, round((1 / b) ** (1 / r), 6) AS threshold FROM range(21) t(s), (VALUES (16, 8), (32, 4), (64, 2)) v(b, r)""")
def lsh_s_curve(spark: SparkSession, d: str) -> DataFrame:
    rows = [(s / 20, b, r, round(sizing.candidate_probability(s / 20, b, r), 6), round(sizing.approximate_threshold(b, r), 6)) for s in range(21) for b, r in ((16, 8), (32, 4), (64, 2))]
    return spark.createDataFrame(rows, "similarity double, bands long, rows long, probability double, threshold double")


@query("""WITH s AS (SELECT n, t, b, n // b AS r, abs((1 / b) ** (1 / (n // b)) - t) AS gap FROM (VALUES (128), (64), (16)) v(n), (SELECT unnest([0.3, 0.5, 0.8]::DOUBLE[]) AS t), range(1, 129) w(b) WHERE n % b = 0)
SELECT n::BIGINT AS num_perm, t AS target, (arg_min(b, gap * 1000000 + b / 1000000))::BIGINT AS bands, (arg_min(r, gap * 1000000 + b / 1000000))::BIGINT AS "rows" FROM s GROUP BY n, t""")
def lsh_choose_parameters(spark: SparkSession, d: str) -> DataFrame:
    rows = [(n, t, *sizing.choose_banding(n, t)) for n in (128, 64, 16) for t in (0.3, 0.5, 0.8)]
    return spark.createDataFrame(rows, "num_perm long, target double, bands long, rows long")


def sql_bands(sigs: str, bands: int, rows: int) -> str:
    chunk = " UNION ALL ".join(f"SELECT id, {b} AS band, {' || chr(44) || '.join(f'm{b * rows + i}' for i in range(rows))} AS chunk FROM ({sigs})" for b in range(bands))
    return f"SELECT id, band, chunk FROM ({chunk})"


_SIGS = f"sg AS MATERIALIZED ({sql_signatures(_SH, NP)})"


def sql_candidates(bands: int, rows: int) -> str:
    return f"SELECT DISTINCT x.id AS a, y.id AS b FROM ({sql_bands('FROM sg', bands, rows)}) x JOIN ({sql_bands('FROM sg', bands, rows)}) y ON x.band = y.band AND x.chunk = y.chunk AND x.id < y.id"


@query(f"WITH {_SIGS} {sql_candidates(8, 2)}")
def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    return similarity.candidate_pairs(similarity.band_keys(_signatures(spark, d), 8, 2))


@query(f"""WITH {_SIGS}, k AS ({sql_bands('FROM sg', 8, 2)}), n AS (SELECT count(*) AS n FROM sg), c AS (SELECT count(*) AS c FROM ({sql_candidates(8, 2)}))
SELECT n AS n_keys, (SELECT count(*) FROM (SELECT DISTINCT band, chunk FROM k)) AS n_buckets, c AS candidate_pairs, (n * (n - 1) // 2)::BIGINT AS all_pairs, round(c / (n * (n - 1) / 2), 6) AS work_ratio, (n * {8 * NP + 64})::BIGINT AS memory_bytes FROM n, c""")
def lsh_stats(spark: SparkSession, d: str) -> DataFrame:
    return similarity.lsh_stats(_signatures(spark, d), 8, 2).withColumn("work_ratio", r6(F.col("work_ratio")))


@query(f"""WITH {_SIGS}, n AS (SELECT count(*) AS n FROM sg), c AS (SELECT count(*) AS c FROM ({sql_candidates(8, 2)}))
SELECT m::BIGINT AS n_docs, (m * (m - 1) // 2)::BIGINT AS all_pairs, round(c / n * m, 4) AS projected_candidates, false AS measured FROM n, c, (SELECT unnest([10000, 100000, 1000000]::BIGINT[]) AS m)""")
def lsh_work_projection(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons at sizes not run: all pairs against the candidates a document has here."""
    one = similarity.lsh_stats(_signatures(spark, d), 8, 2).select((F.col("candidate_pairs") / F.col("n_keys")).alias("each"))
    sizes = spark.createDataFrame([(m, m * (m - 1) // 2) for m in (10**4, 10**5, 10**6)], "n_docs long, all_pairs long")
    return sizes.join(F.broadcast(one)).select("n_docs", "all_pairs", F.round(F.col("each") * F.col("n_docs"), 4).alias("projected_candidates"), F.lit(False).alias("measured"))


DEFAULT_PERM, DEFAULT_BANDINGS = 128, ((16, 8), (32, 4))


@query(f"WITH sg AS MATERIALIZED ({sql_signatures(sql_shingles('benchmark', 'item_id'), DEFAULT_PERM)}) " + " UNION ALL ".join(f'SELECT {b}::BIGINT AS bands, {r}::BIGINT AS "rows", (SELECT count(*) FROM sg) AS n_keys, count(*) AS candidate_pairs FROM ({sql_candidates(b, r)})' for b, r in DEFAULT_BANDINGS))
def lsh_default_geometry(spark: SparkSession, d: str) -> DataFrame:
    """128 permutations in both of their usual bandings, over the benchmark's items."""
    sigs = similarity.text_signatures(table(spark, d, "benchmark"), "item_id", "text", DEFAULT_PERM, "portable")
    n = sigs.agg(F.count("*").alias("n_keys"))
    return union([similarity.candidate_pairs(similarity.band_keys(sigs, b, r)).agg(F.count("*").alias("candidate_pairs")).join(F.broadcast(n)).select(F.lit(b).cast("bigint").alias("bands"), F.lit(r).cast("bigint").alias("rows"), "n_keys", "candidate_pairs") for b, r in DEFAULT_BANDINGS])


BANDINGS = ((4, 4), (8, 2), (16, 1))


@query(f"WITH {_SIGS}, {_PAIRS} " + " UNION ALL ".join(
    f"SELECT {b}::BIGINT AS bands, {r}::BIGINT AS \"rows\", round((1 / {b}) ** (1 / {r}), 6) AS threshold, (SELECT count(*) FROM tr) AS true_pairs, count(*) AS candidate_pairs, round(count(tr.a) / (SELECT count(*) FROM tr), 6) AS recall, round(count(tr.a) / count(*), 6) AS \"precision\" FROM ({sql_candidates(b, r)}) c LEFT JOIN tr ON c.a = tr.a AND c.b = tr.b" for b, r in BANDINGS))
def lsh_recall_report(spark: SparkSession, d: str) -> DataFrame:
    """Recall and precision of several bandings of one signature table against the exact pairs; null where nothing is to be found."""
    docs, sigs = table(spark, d, "documents"), _signatures(spark, d).persist()
    sigs.count()  # once, before jobs that run side by side ask for them
    pairs, member = similarity.pair_classes(docs, "doc_id", "text")
    hits = similarity.found_pairs(similarity.with_signatures(similarity.weighted(pairs, member), member, sigs), BANDINGS).first()
    parts = []
    for i, (b, r) in enumerate(BANDINGS):
        c = setjoin.candidates(sigs, b, r).select("candidate_pairs", F.lit(hits["true_pairs"]).cast("bigint").alias("true_pairs"), F.lit(hits[f"found_{i}"]).cast("bigint").alias("found"))
        parts.append(c.select(F.lit(b).cast("bigint").alias("bands"), F.lit(r).cast("bigint").alias("rows"), r6(F.lit(sizing.approximate_threshold(b, r))).alias("threshold"), "true_pairs", "candidate_pairs", r6(F.try_divide("found", "true_pairs")).alias("recall"), r6(F.try_divide("found", "candidate_pairs")).alias("precision")))
    sigs.unpersist()
    return union(parts)


@query(f"WITH {_SIGS}, {_PAIRS} SELECT c.a, c.b, round(j, 6) AS jaccard FROM ({sql_candidates(8, 2)}) c JOIN tr ON c.a = tr.a AND c.b = tr.b")
def lsh_verified_pairs(spark: SparkSession, d: str) -> DataFrame:
    # sets of 64-bit hashes: a fraction of the bytes in the joins, and compared as numbers
    sets = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.transform(similarity.shingles(F.col("text")), lambda s: F.xxhash64(s)).alias("s"))
    found = similarity.verified_pairs(lsh_candidates(spark, d), sets, 0.5)
    return found.select("a", "b", r6(F.col("jaccard")).alias("jaccard"))


@query(f"""WITH {_SIGS}, bg AS ({sql_signatures(sql_shingles('benchmark', 'item_id'), NP)})
SELECT DISTINCT y.id AS item_id, x.id AS doc_id FROM ({sql_bands('FROM sg', 16, 1)}) x JOIN ({sql_bands('FROM bg', 16, 1)}) y ON x.band = y.band AND x.chunk = y.chunk""")
def lsh_point_query(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share a bucket with a benchmark item."""
    keys, probes = (similarity.band_keys(_signatures(spark, d, *x), 16, 1) for x in (("documents", "doc_id"), ("benchmark", "item_id")))
    return similarity.query(keys, probes).select(F.col("probe").alias("item_id"), F.col("id").alias("doc_id"))


def sql_jaccards() -> str:
    same = " + ".join(f"(x.m{i} = y.m{i})::INT" for i in range(NP))
    return f"WITH {_SIGS}, {_PAIRS} SELECT tr.a, tr.b, round(({same}) / {NP}, 6) AS estimated, round(j, 6) AS jaccard FROM tr JOIN sg x ON x.id = tr.a JOIN sg y ON y.id = tr.b"


@query(sql_jaccards())
def minhash_estimated_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Estimated beside exact similarity of the true pairs."""
    docs = table(spark, d, "documents")
    pairs, member = similarity.pair_classes(docs, "doc_id", "text")
    # signatures of one document a class
    some = member.groupBy("class").agg(F.min("id").alias("doc_id")).select("doc_id")
    sigs = similarity.text_signatures(docs.join(F.broadcast(some), "doc_id", "left_semi"), "doc_id", "text", NP, "portable")
    signed = similarity.with_signatures(pairs, member, sigs)
    each = signed.select("a", "b", r6(similarity.estimated_jaccard(F.col("sig_a"), F.col("sig_b"))).alias("estimated"), r6(F.col("jaccard")).alias("jaccard"))
    return similarity.expanded(each, member)


# ---- feature hashing ------------------------------------------------------------------------

_TOK = "SELECT p_partkey, 'p_brand=' || p_brand AS token, 1.0::DOUBLE AS w FROM part UNION ALL SELECT p_partkey, 'p_type=' || p_type, 1 FROM part UNION ALL SELECT p_partkey, 'p_name=' || p_name, 1 FROM part UNION ALL SELECT p_partkey, 'p_size', p_size FROM part"
_SIGN = f"(CASE WHEN ({sql_h('token')} >> 59) & 1 = 0 THEN 1 ELSE -1 END)"
PART_COLUMNS = ["p_brand", "p_type", "p_name", "p_size"]


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return features.tokens(table(spark, d, "part"), "p_partkey", PART_COLUMNS)


@query(f"SELECT p_partkey, {sql_h('token')} % 64 AS bucket, sum({_SIGN} * w) AS weight FROM ({_TOK}) GROUP BY ALL")
def fh_transform(spark: SparkSession, d: str) -> DataFrame:
    return features.transform(_tokens(spark, d), "p_partkey", 64)


@query(f"SELECT {sql_h('token')} % 64 AS bucket, token, {_SIGN} AS sign FROM (SELECT DISTINCT token FROM ({_TOK}))")
def fh_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = features.assignments(_tokens(spark, d), "token", 64)
    return t.select("bucket", "token", features.sign_of(F.col("token")).alias("sign"))


BUCKETS = (16, 32, 64, 128, 256, 512, 1024, 4096)


@query(f"WITH t AS (SELECT DISTINCT 'user_id=' || c_name AS token FROM customer), n AS (SELECT count(*) AS n FROM t) " + " UNION ALL ".join(
    f"SELECT {b}::BIGINT AS n_buckets, n AS n_tokens, round(1 - (SELECT count(DISTINCT {sql_h('token')} % {b}) FROM t) / n, 6) AS measured, round(greatest(0, 1 - {b} * (1 - (1 - 1 / {b}) ** n) / n), 6) AS expected, {8 * b}::BIGINT AS bytes_per_row FROM n" for b in BUCKETS))
def fh_collision_curve(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "customer").select(F.concat(F.lit("user_id="), "c_name").alias("token"))
    n = F.col("n_tokens")
    expected = lambda b: F.greatest(F.lit(0.0), 1 - b * (1 - F.pow(F.lit(1 - 1 / b), n)) / n)
    return union([features.collision_rate(tokens, "token", b).select(F.lit(b).cast("bigint").alias("n_buckets"), n, r6(F.col("collision_rate")).alias("measured"), r6(expected(b)).alias("expected"), F.lit(8 * b).cast("bigint").alias("bytes_per_row")) for b in BUCKETS])


@query("WITH b AS (SELECT avg(strlen(c_name) + 100) AS b FROM (SELECT DISTINCT c_name FROM customer)) SELECT n::BIGINT AS n_categories, round(b * n, 0)::BIGINT AS vocabulary_bytes, 2048::BIGINT AS hashed_bytes_per_row, false AS measured FROM (SELECT unnest([10000, 1000000, 100000000]) AS n), b")
def fh_vocabulary_projection(spark: SparkSession, d: str) -> DataFrame:
    """Modelled bytes of a one-hot vocabulary at sizes not built, against a row of 256 buckets."""
    each = table(spark, d, "customer").select("c_name").distinct().agg(F.avg(F.octet_length("c_name") + 100).alias("b"))
    sizes = spark.createDataFrame([(n,) for n in (10**4, 10**6, 10**8)], "n_categories long")
    return sizes.join(F.broadcast(each)).select("n_categories", F.round(F.col("b") * F.col("n_categories")).cast("bigint").alias("vocabulary_bytes"), F.lit(2048).cast("bigint").alias("hashed_bytes_per_row"), F.lit(False).alias("measured"))


@query(f"SELECT bucket, array_to_string(list_sort(list(token)), '|') AS tokens FROM (SELECT DISTINCT token, {sql_h('token')} % 64 AS bucket FROM ({_TOK})) GROUP BY bucket HAVING count(*) > 1")
def fh_colliding_groups(spark: SparkSession, d: str) -> DataFrame:
    return features.colliding_groups(_tokens(spark, d), "token", 64).select("bucket", F.array_join("tokens", "|").alias("tokens"))


@query(" UNION ALL ".join(
    f"SELECT {b}::BIGINT AS n_buckets, round(sum(abs(s)), 4) AS signed_mass, round(sum(abs(u)), 4) AS unsigned_mass, round(sum(abs(u)) - sum(abs(s)), 4) AS cancelled, (SELECT round(avg({_SIGN}), 6) FROM (SELECT DISTINCT token FROM ({_TOK}))) AS mean_sign FROM (SELECT p_partkey, {sql_h('token')} % {b} AS k, sum({_SIGN} * w) AS s, sum(w) AS u FROM ({_TOK}) GROUP BY ALL)" for b in (16, 64, 256)))
def fh_signed_vs_unsigned(spark: SparkSession, d: str) -> DataFrame:
    """Signed and unsigned weights merged on the number of buckets."""
    tokens = _tokens(spark, d)
    mean = tokens.select("token").distinct().agg(r6(F.avg(features.sign_of(F.col("token")))).alias("mean_sign"))
    side = lambda alternate, name: union([features.transform(tokens, "p_partkey", b, alternate=alternate).agg(F.lit(b).cast("bigint").alias("n_buckets"), F.round(F.sum(F.abs("weight")), 4).alias(name)) for b in (16, 64, 256)])
    out = side(True, "signed_mass").join(side(False, "unsigned_mass"), "n_buckets").join(F.broadcast(mean))
    return out.select("n_buckets", "signed_mass", "unsigned_mass", F.round(F.col("unsigned_mass") - F.col("signed_mass"), 4).alias("cancelled"), "mean_sign")


@query(f"WITH x AS (SELECT p_partkey, {sql_h('token')} % 32 AS b, sum({_SIGN} * w) AS v FROM ({_TOK}) GROUP BY ALL) SELECT p.b AS i, q.b AS j, round(sum(p.v * q.v), 6) AS value FROM x p JOIN x q USING (p_partkey) GROUP BY ALL")
def fh_gram(spark: SparkSession, d: str) -> DataFrame:
    hashed = features.transform(_tokens(spark, d), "p_partkey", 32)
    return features.gram(hashed, "p_partkey").select("i", "j", r6(F.col("value")).alias("value"))


@query()
def fh_ridge_r2(spark: SparkSession, d: str) -> DataFrame:
    """Hold-out R squared by number of buckets, signed and unsigned, and the knee: the fewest buckets at 98 % of the peak."""
    rows = datagen.categorical_table(spark, 5_000, 800, 120)
    tokens = features.tokens(rows, "row_id", ["user_id", "city", "device"])
    out = []
    for signed in (True, False):
        for b in (16, 64, 256, 512):
            x = features.transform(tokens, "row_id", b, alternate=signed).join(rows.select("row_id", "y"), "row_id").persist()
            out.append((b, signed, features.ridge_r2(x.where("row_id < 3750"), x.where("row_id >= 3750"), "y", "row_id", b)))
            x.unpersist()
    df = spark.createDataFrame(out, "n_buckets long, alternate_sign boolean, test_r2 double")
    peak = F.max("test_r2").over(Window.partitionBy("alternate_sign"))
    near = F.min(F.when(F.col("test_r2") >= 0.98 * F.col("peak"), F.col("n_buckets"))).over(Window.partitionBy("alternate_sign"))
    return df.withColumn("peak", peak).withColumn("knee", near).drop("peak")


# ---- generated data -------------------------------------------------------------------------

_FACTS = (("stream zipf", "items", 20_000), ("stream zipf", "distinct", 2_000), ("stream uniform", "items", 20_000), ("stream uniform", "distinct", 2_000), ("absent", "items", 500), ("absent", "in the stream", 0),
          ("unique", "distinct", 3_000), ("corpus", "documents", 300), ("corpus", "words a document", 60), ("corpus", "planted pairs", 40), ("corpus", "pairs that differ in over 2 words", 0),
          ("categorical", "rows", 4_000), ("categorical", "cities", 20), ("categorical", "devices", 3))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{f}', {v}::BIGINT)" for g, f, v in _FACTS) + ") t(generator, fact, value)")
def generator_facts(spark: SparkSession, d: str) -> DataFrame:
    """What holds of the seeded generators, counted over their whole output."""
    streams = {kind: datagen.stream(spark, 20_000, 2_000, 3, kind) for kind in ("zipf", "uniform")}
    absent, (docs, pairs) = datagen.absent_items(spark, 500), datagen.text_corpus(spark, 300, 40)
    words = docs.select("doc_id", F.split("text", " ").alias("w"))
    both = pairs.join(words.withColumnsRenamed({"doc_id": "a", "w": "x"}), "a").join(words.withColumnsRenamed({"doc_id": "b", "w": "y"}), "b")
    apart = F.size(F.filter(F.zip_with("x", "y", lambda x, y: x != y), lambda z: z))
    table_ = datagen.categorical_table(spark, 4_000, 500, 50)
    n, distinct = F.count("*"), F.count_distinct
    found = [(f"stream {k}", f, s.agg(c.alias("value"))) for k, s in streams.items() for f, c in (("items", n), ("distinct", distinct("item")))]
    found += [("absent", "items", absent.agg(n.alias("value"))), ("absent", "in the stream", absent.join(streams["zipf"], "item").agg(n.alias("value")))]
    found += [("unique", "distinct", datagen.unique_items(spark, 3_000).agg(distinct("id").alias("value"))), ("corpus", "documents", docs.agg(n.alias("value")))]
    found += [("corpus", "words a document", words.select(F.size("w").alias("value")).distinct()), ("corpus", "planted pairs", pairs.agg(n.alias("value")))]
    found += [("corpus", "pairs that differ in over 2 words", both.where(apart > 2).agg(n.alias("value"))), ("categorical", "rows", table_.agg(n.alias("value")))]
    found += [("categorical", "cities", table_.agg(distinct("city").alias("value"))), ("categorical", "devices", table_.agg(distinct("device").alias("value")))]
    return union([x.select(F.lit(g).alias("generator"), F.lit(f).alias("fact"), F.col("value").cast("bigint").alias("value")) for g, f, x in found])


# ---- streaming ------------------------------------------------------------------------------


@query()
def stream_hll_window(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users a day, read as a stream with a watermark and run until the input is used up."""
    from ..streaming import sketches

    schema = table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d) if not _is_folder(spark, f"{d}/events.parquet") else spark.readStream.schema(schema).parquet(f"{d}/events.parquet")
    name = "stream_hll_window"
    run = sketches.windowed_distinct(source, "ts", "user_id").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
