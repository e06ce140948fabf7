"""URL filters: host and path rules, and link-graph propagation for what no rule judges.

Hosts of pages that rules allow are trusted seeds, hosts of pages that rules block are
distrusted ones, each in proportion to its pages.  Personalised PageRank carries trust
along host links, and distrust against them.  A host whose distrust exceeds
``threshold`` times its trust is blocked.  DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, written

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


@dataclass(frozen=True)
class UrlParams:
    rules: tuple[tuple[str, str], ...] = RULES
    damping: float = 0.85
    rounds: int = 12
    threshold: float = 1.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path; both empty for a null url or one without "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        h, _, p = r.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(f"/{p}"))
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, p: UrlParams) -> DataFrame:
    """page_id, host, path, rule, ruled (the rule's verdict)."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), p.rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: pages of host src with a link to host dst; a relative link is one to its own host."""
    host, _ = host_and_path(F.col("url").cast("string"))
    hrefs = F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(r"(?i)\shref\s*=\s*[\x22']?\s*((?:https?:)?//[^/?#\s\x22'>]*|[^\s\x22'>])"), F.lit(1))
    rows = pages.select(host.alias("src"), F.explode(F.array_distinct(F.transform(hrefs, lambda x: F.when(x.contains("//"), ascii_lower(F.regexp_extract(x, "//(.*)$", 1))).otherwise("")))).alias("dst"))
    return rows.where("src <> ''").select("src", F.when(F.col("dst") == "", F.col("src")).otherwise(F.col("dst")).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, p: UrlParams) -> DataFrame:
    """host, trust, distrust after the rounds; hosts that neither reaches don't occur.

    seeds: host, allowed, blocked (page counts).  The mass of a host without links
    leaves.  One loop carries both walks; a hot host's links are one row a target.
    """
    ways = [("trust", "src", "dst"), ("distrust", "dst", "src")]
    edges = None
    for walk, a, b in ways:
        out = links.groupBy(F.col(a).alias("__h")).agg(F.sum("n").alias("__n"))
        one = links.join(out, F.col(a) == F.col("__h")).select(F.lit(walk).alias("walk"), F.col(a).alias("host"), F.col(b).alias("to"), (F.col("n") / F.col("__n")).alias("part"))
        edges = one if edges is None else edges.unionByName(one)
    edges = written(edges, "host-edges")
    totals = seeds.agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).first()
    start = written(
        seeds.select("host", F.explode(F.array(
            F.struct(F.lit("trust").alias("walk"), (F.col("allowed") / float(totals["allowed"] or 1)).alias("s")),
            F.struct(F.lit("distrust").alias("walk"), (F.col("blocked") / float(totals["blocked"] or 1)).alias("s")))).alias("x"))
        .select("x.walk", "host", "x.s").where("s > 0"), "host-seeds")
    now = start
    for k in range(p.rounds):
        moved = now.join(edges, ["walk", "host"]).select("walk", F.col("to").alias("host"), (F.col("s") * F.col("part") * p.damping).alias("s"))
        now = moved.unionByName(start.select("walk", "host", (F.col("s") * (1 - p.damping)).alias("s"))).groupBy("walk", "host").agg(F.sum("s").alias("s"))
        if k % 4 == 3:
            now = written(now, "host-ranks")
    score = lambda walk: F.round(F.coalesce(F.sum(F.when(F.col("walk") == walk, F.col("s"))), F.lit(0.0)), 12)
    return now.groupBy("host").agg(score("trust").alias("trust"), score("distrust").alias("distrust"))


def filter_urls(pages: DataFrame, p: UrlParams = UrlParams()) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), one row a row of pages.

    The longest fitting rule decides; else the host's scores do.  A host that no walk
    reaches, and an empty one, is allowed.  Null html has no links.  Repeated rows each
    count.  No rows: no rows.
    """
    rows = written(judged(pages, p), "urls")
    count = lambda v: F.count(F.when(F.col("ruled") == v, 1))
    seeds = rows.where("host <> ''").groupBy("host").agg(count("allow").alias("allowed"), count("block").alias("blocked"))
    scores = written(propagate(seeds, written(host_links(pages), "host-links"), p), "host-scores").withColumnRenamed("host", "__host")
    out = rows.join(scores, F.col("host") == F.col("__host"), "left")
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    verdict = F.coalesce("ruled", F.when(distrust > trust * p.threshold, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def digest(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def oracle(p: UrlParams = UrlParams()) -> str:
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rules = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in p.rules)
    steps = "".join(
        f"""
r{k + 1} AS (SELECT walk, host, sum(s) AS s FROM (
  SELECT e.walk, e.dst AS host, r.s * e.part * {p.damping} AS s FROM r{k} r JOIN e ON r.walk = e.walk AND r.host = e.host
  UNION ALL SELECT walk, host, s * (1 - {p.damping}) FROM r0) GROUP BY walk, host),"""
        for k in range(p.rounds)
    )
    return rf"""
WITH a AS (SELECT row_number() OVER () AS r, page_id, html, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT r, page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{up}', '{low}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
u AS (SELECT * FROM (VALUES {rules}) t(rule, rh, rp, v)),
j AS (SELECT h.*, m.rule, m.v FROM h LEFT JOIN (
  SELECT r, max_by(rule, length(rule)) AS rule, max_by(v, length(rule)) AS v FROM h JOIN u ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r) m USING (r)),
x AS (SELECT r, host, unnest(regexp_extract_all(coalesce(html, ''), '(?i)\shref\s*=\s*["'']?\s*((?:https?:)?//[^/?#\s"''>]*|[^\s"''>])', 1)) AS l FROM h WHERE host <> ''),
y AS (SELECT DISTINCT r, host AS src, CASE WHEN contains(l, '//') THEN translate(regexp_extract(l, '//(.*)$', 1), '{up}', '{low}') ELSE '' END AS dst FROM x),
l AS (SELECT src, CASE WHEN dst = '' THEN src ELSE dst END AS dst, count(*) AS n FROM y GROUP BY ALL),
e AS (SELECT 'trust' AS walk, src AS host, dst, n / sum(n) OVER (PARTITION BY src) AS part FROM l
  UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM l),
r0 AS (SELECT CASE v WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS walk, host, count(*) / sum(count(*)) OVER (PARTITION BY v) AS s FROM j WHERE host <> '' AND v IS NOT NULL GROUP BY host, v),{steps}
s AS (SELECT host, round(coalesce(sum(s) FILTER (WHERE walk = 'trust'), 0), 12) AS t, round(coalesce(sum(s) FILTER (WHERE walk = 'distrust'), 0), 12) AS d FROM r{p.rounds} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(v, CASE WHEN coalesce(d, 0) > coalesce(t, 0) * {p.threshold} THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN s ON j.host = s.host
"""
