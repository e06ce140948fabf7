"""Line dedup by site-relative frequency: lines that too large a share of a site's pages carry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, bounded, written


PARTS = 64


@dataclass(frozen=True)
class LineParams:
    """A line goes if more than ``ratio`` of its site's pages, and at least ``min_pages``, carry it.

    broadcast_lines: the most boilerplate lines that are broadcast; more are joined by page, with the same result.
    """

    ratio: float = 0.1
    min_pages: int = 5
    broadcast_lines: int = 50_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _digest(line: Column) -> Column:
    """128 bits of the line without ASCII white space around it."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.struct(F.xxhash64(bare).alias("h"), F.xxhash64(F.lit(1), bare).alias("g"))


def boilerplate(docs: DataFrame, p: LineParams = LineParams(), site: str = "source", copies: DataFrame | None = None) -> DataFrame:
    """(site, h, g, n_pages, site_pages): the boilerplate lines of each site by their 128-bit digests.

    Pages are the distinct texts of a site, so that a page that was copied many times
    isn't boilerplate for that.  With ``copies`` (page, group: one row for each text's
    XXH64, as a written table) the texts of a group are one page.
    """
    kept = F.filter(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    pages = docs.select(F.col(site).cast("string").alias("site"), F.xxhash64(text).alias("page"), F.array_distinct(F.transform(kept, _digest)).alias("d"))
    if copies is not None:
        pages = pages.join(bounded(copies), "page", "left").select("site", F.coalesce("group", "page").alias("page"), "d")
    # the page itself is counted as a line without digest: one shuffle gives pages and lines
    rows = pages.select("site", "page", F.explode(F.concat(F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("g"))), "d")).alias("d"))
    rows = rows.select("site", "d.h", "d.g", "page").distinct()
    counts = written(rows.groupBy("site", "h", "g").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= p.min_pages), "line-counts")
    sites = counts.where("h IS NULL").select(F.col("site").alias("__site"), F.col("n_pages").alias("site_pages"))
    return counts.where("h IS NOT NULL").join(sites, F.col("site").eqNullSafe(F.col("__site"))).where(F.col("n_pages") > F.col("site_pages") * p.ratio).drop("__site")


def line_dedup(docs: DataFrame, p: LineParams = LineParams(), site: str = "source", copies: DataFrame | None = None) -> DataFrame:
    """docs without their sites' boilerplate lines, plus __dropped, the number of lines dropped.

    Lines end at "\\n" and compare without the ASCII white space around them; blank
    lines neither count nor go.  A line counts once a page, and rows of one site with the
    same text are one page; rows of a null site form one site, and a null text is empty.  A text that loses no line stays as
    it is (a null stays null); one that loses all becomes empty.  Rows and their other
    columns all stay.
    """
    found = written(boilerplate(docs, p, site, copies).select("site", "h", "g"), "boilerplate")
    lines, mine = _lines(F.col("text")), F.col(site).cast("string")
    if found.count() <= p.broadcast_lines:
        # a site's lines in parts by their hash, so that a line is compared with few of them
        parts = found.groupBy("site", F.pmod("h", F.lit(PARTS)).cast("int").alias("part")).agg(F.collect_list(F.struct("h", "g")).alias("l"))
        lists = parts.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("part", "l"))).alias("m"))
        none = F.array().cast("array<struct<h:bigint,g:bigint>>")
        lists = lists.select(F.col("site").alias("__site"), F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), none)).alias("__lines"))
        joined = docs.join(F.broadcast(lists), mine.eqNullSafe(F.col("__site")), "left").drop("__site")
        gone = lambda d: F.array_contains(F.element_at("__lines", F.pmod(d.h, F.lit(PARTS)).cast("int") + 1), d)
    else:
        # digests move, and each page gets those of its lines that go: a hot site is many pages
        page = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
        each = docs.select(mine.alias("site"), page.alias("__page"), F.explode(F.array_distinct(F.transform(lines, _digest))).alias("d")).select("site", "__page", "d.h", "d.g").distinct()
        same = each["site"].eqNullSafe(found["site"]) & (each["h"] == found["h"]) & (each["g"] == found["g"])
        hits = each.join(found, same, "left_semi").groupBy(F.col("site").alias("__site"), "__page").agg(F.collect_list(F.struct("h", "g")).alias("__lines"))
        joined = docs.withColumn("__own", page).join(hits, mine.eqNullSafe(F.col("__site")) & (F.col("__own") == F.col("__page")), "left").drop("__site", "__page", "__own")
        gone = lambda d: F.array_contains("__lines", d)
    kept = F.filter(lines, lambda x: (F.btrim(x, F.lit(SPACES)) == "") | ~gone(_digest(x)))
    out = joined.withColumn("__kept", F.when(F.col("__lines").isNotNull(), kept)).withColumn("__dropped", F.coalesce(F.size(lines) - F.size("__kept"), F.lit(0)))
    return out.withColumn("text", F.when(F.col("__dropped") > 0, F.array_join("__kept", "\n")).otherwise(F.col("text"))).select(*docs.columns, "__dropped")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the MD5 of the text that is left, of each document."""
    before = F.size(_lines(F.col("text")))
    rows = line_dedup(docs.select("doc_id", "text", "source", before.cast("long").alias("n_lines")))
    return rows.select("doc_id", "n_lines", F.col("__dropped").cast("long").alias("n_dropped"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
b AS (SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
n AS (SELECT source, count(DISTINCT text) AS pages FROM d GROUP BY source),
c AS (SELECT source, bare, count(DISTINCT text) AS k FROM b WHERE bare <> '' GROUP BY source, bare),
x AS (SELECT c.source, c.bare FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source WHERE k >= 5 AND k > pages * 0.1),
k AS (SELECT b.*, x.bare IS NOT NULL AS gone FROM b LEFT JOIN x ON b.bare = x.bare AND b.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS text_md5
FROM k GROUP BY r, doc_id
"""
