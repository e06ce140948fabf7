"""Corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, mixing.

Each stage reads the previous one's documents from Parquet and writes its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from skimmer.llm import decontaminate, lines, mixing, near_copies, quality, simhash
from skimmer.llm.common import discard, new_path, scope, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A source mixes languages, so that its boilerplate is on few of its pages (README); near copies count as one page.
LINES = lines.LineParams(ratio=0.01)

#: SimHash fingerprints within op5's radius come first.
COPIES = near_copies.NearCopyParams(radius=simhash.SimHashParams().radius)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones keeps."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their sources' boilerplate lines; n_chars follows. Texts of which nothing but white space is left go."""
    rows = lines.line_dedup(docs, LINES, copies=near_copies.pages(docs))
    cut = F.col("__dropped") > 0
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.where(~cut | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash within two bits, then bands; all verified by five-word shingles at a Jaccard similarity of 0.8."""
    return near_copies.deduplicated(docs, COPIES)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, text, size, source_size, target and taken of the documents that the mix takes words of."""
    return mixing.mixed(docs, carry=("text",)).select("doc_id", "source", "text", "size", "source_size", "target", "taken").where("taken > 0")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", simhash_stage),
    ("benchmark", benchmark_stage),
    ("mixing", mixing_stage),
]

#: The quality and near-duplicate stages hash with XXH64, which DuckDB lacks: tested by brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the whole documents table, stage by stage; what a stage needed is deleted once its documents are written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scope(spark):
            out = written(stage(spark, docs, sf_dir), path=path)
        discard(docs)
        docs = out
    return docs
