"""The corpus pipeline: stages from documents to the mix, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are
written as Parquet and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from coverwell.llm import decontaminate, line_dedup, mixing, near_dup, quality
from coverwell.llm.common import staged, without


def quality_rules(spark, docs, sf_dir):
    """Documents that fail the hard rules or are outliers of their language and source go."""
    return without(docs, quality.quality(docs).where("not kept"))


def dedup_lines(spark, docs, sf_dir):
    """A line found in ten documents or more stays where it comes first and goes elsewhere; no document goes."""
    got = line_dedup.line_dedup(docs, min_docs=10, keep_first=True)
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text"))
    chars = F.when(F.col("n_dropped") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return got.withColumns({"text": text, "n_chars": chars}).select(*docs.columns)


def near_dedup(spark, docs, sf_dir):
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one of least id stays."""
    return without(docs, near_dup.near_duplicates(docs, n=5, percent=80).where("not kept"))


def remove_benchmarks(spark, docs, sf_dir):
    """Documents with a window of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark).where("not contaminated").select(*docs.columns)


def mix_sources(spark, docs, sf_dir):
    """The documents that the mix takes, with the copies it takes of each."""
    return mixing.mix(docs, texts=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", remove_benchmarks),
    ("source mix", mix_sources),
]

#: Robust estimates and near-dedup have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if at == 0 else staged(docs, f"stage-{at}"), sf_dir)
    return docs
