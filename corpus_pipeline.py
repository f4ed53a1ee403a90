"""The corpus pipeline: STAGES over documents, each written as Parquet and reread as the next one's input.

toxicity         documents that score 0.5 or more go
line_dedup       later copies of repeated runs go from the texts; a document of which nothing is left goes
ngram_join       the smallest doc_id of each group of similar texts stays (0.8 or more on five-word shingles)
decontaminate    documents over the benchmark contamination rule go
packing          the rest is packed; one row for each piece

The pipeline depends on bitquarry.llm and lets import errors through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm import decontaminate as _decontaminate
from bitquarry.llm import line_dedup as _line_dedup
from bitquarry.llm import ngram_join as _ngram_join
from bitquarry.llm import packing as _packing
from bitquarry.llm import toxicity as _toxicity
from bitquarry.llm._common import drop_folder, materialize, read


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = _toxicity.train(docs, read(spark, sf_dir, "labels"))
    return _toxicity.reject(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = _line_dedup.dedup(docs)
    emptied = (F.col("__bq_runs") > 0) & (F.trim(F.col("text")) == "")
    kept = out.filter(~F.coalesce(emptied, F.lit(False)))
    return kept.select(*[F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _ngram_join.keep_one(docs, width=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _decontaminate.remove(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _packing.pack(docs, _packing.word_tokenizer())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: SQL can't express the model, the extension of matches or the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:  # written by the stage before, and read by nothing more
            drop_folder(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
