"""The corpus pipeline: toxicity, line dedup, near dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to
the cluster's shared folder and hands the reread table to the next stage.  All but the last
return the columns of ``documents``; documents that a stage rejects do not come back, and line
dedup changes texts.  Rows are matched by doc_id and text digest, so a null or repeated doc_id
never takes the decision of another text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import crf, decontam, line_dedup, minhash, pieces
from tarmac.llm.inputs import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under one half (the model learns from the labels of four
    folds of five, as op7 does)."""
    model = crf.train(docs, table(spark, sf_dir, "labels"))
    return _documents(crf.annotate(docs, model).filter("score < 0.5"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of three-line windows that occurred before."""
    kept = line_dedup.dedup_lines(docs).withColumn("text", F.col("kept_text"))
    return _documents(kept.withColumn("n_chars", F.length("text").cast("long")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return _documents(minhash.keep_one(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no twentieth or more of benchmark words."""
    found = decontam.annotate(docs, table(spark, sf_dir, "benchmark"))
    return _documents(found.filter(~decontam.contaminated()))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document that is left, its N best paths and the decoding check.

    Rows that share an id keep a row each.  The default model's scores are merge ranks, so the
    best path is that of the lattice and not the merge order of the model's own library.
    """
    # Workers hold what earlier stages left too, so less at a time than by default.
    return pieces.encode_documents(docs, cache=100_000, slice_bytes=1 << 20)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("encoding", encode),
]

#: The fitted model and the signatures have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
