"""A corpus pipeline: toxicity, near duplicates, decontamination, source mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns the rows that it keeps with
the columns of documents; the last returns what it wrote. Stages are written as
Parquet to the shared folder and read again, so that a later stage never runs an
earlier one anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquad.llm.common import documents, fresh, written
from skyquad.llm.decontamination import clean
from skyquad.llm.mixing import mixed_rows
from skyquad.llm.ngram_join import one_of_each
from skyquad.llm.token_output import default_tokenizer, token_rows
from skyquad.llm.toxicity import held_out, score, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str, reject: float = 0.7) -> DataFrame:
    """Documents whose score is below reject. The classifier learns from labelled documents that are not held out.

    A null or empty text has no features and stays; repeated rows and equal
    texts are kept or rejected alike; long texts are scored whole; an empty
    table gives an empty one. All columns stay as they are, a score among them.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id")))
    model = train(docs.filter(~held_out(F.col("doc_id"))), labels)
    (name,) = fresh(docs, "toxicity")
    return score(docs, model, name).filter(F.col(name) < reject).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links reach (five-word shingles, similarity of 0.8 or more), the row with the least doc_id.

    Of equal doc_ids (ties) the one with the least hash of its text stays, of
    equal rows one. Rows that share an id, or have none, are separate rows.
    Texts without words link with nothing and stay. See one_of_each() for long
    texts, other columns and empty tables.
    """
    return one_of_each(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window. Texts without words stay; see clean() and contaminated() for odd rows."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, all columns as they are; see mix() for odd rows."""
    return mixed_rows(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids stand in the token files, as read back from them. A null or empty text has the end id alone; repeated rows have ids each; see write_files()."""
    return token_rows(docs, default_tokenizer())


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_output),
]
#: The classifier and the tokenizer have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name.split()[0]}")
    return docs
