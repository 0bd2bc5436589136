"""From raw documents to packed sequences: rules, classifier, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last have
the columns of ``documents``. ``run`` writes each stage's result to the shared folder
and reads it again, so a lost executor never sets back more than a stage. Each stage
also runs by itself: workers find this folder wherever the session was started.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readweave.llm import jaccard, packing, quality, rules
from readweave.session import reachable, remove, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@reachable
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    Null and empty texts have no words and go; very long texts are judged whole. Rows are
    judged alone: repeated rows all stay or all go, null keys don't matter. An empty
    table gives one. Columns beside those of ``documents`` are dropped first, whatever their names.
    """
    return rules.judge(docs.select(COLUMNS)).where("kept").select(COLUMNS)


@reachable
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled documents outside the held-out fold, takes for good.

    Null and empty texts have a score like others; very long texts count whole. A score that ties with
    the bar is good. Rows are judged alone; an empty table gives one; further columns are dropped first.
    """
    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(COLUMNS), model).where("predicted = 1").select(COLUMNS)


@reachable
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: that with the smallest doc_id, null ones last; of those the one with the least digest.

    Rows equal in doc_id and text are one document, of which one row stays. Null and empty
    texts are linked with nothing: one row stays for each doc_id and text. Very long texts
    count whole; an empty table gives one; further columns are dropped first. Rows are found again by a
    digest of 128 bits of doc_id and text.
    """
    text = F.coalesce(F.md5("text"), F.lit("-"))
    docs = docs.select(*COLUMNS, F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text)).alias("__row"))
    group = F.coalesce(F.col("component").cast("string"), F.col("__row")).alias("group")
    first = jaccard.members(docs, carry=("__row",)).groupBy(group).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("s")
    )
    return docs.join(first.select("s.__row"), "__row", "left_semi").dropDuplicates(["__row"]).select(COLUMNS)


@reachable
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences.

    Null and empty texts are pieces of their end token alone; only texts of more than 4096 tokens are
    cut. Rows with equal doc_ids are packed apart, also repeated ones; null keys stay null. An empty table gives
    no pieces; further columns are not carried.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", best_fit_packing),
]

#: Shingle sets and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, before = written(stage(spark, docs, sf_dir), name.replace(" ", "-")), docs
        remove(before)
    return docs
