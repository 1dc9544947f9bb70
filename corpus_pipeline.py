"""The corpus pipeline: quality, near duplicates, benchmark passages, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
kept, and returns a DataFrame; all but the last return the columns of
``documents``.  Stages are independent: a caller may write and read between them.

1. *quality*: documents that the quality classifier rejects (score below 0.5) go.
2. *near_duplicates*: of each component of documents whose five-word shingles
   have Jaccard similarity 0.8 or more, the one with the smallest id stays.  Rows
   that share an id are one document: of equal texts among them one row stays,
   different ones stay or go together.  Documents without words, and rows
   without an id, stay.
3. *decontamination*: documents that contain 80 % of the five-word shingles of a
   benchmark item go.
4. *mixing*: every document left gets a rate and a number of copies, so that
   expected words by language match ``TARGETS``.

Nulls and edges, for all stages: null and empty texts are documents without
words (the classifier scores them, no stage fails on them); null ids stay rows
of their own.  Whole texts count, however long.  Rows that repeat are dealt with
alike, and become one in the second stage.  Ties: a score of exactly 0.5 stays,
a similarity of exactly 0.8 is a near duplicate, a containment of exactly 80 %
goes.  Empty tables give empty results.  Columns beyond those of ``documents``
are kept as they are, whatever their names; in the last stage those named like
its results are replaced.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialise
from quillon.llm.decontaminate import drop_contaminated
from quillon.llm.ngram_join import near_duplicate_groups
from quillon.llm.quality import fit_quality, keep_quality
from quillon.llm.queries import TARGETS, labelled_languages
from quillon.llm.mixing import mix


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, doesn't reject."""
    return keep_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    groups = near_duplicate_groups(docs, size=5, percent=80)
    gone = materialise(groups.where("doc_id <> component_id").select("doc_id").distinct(), "duplicates")
    shared = materialise(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "shared_ids")
    known = docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti")
    row = next(name for k in count() if (name := f"quillon_row{k}") not in {c.lower() for c in docs.columns})
    first = Window.partitionBy("doc_id", "text").orderBy(F.xxhash64(*docs.columns))
    of_shared = known.join(shared, "doc_id", "left_semi").withColumn(row, F.row_number().over(first)).where(F.col(row) == 1)
    kept = [known.join(shared, "doc_id", "left_anti"), of_shared, docs.where("doc_id IS NULL")]
    return reduce(DataFrame.unionByName, [part.select(*docs.columns) for part in kept])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with rates and copies that meet the target weights."""
    return mix(docs, labelled_languages(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), TARGETS)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stage's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
