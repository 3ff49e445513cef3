"""Corpus pipeline: five stages over the documents table, each one operator.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; ``run`` writes each result as Parquet in the shared
folder and reads it back as the next one's documents.

Defined cases, in all stages: rows are judged one by one, whatever their ids;
null and repeated ids are allowed; columns other than ``COLUMNS`` are dropped;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.llm import decontaminate, jaccard_join, line_dedup, packing, quality_classifier
from chronopanel.llm.common import apart, materialise, release, table

#: What all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.3 or more stay.

    The classifier is fitted on labelled documents of the stage's input.  A null
    or empty text is scored like one of a block's size; equal texts have equal
    scores and stay or go together.
    """
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality_classifier.fit(docs, labels)
    scored = quality_classifier.score(docs, model, keep=("text", "lang", "source", "n_chars"))
    return scored.where(F.col("score") >= 0.3).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay only in the last; what is left of a text stays a document.

    Rows count as documents; all that share the last id keep the line, a null id
    is never the last.  A null text becomes an empty one.
    """
    kept = line_dedup.dedup_lines(docs, min_chars=20, min_docs=3)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def by_row(docs: DataFrame) -> DataFrame:
    """Documents with a key of id and text, 63 bits: null and repeated ids are judged row by row; only full copies share a key."""
    return docs.withColumn("row", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 on five-word shingles the one with the smallest id stays.

    A null id comes after all others.  Rows that repeat an id are documents of
    their own; of linked ones with one id, or none, one stays, and of rows that
    repeat id and text, empty ones too, one stays.
    """
    docs = by_row(docs)
    groups = jaccard_join.link(docs, id_col="row", width=5, num=8, den=10).groupBy(F.col("row"), "component_id").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "n")
    named = materialise(groups.join(docs.select("row", "doc_id").distinct(), "row"), "groups", few_files=True)
    first = named.groupBy("component_id").agg(F.min(order).alias("first")).select("first.row", F.col("first.n").alias("stay"))
    # rows that go (stay is null) or of which one stays; all others stay as they are
    fate = named.select("row", "n").join(first, "row", "left").where("stay is null or n > 1").select("row", "stay")
    fate = materialise(fate, "fate", few_files=True)
    alone, others = apart(docs, "row", fate)
    others = others.join(fate.withColumn("known", F.lit(True)), "row", "left")
    copied = others.where("stay is not null").groupBy("row").agg(F.min(F.struct(*COLUMNS)).alias("d"))
    return alone.select(*COLUMNS).unionByName(others.where("known is null").select(*COLUMNS)).unionByName(copied.select("d.*"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none and stay."""
    docs = by_row(docs)
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), id_col="row", window=10)
    return docs.join(found.where("contaminated").select("row"), "row", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: the place of every piece; a null or empty text is the end id alone, rows that repeat take places of their own."""
    return packing.pack(docs, size=2048, end_id=0, words_held=140_000)  # workers still hold what earlier stages took


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packing", packed)]

#: No SQL says what the classifier, tokens and packing do; tests hold lines, near_duplicates and benchmark against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        release()
    return docs
