"""A corpus pipeline over ``documents``: toxicity, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the
columns of documents; the mix repeats a row as often as its source's target takes it. Rows count, not ids: repeated
rows and null ids are documents like others. Null, empty and very long texts pass every stage, ``docs`` without rows gives
none, and of further columns of ``docs`` none is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import minhash, mixing, packing, pii, toxicity
from feedloom.llm.common import Workspace, table
from feedloom.llm.queries import tokenizer_path

#: Near-duplicates in the pipeline: Jaccard similarity of five-word shingles.
SIMILARITY = (80, 100)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; trained on all labelled documents of the table. Null and empty texts stay, with the score of no evidence."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs.select(COLUMNS), model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows the one with the smallest doc_id; null ids come last, and of ties any one. Rows without words all stay."""
    rows = Workspace(spark, "near-dedup").save(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = minhash.near_duplicates(rows, SIMILARITY, id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64(*COLUMNS).alias("content"), "row")
    kept = rows.select("row", order.alias("order")).join(groups, "row").groupBy("component_id").agg(F.min("order").alias("first")).select("first.row")
    return rows.join(kept, "row", "left_semi").select(COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the kind in angle brackets; n_chars follows a changed text. Null stays null."""
    schema = docs.select(COLUMNS).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                rows = whole.slice(at, 500)
                texts = rows.column(1).to_pylist()
                clean = [None if t is None else c for t, c in zip(texts, pii.redact([t or "" for t in texts]), strict=True)]
                chars = [n if t is None or t == c else len(c) for t, c, n in zip(texts, clean, rows.column(4).to_pylist(), strict=True)]
                yield rows.set_column(1, rows.schema.field(1), pa.array(clean, rows.column(1).type)).set_column(4, rows.schema.field(4), pa.array(chars, rows.column(4).type))

    return docs.select(COLUMNS).mapInArrow(run, schema)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, dealt to the mix's shards and shuffled within each. Those without words add none, and a null source is one of its own."""
    return mixing.mixed_rows(docs.select(COLUMNS)).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there; a null or empty text is the end id alone."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("near-dedup", one_of_each), ("pii", without_personal_data), ("mixing", mixed), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), name)
        if k:
            work.drop(STAGES[k - 1][0])
    return docs
