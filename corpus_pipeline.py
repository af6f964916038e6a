"""The corpus pipeline: stages over documents (doc_id, text, lang, source, n_chars), each written as Parquet and read again.

language   a document goes if no language is found in it, or none with a score of LEAST (op4's operator)
lines      repeated line runs go; a document of nothing but such runs goes with them (op1's)
near       of each group of documents with similar word n-grams the one with the smallest doc_id stays (op7's); rows without an
           id come after all others, and of rows with one id only copies go
mixture    documents of small sources are repeated to meet the target weights; each is used at least once (op3's)
packing    token sequences of at most CAPACITY ids (op5's); returns a row for each piece
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import entry, langid, lines, mixing, ngram_join, packing
from tidewell.llm.common import WRITTEN, discard, joined, shared_dir, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST, CAPACITY = 0.4, 4096


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found. The model is learned from those that langid does not hold out."""
    model = langid.learn(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out()))
    return langid.predicted(docs, model, *docs.columns).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST)).select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; n_chars follows the text."""
    keep = [c for c in docs.columns if c not in ("text", "n_chars")]
    left = lines.without_repeated_lines(docs, *keep).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows with a number of their own, in the order of doc_id, those without one last, and text; of rows with one doc_id and one text one is left."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = docs.where("doc_id is not null").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("rest")).select("doc_id", "text", *[F.col("rest")[c].alias(c) for c in rest])
    rows = once.unionByName(docs.where("doc_id is null")).orderBy(F.asc_nulls_last("doc_id"), "text", *rest)
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "rows")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that of the smallest doc_id, or of the smallest text where rows share it. Rows are told apart by doc_id where that is possible."""
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    rows = docs.withColumn("row", F.col("doc_id")) if odd.isEmpty() else _numbered(docs)
    found = ngram_join.jaccard_components(rows.select(F.col("row").alias("doc_id"), "text"))
    copies = found.where("doc_id != component_id").select(F.col("doc_id").alias("row")).distinct()
    return joined(rows, copies, "row", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture uses them."""
    return mixing.mixed(docs, entropy=0.97, repeats=4.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences."""
    return packing.pack_documents(docs, entry.tokenizer_file(), CAPACITY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", repeated_lines),
    ("near", near_copies),
    ("mixture", mixture),
    ("packing", packed),
]
#: Language and packing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. Once a stage's result is written, or has failed, its intermediate tables and its input from the stage before go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    path = None
    for k, (name, stage) in enumerate(STAGES):
        before, path, first = path, f"{folder}/{k}-{name}", len(WRITTEN)
        try:
            stage(spark, docs, sf_dir).write.parquet(path)
        finally:
            discard(spark, WRITTEN[first:])
            del WRITTEN[first:]
        docs = spark.read.parquet(path)
        if before:
            discard(spark, [before])
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
