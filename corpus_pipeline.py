"""A corpus run: quality, near copies, benchmark passages, secrets, packing.

Each stage works on all documents that the one before kept; all but the last return the columns of documents, and
nothing else: further columns, whatever their names, are left out.  Every stage gives no rows for none.
``run`` writes each stage as Parquet in the shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import decontam, minhash, packing, quality, secret_scan
from quarrystone.llm.common import written
from quarrystone.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Null and empty texts get the score of a text without statistics and go or stay with it; repeated rows share a score;
    null ids are scored like others; without usable labels every score is 0.5 or above and nothing goes.
    """
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_quality(docs, model, extra=tuple(COLUMNS))
    return scored.where("predicted = 1").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the class's smallest id.

    Null texts count as empty, and all empty texts are one class; a class whose ids are all null keeps one of its texts;
    rows equal in id and text become one row, the smallest of them in the other columns.
    """
    classes = minhash.near_classes(docs)
    # one (id, text) of each class, and of rows that are equal in both one again; the id spreads copies of a text
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("tkey")))
    kept = classes.groupBy("class_node").agg(best.alias("b")).select("b.doc_id", "b.tkey").select("tkey", key.alias("_k"))
    rows = docs.withColumn("tkey", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).withColumn("_k", key)
    rows = rows.join(kept, ["tkey", "_k"], "left_semi")
    return rows.groupBy("tkey", "_k").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item, nor all words of a shorter one.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark lets all stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.decontaminate(docs, items).where(~F.col("contaminated")).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark and n_chars made to fit where the text changed.

    Null and empty texts and repeated rows stay as they are.  The dictionary is that of the documents given.
    """
    out = secret_scan.redact(docs.withColumn("_was", F.col("text")), words=tuple(secret_scan.corpus_words(docs)))
    changed = ~F.col("_was").eqNullSafe(F.col("text"))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; a null or empty text is its end token alone."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]
#: A trained model decides in two stages, which SQL cannot express; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-").lower())
    return docs
