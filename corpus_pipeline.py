"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes every stage's rows as Parquet and reads
them again, in a folder of its own under spark.checkpoint.dir; the rows of a stage are removed when the next one has read them, those of the last
remain. All stages but the last return the columns of documents; n_chars
follows the text that is left. A document whose whole text was a copy leaves with its last line or paragraph.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import linededup, neardup, packing, quality, substring
from tickloom.llm.common import row_key
from tickloom.session import materialize, remove, shared_folder

THRESHOLD = 0.3
BLANK = r"^\s*$"


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def _columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour vote accepts; learned from the labels of folds 1 to 4 of 5."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=~fold)
    return _columns(quality.score(docs, model, docs.columns, "_quality").filter(F.col("_quality") >= THRESHOLD), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(docs).filter(~((F.col("_n_removed") > 0) & F.col("text").rlike(BLANK)))
    return _sized(_columns(out, docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the first by doc_id and, where a doc_id has several texts, by a digest of the text.

    Each row is decided by its own text. Rows equal in doc_id and text are one document, of which one row stays; rows of
    null doc_id stay.
    """
    named = docs.filter("doc_id IS NOT NULL")
    if not named.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        gone = neardup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id")
        return _columns(docs.join(gone, "doc_id", "left_anti"), docs)
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    doc_id, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    once = plain.filter(F.col(doc_id).isNotNull()).withColumn("_row", row_key(plain, doc_id, text)).dropDuplicates(["_row"])
    number = materialize(once.select("_row").repartitionByRange("_row").sortWithinPartitions("_row").withColumn("_no", F.monotonically_increasing_id()))
    numbered = once.join(number, "_row")
    gone = neardup.near_duplicates(numbered.select(F.col("_no").alias("doc_id"), F.col(text).alias("text"))).filter(~F.col("kept")).select(F.col("doc_id").alias("_no"))
    out = numbered.join(gone, "_no", "left_anti").select(*plain.columns).unionByName(plain.filter(F.col(doc_id).isNull()))
    return out.toDF(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring.dedup_substrings(docs, every=True).filter(~(F.col("_removed").isNotNull() & F.col("text").rlike(BLANK)))
    return _sized(_columns(out, docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("best-fit packing", pack_sequences),
]

#: The classifier and the packing plan have no SQL equivalent; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
    return docs
