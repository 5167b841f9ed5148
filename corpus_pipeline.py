"""From raw documents to documents fit for training, in five stages.

Each stage is written as Parquet in the shared folder and read again by the next.
No stage needs doc_id to be given or unique: a row goes by its doc_id and text.
Columns besides doc_id and text are never read (but labels and n_chars, as said
below), so they may have any names and pass through the first four stages.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracel.llm import decontaminate, exact_dedup, jaccard_join, quality, spiece
from veracel.llm.common import input_table, materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts score what the model says without words; repeated rows score alike and stay or go together,
    rows of one doc_id each by their own text.  Without labels of both classes every score is 0.5 and all stay.  An
    empty table stays empty."""
    model = quality.fit(docs, input_table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the largest doc_id.

    Null and empty texts are one group.  A row without an id stays only where no equal text has one; of rows alike in
    doc_id and text that with the least JSON text stays.  Rows of one doc_id with different texts are different
    documents.  An empty table stays empty."""
    return exact_dedup.drop_duplicates(docs, keep="largest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the least doc_id.

    Texts without words, null ones included, are one class.  Rows without an id come last; ties go to the least digest
    of the text, then to the least JSON text.  Rows of one doc_id with different texts are different documents.  An
    empty table stays empty."""
    return jaccard_join.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those hit in over half of their words go.

    n_chars, where there is one, follows a text that changed.  Null and empty texts and texts without passages stay as
    they are; repeated rows fare alike.  An empty table stays empty, and without benchmark items nothing changes."""
    cut = decontaminate.remove_passages(docs, input_table(spark, sf_dir, "benchmark"))
    if "n_chars" not in docs.columns:
        return cut
    changed = F.col("n_chars").isNull() | (F.col("n_chars") != F.length("text"))
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull() & changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, how many, and whether they equal the library's and decode to the text.

    Null and empty texts have no ids.  Every row gets its own result, repeated ones and those without an id included;
    other columns go.  An empty table stays empty."""
    coded = spiece.encode_documents(docs.select("doc_id", "text"))
    return coded.select("doc_id", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"), "parity", "round_trip")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("tokens", token_stage),
]

#: No SQL for a trained classifier, MinHash or a tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = input_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
