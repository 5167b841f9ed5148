"""Exact duplicates: 128-bit hash groups, then a comparison of bytes.

Rows are grouped by the MD5 of their text, without the text.  Only rows of groups
of two or more come back with their text, to be compared with the text of the row
that stays; one that differs (a collision) is set apart under its own text.  The
hot key of a large group is pre-aggregated before the shuffle.  Facts of groups of
two or more come back to rows by a broadcast of counted size, or beyond that by a
sort-merge join of two tables, which Spark splits when a key is skewed.

Null counts as empty.  Rows with one doc_id and one text form a group like any
other.  Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, one_each

#: Texts of the rows that stay are broadcast only up to so many bytes.
MODEL_BYTES = 16 << 20


def content_hash(text: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(text))


def duplicate_groups(docs: DataFrame, keep: str = "smallest", hash_of=content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    keep: whether the smallest or the largest doc_id of equal texts stays.
    hash_of: for tests, a weaker hash whose collisions the comparison undoes."""
    pick = {"smallest": F.min, "largest": F.max}[keep]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("h", hash_of(F.col("text")))
    digest = materialize(rows.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256")), "digest")
    groups = digest.groupBy("h").agg(F.count(F.lit(1)).alias("n"), pick("doc_id").alias("rep")).where("n > 1")
    many = bounded(materialize(groups, "groups"))
    again = rows.join(many.select("h", "rep"), "h")
    found = again.where(F.col("doc_id").eqNullSafe(F.col("rep"))).groupBy("h").agg(F.min("text").alias("model"))
    models = materialize(found, "models")
    if (models.agg(F.sum(F.octet_length("model"))).first()[0] or 0) <= MODEL_BYTES:
        models = F.broadcast(models)
    # differing texts under one hash: none, but for a collision
    off = again.join(models, "h").where("text <> model")
    apart = materialize(
        off.groupBy("h", "text").agg(F.count(F.lit(1)).alias("own_n"), pick("doc_id").alias("own_rep"))
        .select("h", F.sha2("text", 256).alias("text_sha256"), "own_n", "own_rep"), "collisions",
    )
    less = bounded(apart.groupBy("h").agg(F.sum("own_n").alias("off_n")))
    out = digest.join(many, "h", "left").join(less, "h", "left").join(bounded(apart), ["h", "text_sha256"], "left")
    keep_id = F.when(F.col("own_n").isNotNull(), F.col("own_rep")).when(F.col("n").isNotNull(), F.col("rep")).otherwise(F.col("doc_id"))
    size = F.coalesce("own_n", F.col("n") - F.coalesce("off_n", F.lit(0)), F.lit(1).cast("long"))
    return out.select(
        "doc_id", keep_id.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256",
    )


def drop_duplicates(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept.

    Rows go by doc_id and text, so one id may have several texts, and rows without an id are judged too
    (one stays where no equal text has an id); of rows alike in both, that with the least JSON text stays."""
    marked = duplicate_groups(docs, keep).where("group_size > 1")
    judged = marked.groupBy("doc_id", F.col("text_sha256").alias("tkey"), "kept").count()
    return one_each(docs, materialize(judged, "judged"), lambda text: F.sha2(F.coalesce(text, F.lit("")), 256))
