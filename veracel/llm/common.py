"""Helpers that the training-data operators share."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

# Words are runs of digits, letters and anything beyond ASCII, A-Z lower-cased:
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ over UTF-8 bytes, everything else becomes a blank.
WORD_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)

#: Largest side, in rows, that is broadcast after its rows were counted.
BROADCAST_ROWS = 1_000_000


def words(text: str | None) -> list[bytes]:
    """Normalised words of a whole text; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); in local mode, as in tests, one of its own where that is unset."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(given)
        return given.rstrip("/")
    if sc.getCheckpointDir() is None:
        import tempfile

        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the
    lineage, survives lost executors, and its size is then known."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give freed memory back to the system; Python workers outlive their tasks."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Session defaults and what stands for them: a Python worker gets so many rows and bytes at a time.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"),
    "spark.sql.execution.arrow.maxBytesPerBatch": (str(2**31 - 1), str(8 << 20)),
}


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session hands texts to Python in small batches (where it was not told otherwise).

    Spark reads these settings when a plan runs, so they stay set in the session."""
    for key, (default, ours) in BATCHES.items():
        if df.sparkSession.conf.get(key, default) == default:
            df.sparkSession.conf.set(key, ours)
    return df


def text_key(text) -> Column:
    """128 bits that tell texts apart; null counts as empty."""
    from pyspark.sql import functions as F

    return F.unhex(F.md5(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))))


def one_each(docs: DataFrame, judged: DataFrame, key=text_key) -> DataFrame:
    """docs without the rows judged not kept, and with one of the rows kept that occur several times.

    judged: doc_id, tkey, count, kept; rows that it does not name stay.  Rows go by doc_id (null-safe) and
    key(text); of rows alike in both that with the least JSON text stays.  Columns may have any names."""
    from pyspark.sql import functions as F

    rows = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (key(F.col("row.text")) == F.col("tkey"))
    gone = judged.where("not kept").select("doc_id", "tkey")
    twice = judged.where("kept and count > 1").select("doc_id", "tkey")
    left = rows.join(bounded(gone), same, "left_anti")
    if twice.isEmpty():
        return left.select("row.*")
    twice = bounded(twice)
    again = rows.join(twice, same, "left_semi").groupBy(F.col("row.doc_id"), key(F.col("row.text"))).agg(
        F.min_by("row", F.to_json("row", {"ignoreNullFields": "false"})).alias("row")
    )
    return left.join(twice, same, "left_anti").unionByName(again.select("row")).select("row.*")


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; else unmarked,
    and Spark joins by sort and merge."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= rows else df


def values_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A table of literal rows, planned without Python on the executors."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    kind = T._parse_datatype_string(schema)
    empty = F.array().cast(T.ArrayType(kind))
    given = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, kind)]) for r in rows]) if rows else empty
    return spark.range(1).select(F.inline(given.cast(T.ArrayType(kind))))
