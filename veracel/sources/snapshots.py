"""Snapshots of state tables: written to a new folder, then pointed to, and checked when they are restored.

A pointer is an empty file whose name holds a number and the snapshot's folder, so a
snapshot that was torn before its pointer was made is never seen.  A snapshot that is
pointed to but damaged (a table missing or short, a column of another type, a key that
is required and not there) is refused as a whole, and the defaults stand."""

import json
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import marks


class SnapshotError(ValueError):
    """A snapshot that is not whole."""


def save(spark: SparkSession, base: str, tables: dict[str, DataFrame], facts: dict | None = None, keep: int = 2) -> str:
    """Write the tables and facts (plain JSON) as a snapshot and point to it; the `keep` newest ones stay.  Returns its name."""
    name = uuid.uuid4().hex
    rows = {}
    for table, df in tables.items():
        df.write.parquet(f"{base}/snapshots/{name}/{table}")
        rows[table] = spark.read.schema(df.schema).parquet(f"{base}/snapshots/{name}/{table}").count()
    spark.createDataFrame([(json.dumps({"rows": rows, "facts": facts or {}}),)], "value string").coalesce(1).write.text(f"{base}/snapshots/{name}/_whole")
    number = 1 + max((int(n.split(".")[0]) for n in marks.names(spark, f"{base}/pointers")), default=-1)
    while not marks.mark(spark, f"{base}/pointers/{number:012d}.{name}"):
        number += 1
    for old in marks.names(spark, f"{base}/pointers")[:-keep]:
        marks.remove(spark, f"{base}/pointers/{old}")
        marks.remove(spark, f"{base}/snapshots/{old.split('.')[1]}")
    return name


def load(spark: SparkSession, base: str, required: dict[str, str]) -> tuple[dict[str, DataFrame], dict]:
    """The tables and facts of the newest snapshot.  required: schema of each table that must be there."""
    pointers = marks.names(spark, f"{base}/pointers")
    if not pointers:
        raise SnapshotError(f"no snapshot in {base}")
    folder = f"{base}/snapshots/{pointers[-1].split('.')[1]}"
    try:
        said = json.loads(spark.read.text(f"{folder}/_whole").first().value)
        out = {}
        for table, schema in required.items():
            want = T._parse_datatype_string(schema)
            df = spark.read.parquet(f"{folder}/{table}")
            have = {f.name: f.dataType for f in df.schema}
            if any(have.get(f.name) != f.dataType for f in want):
                raise SnapshotError(f"{folder}/{table}: columns differ")
            if df.count() != said["rows"].get(table):
                raise SnapshotError(f"{folder}/{table}: rows are missing")
            out[table] = df
    except (PySparkException, ValueError, KeyError, AttributeError) as e:
        raise e if isinstance(e, SnapshotError) else SnapshotError(f"{folder}: {type(e).__name__}") from e
    return out, said["facts"]


def restore(spark: SparkSession, base: str, required: dict[str, str], defaults: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], dict, str | None]:
    """As load, but with the defaults (else empty tables) and the reason where there is no whole snapshot."""
    try:
        return *load(spark, base, required), None
    except SnapshotError as e:
        empty = {t: spark.createDataFrame([], s) for t, s in required.items()}
        return empty | (defaults or {}), {}, str(e)


def last_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key: what a state table holds."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")
