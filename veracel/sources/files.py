"""Data files: sample sets, manifests, audit logs, settings."""

import hashlib
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chain import RECORD, IntegrityError

SAMPLE = "id string, prompt string, output string, domain string, code string, context string, metadata struct<difficulty:string,source:string>"
TRUTH = "struct<ground_truth_label:string,ground_truth_type:string,is_honeypot:boolean>"


def samples_json(spark: SparkSession, path: str) -> DataFrame:
    """Samples of files of the form {"samples": [...]}."""
    rows = spark.read.schema(f"samples array<struct<{SAMPLE.replace(' string', ':string').replace('metadata struct', 'metadata:struct')}>>").json(path, multiLine=True)
    return rows.select(F.inline("samples"))


def manifest_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a file that maps ids to truths; as a map, so that ids do not become columns."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"map<string,{TRUTH}>")).alias("id", "t")).select("id", "t.*")


def dataset_version(spark: SparkSession, path: str) -> str:
    """First 12 digits of SHA-256 over the files' digests in the order of their paths."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("h")).orderBy("path").collect()
    return rows[0].h[:12] if len(rows) == 1 else hashlib.sha256("".join(r.h for r in rows).encode()).hexdigest()[:12]


def training_samples(samples: DataFrame, manifest: DataFrame) -> DataFrame:
    """Samples whose truth is normal; unlabelled ones go."""
    return samples.join(manifest.where("ground_truth_label = 'normal'").select("id"), "id", "left_semi")


def cross_check(samples: DataFrame, manifest: DataFrame) -> DataFrame:
    """Ids that only one side has."""
    both = samples.select("id", F.lit(True).alias("s")).join(manifest.select("id", F.lit(True).alias("m")), "id", "full")
    why = F.when(F.col("m").isNull(), "sample_without_manifest").when(F.col("s").isNull(), "manifest_without_sample")
    return both.select("id", why.alias("issue")).where("issue is not null")


def merge_manifests(old: DataFrame, new: DataFrame) -> DataFrame:
    """All ids, new rows over old ones."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)


def append_samples(old: DataFrame, new: DataFrame) -> DataFrame:
    """All samples, repeated ones too."""
    return old.unionByName(new, allowMissingColumns=True)


def write_log(log: DataFrame, path: str) -> None:
    """Round records as JSON lines."""
    log.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Round records; a line that is not one raises."""
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("file", F.input_file_name())
    options = {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}
    parsed = lines.select("file", F.from_json("value", f"{RECORD}, _corrupt string", options).alias("r")).select("file", "r.*")
    bad = parsed.where("_corrupt is not null or round_index is null").first()
    if bad:
        raise IntegrityError(f"malformed record in {bad.file}")
    return parsed.drop("file", "_corrupt")


def flatten(nested: dict, before: str = "") -> dict:
    """Nested tables to dotted keys."""
    out = {}
    for k, v in nested.items():
        out |= flatten(v, f"{before}{k}.") if isinstance(v, dict) else {before + k: v}
    return out


def settings(table: dict, cli: dict | None = None, defaults: dict | None = None) -> dict:
    """Command line over file over defaults, by dotted key; unknown keys of the file are left out if defaults are given."""
    base, given = dict(defaults or {}), flatten(table)
    known = {k: v for k, v in given.items() if not defaults or k in base or k in (cli or {}) or any(d.startswith(k.rpartition(".")[0]) for d in base)}
    return base | known | (cli or {})


def read_settings(path: str, **kwargs) -> dict:
    with open(path, "rb") as f:
        return settings(tomllib.load(f), **kwargs)
