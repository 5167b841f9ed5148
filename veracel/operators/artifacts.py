"""Report files: rules over them as a table, sections combined under one envelope, metrics in text exposition."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import marks

OPS = ("required", "equals", "one_of", "at_least", "at_most", "same_as", "without")


class Rule(NamedTuple):
    """What a value at a JSON path must be.  `without` looks at the whole text of the artifact if the path is $."""

    name: str
    path: str
    op: str
    than: str | float | tuple | None = None


def broken(rule: Rule, doc: Column) -> Column:
    """Whether an artifact breaks a rule; a value that is not there breaks all but `without`."""
    v = F.get_json_object(doc, rule.path) if rule.path != "$" else doc
    if rule.op == "required":
        return v.isNull()
    if rule.op == "equals":
        return ~v.eqNullSafe(F.lit(str(rule.than)))
    if rule.op == "one_of":
        return ~F.coalesce(v.isin(*rule.than), F.lit(False))
    if rule.op in ("at_least", "at_most"):
        n = v.try_cast("double")
        return ~F.coalesce((n >= rule.than) if rule.op == "at_least" else (n <= rule.than), F.lit(False))
    if rule.op == "same_as":
        return v.isNull() | ~v.eqNullSafe(F.get_json_object(doc, rule.than))
    if rule.op == "without":
        return F.coalesce(F.contains(F.lower(v), F.lit(rule.than.lower())), F.lit(False))
    raise ValueError(f"unknown rule {rule.op}")


def violations(artifacts: DataFrame, rules: list[Rule]) -> DataFrame:
    """artifact, place, rule, path: every rule that an artifact breaks, by its place among the rules.  artifacts: artifact, json.

    A text that is no JSON object breaks `not_json` alone."""
    doc = F.col("json")
    told = F.array(*[F.when(broken(r, doc), F.struct(F.lit(i).alias("place"), F.lit(r.name).alias("rule"), F.lit(r.path).alias("path"))) for i, r in enumerate(rules)])
    no_json = F.array(F.struct(F.lit(-1).alias("place"), F.lit("not_json").alias("rule"), F.lit("$").alias("path")))
    is_json = F.coalesce(F.trim(doc).startswith("{") & F.try_parse_json(doc).isNotNull(), F.lit(False))
    each = F.when(is_json, F.filter(told, lambda x: x.isNotNull())).otherwise(no_json)
    return artifacts.select("artifact", F.inline(each))


def first_violations(artifacts: DataFrame, rules: list[Rule]) -> DataFrame:
    """What a validator that stops at the first broken rule would raise, of each artifact."""
    return violations(artifacts, rules).groupBy("artifact").agg(F.min(F.struct("place", "rule", "path")).alias("r")).select("artifact", "r.rule", "r.path")


def combined(spark: SparkSession, sections: dict[str, str], pattern: str = r"([^/]+)\.json$") -> DataFrame:
    """section, part, source, entries, data: JSON files of each section (a path or glob), one row a file; a section without files is left out.

    part is the name that the pattern finds in a file's path; entries are counted in lists, maps count their keys."""
    rows = None
    for section, path in sections.items():
        fs, p = marks._at(spark, path)
        if not fs.globStatus(p):
            continue
        got = spark.read.text(path, wholetext=True).select(F.lit(section).alias("section"), F.regexp_extract(F.input_file_name(), pattern, 1).alias("part"), F.input_file_name().alias("source"), F.col("value").alias("data"))
        rows = got if rows is None else rows.unionByName(got)
    if rows is None:
        return spark.createDataFrame([], "section string, part string, source string, entries int, data string")
    n = F.coalesce(F.json_array_length("data"), F.size(F.json_object_keys("data")), F.lit(0))
    return rows.select("section", "part", "source", n.alias("entries"), "data")


def envelope(rows: DataFrame, version: str) -> DataFrame:
    """One JSON text with all sections, the parts of each by name; reports are small."""
    parts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("part", F.struct("source", "entries", "data")))))
    by_section = rows.groupBy("section").agg(parts.alias("parts"))
    every = by_section.agg(F.map_from_entries(F.collect_list(F.struct("section", "parts"))).alias("sections"))
    return every.select(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(True).alias("immutable"), "sections")).alias("value"))


SAMPLE = r'^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+(-?[0-9]+))?\s*$'
LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'


def exposed(lines: DataFrame) -> DataFrame:
    """metric, labels, value, at of the samples in lines (value) of the text exposition format; comments and blank lines are left out, a line that is no sample has a null metric."""
    text = F.trim("value")
    rows = lines.where((text != "") & ~text.startswith("#"))
    part = lambda k: F.regexp_extract("value", SAMPLE, k)
    names, given = F.regexp_extract_all(part(2), F.lit(LABEL), F.lit(1)), F.regexp_extract_all(part(2), F.lit(LABEL), F.lit(2))
    plain = lambda v: F.replace(F.replace(F.replace(F.replace(v, F.lit("\\\\"), F.lit("\x00")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\x00"), F.lit("\\"))
    number = F.when(part(3).isin("+Inf", "Inf"), float("inf")).when(part(3) == "-Inf", float("-inf")).when(part(3) == "NaN", float("nan")).otherwise(part(3).try_cast("double"))
    ok = part(1) != ""
    return rows.select(F.when(ok, part(1)).alias("metric"), F.map_from_arrays(names, F.transform(given, plain)).alias("labels"), F.when(ok, number).alias("value"), F.when(part(4) != "", part(4).try_cast("long")).alias("at"))


def exposition(samples: DataFrame) -> DataFrame:
    """Lines (value) of samples (metric, labels, value) in the text exposition format, labels by name."""
    safe = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    said = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), safe(e["value"]), F.lit('"'))), ",")
    labels = F.when(F.coalesce(F.size("labels"), F.lit(0)) > 0, F.concat(F.lit("{"), said, F.lit("}"))).otherwise("")
    number = F.when(F.isnan("value"), "NaN").when(F.col("value") == float("inf"), "+Inf").when(F.col("value") == float("-inf"), "-Inf").otherwise(F.col("value").cast("string"))
    return samples.select(F.concat("metric", labels, F.lit(" "), number).alias("value"))
