"""URL filter: a sort-merge range join of pages with nested host rules.

A host becomes a key of its labels from the right ("a.example.net" ->
"net.example.a."), so the hosts under a rule are one interval of keys.  Rule
hosts open and close intervals; pages and these events are dealt into key ranges
and swept in order, each page taking the stack of rules that are open where it
stands.  The rule with the longest text whose path starts the page's path wins.

The ranges are cut at quantiles of (key, salt), so a host with a third of all
pages spreads over as many ranges as its share; each range starts with the stack
of its first key.  Only built-in functions run.

A null url, or one without "://", has an empty host and path and gets the
default verdict.  Repeated rows stay; ties between rules of one length go to the
longer host.  An empty rule or page table gives no rule or no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import values_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Key ranges at most: their bounds are literals of the plan. A range is swept row by row, so it may be large.
MAX_RANGES = 4096

#: (host, path, verdict) of the query's rules.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the right, each ended by a dot; every subdomain's key starts with it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _open_rules(keys: DataFrame, nodes: DataFrame, own: bool) -> DataFrame:
    """For each key, the rules of all rule hosts whose interval holds it, itself
    included if own.  Only for rule hosts and range starts, which are few."""
    depth = F.size(F.split("key", r"\.")) - 1
    prefixes = keys.select("key", F.explode(F.sequence(F.lit(1), depth)).alias("n")).select(
        "key", F.concat(F.expr("substring_index(key, '.', n)"), F.lit(".")).alias("prefix")
    )
    if not own:
        prefixes = prefixes.where("prefix <> key")
    met = prefixes.join(nodes.select(F.col("key").alias("prefix"), "rules"), "prefix").groupBy("key")
    return keys.join(met.agg(F.flatten(F.collect_list("rules")).alias("stack")), "key", "left")


def _steps(n: int) -> list[int]:
    return [1 << k for k in reversed(range(n.bit_length()))]


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None, id_col: str = "page_id"
) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    rules: host, path, verdict.  ranges: how many key ranges to sweep; four per
    shuffle partition unless given.  Their bounds are quantiles of a sample of 16
    keys per range, the only rows that reach the driver."""
    spark = pages.sparkSession
    ranges = min(ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_RANGES)
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumns(
        {"key": host_key(F.col("host")), "salt": F.xxhash64("page_id", "path")}
    )
    sample = sorted(
        (r.key, r.salt) for r in rows.select("key", "salt").orderBy(F.xxhash64("salt"), "salt", "key").limit(16 * ranges).collect()
    )
    cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    point = "struct<key:string,salt:bigint>"
    cut_rows = values_table(spark, cuts, "key string, salt long")

    def range_of(key: Column, salt: Column) -> Column:
        """Cuts at or before (key, salt), by binary search."""
        if not cuts:
            return F.lit(0)
        at = F.struct(key.alias("key"), salt.alias("salt")).cast(point)
        bounds = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(s).cast("long").alias("salt")) for k, s in cuts])
        return F.aggregate(
            F.array(*map(F.lit, _steps(len(cuts)))),
            F.lit(0),
            lambda lo, step: F.when((lo + step <= len(cuts)) & (F.try_element_at(bounds, F.least(lo + step, F.lit(len(cuts)))) <= at), lo + step).otherwise(lo),
        )

    texts = rules.select(
        F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict"
    ).distinct()
    nodes = texts.groupBy(host_key(F.col("host")).alias("key")).agg(
        F.collect_list(
            F.struct(
                F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("host_n"), "path",
                F.concat("host", "path").alias("rule"), "verdict",
            )
        ).alias("rules")
    )
    least = F.lit(-(1 << 63)).cast("long")
    opens = _open_rules(nodes.select("key"), nodes, True).select("key", F.lit(1).alias("ord"), "stack", least.alias("salt"))
    closes = _open_rules(nodes.select("key"), nodes, False).select(
        F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")).alias("key"), F.lit(0).alias("ord"), "stack", least.alias("salt")
    )
    starts = _open_rules(cut_rows.select("key").distinct(), nodes, True).join(cut_rows, "key").select(
        "key", F.lit(2).alias("ord"), "stack", "salt"
    )
    events = opens.unionByName(closes).unionByName(starts).withColumns(
        {"range": range_of(F.col("key"), F.col("salt")), "stack": F.coalesce("stack", F.array().cast(nodes.schema["rules"].dataType))}
    )
    swept = events.unionByName(
        rows.withColumns({"ord": F.lit(3), "range": range_of(F.col("key"), F.col("salt"))}), allowMissingColumns=True
    )
    in_order = Window.partitionBy("range").orderBy("key", "salt", "ord").rowsBetween(Window.unboundedPreceding, 0)
    best = F.array_max(F.filter("open", lambda r: F.startswith(F.col("path"), r["path"])))
    return (
        swept.withColumn("open", F.last("stack", ignorenulls=True).over(in_order))
        .where("ord = 3")
        .withColumn("best", best)
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )


def default_rules(spark) -> DataFrame:
    return values_table(spark, RULES, "host string, path string, verdict string")
