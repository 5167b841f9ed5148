"""The engine's entities as views of the given tables.

samples     documents as prompt/output records, with a few literal rows of known features
manifest    labels as hidden ground truth
responses   events as answers of many scorers: the last one per (uid, round, sid)
stakes      orders as monthly stake snapshots
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOMAINS = ("hallucination", "code_security", "reasoning", "bio")

# Literal records whose features are worked out by hand in the tests.
LITERALS = (
    (-1, "", "This revolutionary cure is guaranteed 100 % and has no side effects (Smith, 2020)", "bio"),
    (-2, "", "The sky is blue. The sky is not blue.", "reasoning"),
    (-3, "", "Sample at pH 15.2 and pH 7.1 with 5 mM buffer, mean -3.5, p-value 1.5", "bio"),
    (-4, "", "First, given A, therefore B. Step 2 follows that C is so. Thus D, but not E.", "reasoning"),
    (-5, "What is it?", "It may be 12 mg (Jones, 1999). It is always clearly proven [3]. Who knows?", "hallucination"),
)


def values(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small table of literal rows, planned without Python on the executors."""
    kind = T._parse_datatype_string(schema)
    made = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, kind)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*made)))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt over all cores by key where the scan has fewer tasks than twice the cores (a small file is one task
    whatever its work); a table of many files or splits is left as it is read, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= 2 * cores else rows.repartition(2 * cores, key)


def domain_of(doc_id) -> F.Column:
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (doc_id % 4 + 1).cast("int"))


def literals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LITERALS, "id long, prompt string, output string, domain string")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(
        F.col("doc_id").alias("id"), F.lit("").alias("prompt"), F.coalesce("text", F.lit("")).alias("output"), domain_of(F.col("doc_id")).alias("domain")
    )
    return docs.unionByName(literals(spark))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("sid"), F.when(bad, "anomalous").otherwise("normal").alias("truth"), (F.col("doc_id") % 11 == 0).alias("is_honeypot")
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, round, day, sid, score (null for a failure), confidence, latency, event_id."""
    n = read(spark, sf_dir, "documents").count()
    days = F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', ts)") / 86_400_000_000)
    events = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("uid"), F.floor(days / 7).alias("round"), days.alias("day"), (F.col("event_id") % n).alias("sid"),
        F.when(F.col("event_type") != "error", F.least(F.col("value") / 100, F.lit(1.0))).alias("score"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"), F.col("value").alias("latency"), "event_id",
    )
    last = Window.partitionBy("uid", "round", "sid").orderBy(F.desc("event_id"))
    return events.withColumn("k", F.row_number().over(last)).where("k = 1").drop("k")


def stakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """step (months since 1990), uid, stake."""
    step = (F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate")
    orders = read(spark, sf_dir, "orders").select(step.cast("long").alias("step"), F.col("o_custkey").alias("uid"), "o_totalprice")
    return orders.groupBy("step", "uid").agg(F.sum("o_totalprice").alias("stake"))


#: The same views for DuckDB.
SQL_VIEWS = {
    "samples": """samples AS (
        SELECT doc_id AS id, '' AS prompt, coalesce(text, '') AS output,
               CASE doc_id % 4 WHEN 0 THEN 'hallucination' WHEN 1 THEN 'code_security' WHEN 2 THEN 'reasoning' ELSE 'bio' END AS domain
        FROM documents UNION ALL SELECT * FROM (VALUES """
    + ", ".join("({}, '{}', '{}', '{}')".format(*(str(v).replace("'", "''") for v in r)) for r in LITERALS)
    + ") AS v(id, prompt, output, domain))",
    "manifest": """manifest AS (
        SELECT doc_id AS sid, CASE WHEN quality = 0 OR toxic = 1 THEN 'anomalous' ELSE 'normal' END AS truth, doc_id % 11 = 0 AS is_honeypot FROM labels)""",
    "responses": """responses AS (
        SELECT * EXCLUDE (k) FROM (
          SELECT *, row_number() OVER (PARTITION BY uid, round, sid ORDER BY event_id DESC) AS k FROM (
            SELECT user_id AS uid, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 604800000000) AS BIGINT) AS round,
                   CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000) AS BIGINT) AS day,
                   event_id % (SELECT count(*) FROM documents) AS sid,
                   CASE WHEN event_type <> 'error' THEN least(value / 100, 1.0) END AS score,
                   CAST(json_extract(props, '$.k') AS DOUBLE) / 100 AS confidence, value AS latency, event_id FROM events)) WHERE k = 1)""",
    "stakes": """stakes AS (
        SELECT CAST((year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS BIGINT) AS step, o_custkey AS uid, sum(o_totalprice) AS stake
        FROM orders GROUP BY ALL)""",
}


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views (and what sql's own WITH adds) before it."""
    views = ", ".join(SQL_VIEWS[n] for n in names)
    sql = sql.strip()
    return f"WITH {views}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {views} {sql}"
