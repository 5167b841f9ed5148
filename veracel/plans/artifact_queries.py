"""Queries of report files: rules over reports, the exposition of metrics, and three detectors against a pair."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import artifacts as A
from ..operators import metrics as M
from ..operators import models, one_class
from ..sources.shared import materialize
from ..sources.tables import manifest, responses, with_views
from . import vector_queries as V
from .immune_queries import _features, _normal
from .metric_queries import _g, _graded

#: Rules of a uid's report: fields, ranges, terms that must not occur, and keys that must agree.
RULES = [
    A.Rule("has_scores", "$.n", "at_least", 1), A.Rule("known_schema", "$.schema", "equals", "report/1"), A.Rule("mean_in_range", "$.score.mean", "at_most", 0.6),
    A.Rule("has_worst", "$.score.low", "required"), A.Rule("grade", "$.grade", "one_of", ("pass", "review")), A.Rule("no_failures", "$.failed", "at_most", 0),
    A.Rule("all_answered", "$.n", "same_as", "$.valid"), A.Rule("no_error_term", "$", "without", "error"),
]


def uid_reports(spark, sf) -> DataFrame:
    """artifact, json: a report of each uid's answers."""
    r = responses(spark, sf).groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("valid"), F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("low"), F.max("day").alias("day"))
    grade = F.when(F.col("mean") < 0.45, "pass").when(F.col("mean") < 0.55, "review").otherwise("fail")
    note = F.when(F.col("n") > F.col("valid"), "some answers were an error").otherwise("complete")
    doc = F.struct(F.lit("report/1").alias("schema"), "n", "valid", (F.col("n") - F.col("valid")).alias("failed"), F.struct("mean", "low").alias("score"), grade.alias("grade"), note.alias("note"))
    return r.select(F.concat(F.lit("uid-"), F.col("uid").cast("string")).alias("artifact"), F.to_json(doc).alias("json"))


def report_violations(spark, sf):
    """Every rule that a uid's report breaks."""
    return A.violations(uid_reports(spark, sf), RULES).select("artifact", "rule", "path")


def first_violations(spark, sf):
    """The first rule that a uid's report breaks."""
    return A.first_violations(uid_reports(spark, sf), RULES)


def exposed_metrics(spark, sf):
    """Answers, failures and mean latency of each uid as lines of text exposition, read back."""
    r = responses(spark, sf).groupBy("uid").agg(F.count(F.lit(1)).cast("double").alias("answers"), F.count_if(F.col("score").isNull()).cast("double").alias("failures"), F.round(F.avg("latency") + 1e-10, 6).alias("latency"))
    long = r.unpivot(["uid"], ["answers", "failures", "latency"], "metric", "value")
    made = long.select(F.concat(F.lit("scorer_"), "metric").alias("metric"), F.create_map(F.lit("uid"), F.col("uid").cast("string"), F.lit("unit"), F.when(F.col("metric") == "latency", "s").otherwise('"1"')).alias("labels"), "value")
    back = A.exposed(A.exposition(made))
    return back.select("metric", F.col("labels")["uid"].alias("uid"), F.col("labels")["unit"].alias("unit"), "value")


def detector_spike(spark, sf):
    """Mean and median of three detectors (one-class machine, self region, isolation forest) on the labelled samples of each domain,
    against the mean of the first two; and how many predictions change if the forest says 1."""
    s = V._texts(spark, sf)
    own = V._normal_ids(s, spark, sf)
    v, width = V.fitted_vectors(s, own)
    machine = one_class.OneClassSvm.fit(V._sample(v, own, width, V.MACHINE_ROWS))
    forest = V.ranked_forest(v, own, width).select("id", F.round("score", 6).alias("c"))
    svm = V.raw_scores(v, width, machine.score).select("id", F.round("raw", 6).alias("a"))
    f = materialize(_features(spark, sf), "dendritic")
    region = models.scored(f, text.DENDRITIC, models.SelfRegion.fit(_normal(f, spark, sf), text.DENDRITIC)).select("id", "domain", F.round("score", 6).alias("b"))
    rows = region.join(svm, "id").join(forest, "id").join(manifest(spark, sf).select(F.col("sid").alias("id"), (F.col("truth") == "anomalous").alias("actual")), "id")
    return spike(rows)


def spike(rows: DataFrame) -> DataFrame:
    """rows: domain, a, b, c, actual."""
    mean3, median3, pair = (F.col("a") + F.col("b") + F.col("c")) / 3, F.sort_array(F.array("a", "b", "c"))[1], (F.col("a") + F.col("b")) / 2
    upset = {"mean3": (F.col("a") + F.col("b") + 1) / 3, "median3": F.greatest("a", "b"), "control": pair}
    graded = materialize(rows.select("domain", "actual", mean3.alias("mean3"), median3.alias("median3"), pair.alias("control"), *[x.alias(f"{k}_upset") for k, x in upset.items()]), "spike")
    parts = []
    for k in upset:
        hit, then = F.round(k, 9) >= 0.5, F.round(f"{k}_upset", 9) >= 0.5
        g = graded.groupBy("domain").agg(*M.confusion(hit, F.col("actual")), F.count_if(hit != then).alias("flips"), F.avg(F.col(f"{k}_upset") - F.col(k)).alias("shift"), F.count(F.lit(1)).alias("n"))
        parts.append(M.rates(g).withColumn("aggregator", F.lit(k)))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    base = parts[2].select("domain", F.col("f1").alias("control_f1"))
    met = every.join(F.broadcast(base), "domain")  # a row a domain
    return met.select(
        "domain", "aggregator", "n", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), F.round("f1", 4).alias("f1"),
        F.round(F.col("f1") - F.col("control_f1"), 4).alias("f1_delta"), "flips", F.round(F.col("flips") / F.col("n"), 4).alias("flip_rate"), F.round("shift", 4).alias("mean_shift"),
    )


QUERIES = {f.__name__: f for f in (report_violations, first_violations, exposed_metrics, detector_spike)}

_REPORT = """r AS (SELECT uid, count(*) AS n, count(score) AS valid, round(avg(score), 6) AS mean, min(score) AS low FROM responses GROUP BY uid),
    b AS (SELECT 'uid-' || uid AS artifact, unnest([
      {'place': 2, 'rule': 'mean_in_range', 'path': '$.score.mean', 'bad': coalesce(mean > 0.6, true)}, {'place': 3, 'rule': 'has_worst', 'path': '$.score.low', 'bad': low IS NULL},
      {'place': 4, 'rule': 'grade', 'path': '$.grade', 'bad': coalesce(mean >= 0.55, true)}, {'place': 5, 'rule': 'no_failures', 'path': '$.failed', 'bad': n > valid},
      {'place': 6, 'rule': 'all_answered', 'path': '$.n', 'bad': n <> valid}, {'place': 7, 'rule': 'no_error_term', 'path': '$', 'bad': n > valid}]) AS x FROM r)"""

SQL = {
    "report_violations": with_views(f"WITH {_REPORT} SELECT artifact, x.rule AS rule, x.path AS path FROM b WHERE x.bad", "responses"),
    "first_violations": with_views(f"WITH {_REPORT} SELECT artifact, arg_min(x.rule, x.place) AS rule, arg_min(x.path, x.place) AS path FROM b WHERE x.bad GROUP BY artifact", "responses"),
    "exposed_metrics": with_views("""
        WITH r AS (SELECT uid, count(*)::DOUBLE AS answers, count(*) FILTER (score IS NULL)::DOUBLE AS failures, round(avg(latency) + 1e-10, 6)::DOUBLE AS latency FROM responses GROUP BY uid)
        SELECT 'scorer_' || m AS metric, uid::VARCHAR AS uid, CASE WHEN m = 'latency' THEN 's' ELSE '"1"' END AS unit, v AS value FROM (UNPIVOT r ON answers, failures, latency INTO NAME m VALUE v)""", "responses"),
}
