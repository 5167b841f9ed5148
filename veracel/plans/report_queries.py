"""Queries of reports: scoring modes, maturation rates, histograms, coalesced texts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources.tables import read, responses, with_views
from .detect_queries import SQL as _DETECT
from .detect_queries import gated_pipeline
from .metric_queries import _g, _graded, _rewards as _rw
from .network_queries import _r, _rewards, r6


def scoring_modes(spark, sf):
    """Mean reward per round under exact and smoothed scoring, and its spread in percent over rounds."""
    exact = _rewards(spark, sf)
    w = Window.partitionBy("uid").orderBy("round").rowsBetween(-2, 0)
    both = exact.select(F.lit("exact").alias("mode"), "round", "reward").unionByName(exact.select(F.lit("statistical").alias("mode"), "round", F.avg("reward").over(w).alias("reward")))
    rounds = both.groupBy("mode", "round").agg(F.avg("reward").alias("mean"))
    g = rounds.groupBy("mode").agg(F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("std"))
    return r6(g.withColumn("variance_pct", F.when(F.col("mean") > 0, F.col("std") / F.when(F.col("mean") > 0, F.col("mean")) * 100).otherwise(0.0)), "mean", "std", "variance_pct")


def maturation_rates(spark, sf):
    """How many samples end in each state, and how many of them the gate caught."""
    return gated_pipeline(spark, sf).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_if("gated").alias("gated"))


def score_histogram(spark, sf):
    """Answers per event type and tenth of the score."""
    r = responses(spark, sf).where("score is not null").join(read(spark, sf, "events").select("event_id", "event_type"), "event_id")
    return r.groupBy("event_type", F.least(F.floor(F.col("score") * 10), F.lit(9)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def coalesced_texts(spark, sf):
    """First text that is not blank: the document's, else its metadata as JSON with sorted keys."""
    d = read(spark, sf, "documents")
    meta = F.to_json(F.struct("lang", "source"))
    first = F.coalesce(F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.col("text")), meta)
    return d.select("doc_id", F.sha2(first, 256).alias("sha"), F.length(first).cast("long").alias("chars"))


def honeypot_report(spark, sf):
    """Honeypots met and failed by each uid, and the rounds that this cost."""
    g = _graded(spark, sf)
    per = g.groupBy("uid", "round").agg(F.count_if("is_honeypot").alias("met"), F.count_if("honeypot_failed").alias("failed"))
    return per.groupBy("uid").agg(F.sum("met").alias("met"), F.sum("failed").alias("failed"), F.count_if(F.col("failed") > 0).alias("rounds_lost"))


def running_rewards(spark, sf):
    """Each uid's reward against the best so far and the round's mean."""
    r = _rewards(spark, sf)
    upto = Window.partitionBy("uid").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return r6(r.select("uid", "round", F.max("reward").over(upto).alias("best"), (F.col("reward") - F.avg("reward").over(Window.partitionBy("round"))).alias("over_mean")), "best", "over_mean")


def policy_mix(spark, sf):
    """Share of each policy decision per round."""
    g = responses(spark, sf).where("score is not null").withColumn("decision", M.policy(F.col("score"), F.col("confidence")))
    n = F.sum("n").over(Window.partitionBy("round"))
    return g.groupBy("round", "decision").agg(F.count(F.lit(1)).alias("n")).select("round", "decision", "n", F.round(F.col("n") / n + 1e-10, 6).alias("share"))


QUERIES = {f.__name__: f for f in (scoring_modes, maturation_rates, score_histogram, coalesced_texts, honeypot_report, running_rewards, policy_mix)}

_POL = "CASE WHEN confidence < 0.6 THEN 'review' WHEN score >= 0.5 THEN 'block' WHEN score < 0.493536 THEN 'allow' ELSE 'review' END"
SQL = {
    "scoring_modes": _g(f"""WITH {_rw('round', 'uid')}, b AS (SELECT 'exact' AS mode, round, reward FROM rw UNION ALL SELECT 'statistical', round, avg(reward) OVER (PARTITION BY uid ORDER BY round ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) FROM rw),
        r AS (SELECT mode, round, avg(reward) AS m FROM b GROUP BY ALL), s AS (SELECT mode, avg(m) AS m, stddev_pop(m) AS sd FROM r GROUP BY mode)
        SELECT mode, {_r('m', 'mean')}, {_r('sd', 'std')}, {_r('CASE WHEN m > 0 THEN sd / m * 100 ELSE 0 END', 'variance_pct')} FROM s"""),
    "maturation_rates": f"WITH p AS ({_DETECT['gated_pipeline']}) SELECT state, count(*) AS n, count(*) FILTER (gated) AS gated FROM p GROUP BY state",
    "score_histogram": with_views("SELECT event_type, CAST(least(floor(score * 10), 9) AS BIGINT) AS bucket, count(*) AS n FROM responses JOIN events USING (event_id) WHERE score IS NOT NULL GROUP BY ALL", "responses"),
    "coalesced_texts": """WITH f AS (SELECT doc_id, CASE WHEN trim(coalesce(text, '')) <> '' THEN text ELSE '{"lang":"' || lang || '","source":"' || source || '"}' END AS t FROM documents) SELECT doc_id, sha256(t) AS sha, length(t) AS chars FROM f""",
    "honeypot_report": _g("""WITH p AS (SELECT uid, round, count(*) FILTER (is_honeypot) AS met, count(*) FILTER (is_honeypot AND (NOT valid OR flagged <> actual)) AS failed FROM g GROUP BY ALL)
        SELECT uid, CAST(sum(met) AS BIGINT) AS met, CAST(sum(failed) AS BIGINT) AS failed, count(*) FILTER (failed > 0) AS rounds_lost FROM p GROUP BY uid"""),
    "running_rewards": _g(f"WITH {_rw('round', 'uid')} SELECT uid, round, {_r('max(reward) OVER (PARTITION BY uid ORDER BY round ROWS UNBOUNDED PRECEDING)', 'best')}, {_r('reward - avg(reward) OVER (PARTITION BY round)', 'over_mean')} FROM rw"),
    "policy_mix": with_views(f"WITH d AS (SELECT round, {_POL} AS decision, count(*) AS n FROM responses WHERE score IS NOT NULL GROUP BY ALL) SELECT round, decision, n, {_r('n / sum(n) OVER (PARTITION BY round)', 'share')} FROM d", "responses"),
}
