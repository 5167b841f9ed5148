"""Streaming queries run to completion over the given tables."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize, shared_dir
from ..sources.tables import read, responses, with_views
from . import feedback, linked_log
from .state import alert_stream, ema_stream, health_stream, session_stream, windowed_events


SLICES = 4


def streamed(df: DataFrame, transform, order: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """df arriving in slices of its order column, each in as many files as Spark writes; the stream is drained after each.

    State is carried from slice to slice in the checkpoint. In update mode the last row of each key counts."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    number = F.col(order).cast("double")
    cuts = sorted(set(df.select(number.alias("x")).approxQuantile("x", [k / SLICES for k in range(1, SLICES)], 0.01)))

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{base}/out/batch={epoch}")  # a retried epoch replaces itself

    out = None
    for low, high in zip([None, *cuts], [*cuts, None]):
        inside = F.lit(True) if low is None else number > low
        if high is not None:
            inside = inside & F.coalesce(number <= high, F.lit(low is None))  # rows without an order come first
        df.where(inside).write.mode("append").parquet(f"{base}/in")
        out = transform(spark.readStream.schema(df.schema).parquet(f"{base}/in"))
        query = out.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(sink).start()
        query.awaitTermination()
    got = spark.read.schema(out.schema.add("epoch", "long")).parquet(f"{base}/out/*")
    if mode != "update":
        return got.drop("epoch")
    return got.groupBy(*keys).agg(F.max_by(F.struct(*out.columns), "epoch").alias("r")).select("r.*")


def _rewards(spark, sf):
    from ..plans.network_queries import _rewards as rewards

    return rewards(spark, sf).select("uid", "round", "reward")


def stream_ema(spark, sf):
    return streamed(_rewards(spark, sf), ema_stream, "round").select("uid", "round", F.round(F.col("ema") + 1e-10, 6).alias("ema"))


def stream_health(spark, sf):
    a = responses(spark, sf).select("uid", F.col("event_id").alias("step"), F.col("score").isNotNull().alias("ok"), "latency")
    out = streamed(a, health_stream, "step", "update", ("uid",))
    return out.select("uid", "last_response", "responses", "consecutive_failures", F.round(F.col("mean_latency") + 1e-10, 5).alias("mean_latency"))


def stream_alerts(spark, sf):
    a = responses(spark, sf).where("score is null").select(F.lit("failure").alias("kind"), "uid", F.col("day").alias("step"))
    return streamed(a, alert_stream, "step").select("uid", "step")


def stream_windows(spark, sf):
    """Hourly windows that the watermark has closed when the stream ends, all but those at its end."""
    e = read(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = streamed(e, windowed_events, "ts")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))


def stream_sessions(spark, sf):
    """Each user's sessions that the watermark has closed when the stream ends."""
    e = read(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    s = streamed(e, session_stream, "ts")
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), "n", F.round("total", 2).alias("total"))


def graded_rows(spark, sf) -> DataFrame:
    """Graded answers as feedback: uid, hotkey (a new one every third round), step, score, x, outcome."""
    from ..plans.metric_queries import _graded

    g = _graded(spark, sf).where("valid")
    hotkey = F.concat_ws("-", F.lit("hk"), F.col("uid").cast("string"), F.floor(F.col("round") / 3).cast("string"))
    x = F.array("score", "confidence", 1 - F.col("score"))
    return g.select("uid", hotkey.alias("hotkey"), F.col("event_id").alias("step"), "score", x.alias("x"), F.when(F.col("flagged") == F.col("actual"), 1.0).otherwise(-1.0).alias("outcome"))


def _feedback(df: DataFrame) -> DataFrame:
    return df.select("uid", "hotkey", "step", "n", *[F.round(F.col(c) + 1e-10, 6).alias(c) for c in ("ema", "recent", "w0", "w1", "w2")])


def stream_feedback(spark, sf):
    """Smoothed score, mean of the last 50 and adaptive weights of each (uid, hotkey) after every graded answer, as state of a stream."""
    with feedback.with_provider(spark):
        return _feedback(streamed(materialize(graded_rows(spark, sf), "graded"), feedback.feedback_stream, "step"))


def feedback_states(spark, sf):
    """The same from the table."""
    return _feedback(feedback.batch_feedback(graded_rows(spark, sf)))


def appended_log(spark, sf):
    """The audit log of all rounds, appended from a stream in slices of rounds, and whether every record links."""
    from ..operators import chain

    scores = materialize(chain._scores(_rewards(spark, sf), "round", 0.1), "scores").select("round_index", "uid", "raw_reward", "ema_score", "hotkey")
    base = f"{shared_dir(spark)}/logs/{uuid.uuid4().hex}"
    log = linked_log.LinkedLog(spark, f"{base}/log")
    last = scores.agg(F.max("round_index")).first()[0]
    for k in range(SLICES):
        low, high = (last + 1) * k // SLICES, (last + 1) * (k + 1) // SLICES
        scores.where(F.col("round_index").between(low, high - 1)).write.mode("append").parquet(f"{base}/in")
        linked_log.append_scores(spark.readStream.schema(scores.schema).parquet(f"{base}/in"), log, f"{base}/state").awaitTermination()
    rows = log.read(chain.RECORD)
    return rows.select("round_index", "n_scores", "prev_hash", "hash").join(log.verify(chain.RECORD), "round_index").select("round_index", "n_scores", "prev_hash", "hash", "ok")


QUERIES = {f.__name__: f for f in (stream_ema, stream_health, stream_alerts, stream_windows, stream_sessions, stream_feedback, feedback_states, appended_log)}

from ..plans.network_queries import SQL as _NET  # noqa: E402

SQL = {
    "stream_sessions": """
        WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e), l AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n, round(sum(value), 2) AS total
        FROM s, l GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= min(wm)""",
    "stream_ema": _NET["ema_scores"],
    "stream_alerts": _NET["alert_cooldown"],
    "stream_health": with_views("""
        WITH s AS (SELECT uid, max(event_id) FILTER (score IS NOT NULL) AS last_response, count(score) AS responses, avg(latency) FILTER (score IS NOT NULL) AS mean_latency FROM responses GROUP BY uid)
        SELECT s.uid, coalesce(last_response, 0) AS last_response, responses, (SELECT count(*) FROM responses r WHERE r.uid = s.uid AND r.event_id > coalesce(last_response, -1)) AS consecutive_failures, round(coalesce(mean_latency, 0) + 1e-10, 5) AS mean_latency FROM s""", "responses"),
    "stream_windows": """
        WITH l AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events)
        SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events, l GROUP BY ALL HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= min(wm)""",
}
