"""Queries over many scorers: collusion, agreement, weights, snapshots, histories, sets and sampling."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_int
from ..operators import history as H
from ..operators import metrics as M
from ..operators import network as N
from ..sources.tables import manifest, read, responses, stakes, with_views


def r6(df, *cols):
    return df.withColumns({c: F.round(F.col(c) + 1e-10, 6) for c in cols})


def _scores(spark, sf):
    return responses(spark, sf).where("score is not null")


def _rewards(spark, sf):
    return M.exact_rewards(M.graded(responses(spark, sf), manifest(spark, sf)), "round", "uid").select("round", "uid", "reward")


def _by_uid(spark, sf):
    return _scores(spark, sf).groupBy("uid", "sid").agg(F.avg("score").alias("score"))


def _trajectory(spark, sf):
    """Mean score per uid and day."""
    return _scores(spark, sf).groupBy("uid", "day").agg(F.round(F.avg("score"), 6).alias("score"))


def _weights(spark, sf):
    """Weights per order month: stake shares."""
    return stakes(spark, sf).select("step", "uid", (F.col("stake") / F.sum("stake").over(Window.partitionBy("step"))).alias("weight"))


def collusion_pairs(spark, sf):
    return r6(N.similar_pairs(_by_uid(spark, sf), 0.99, 3), "cosine")


def collusion_groups(spark, sf):
    return N.cliques(N.similar_pairs(_by_uid(spark, sf), 0.9, 3))


def collusion_penalty(spark, sf):
    pairs = N.similar_pairs(_by_uid(spark, sf), 0.99, 3)
    members = pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid")))
    return r6(N.penalised(_rewards(spark, sf), members, "uid"), "reward")


def rank_agreement(spark, sf):
    """Event types as judges of uids."""
    e = responses(spark, sf).join(read(spark, sf, "events").select("event_id", "event_type"), "event_id")
    j = e.where("score is not null").groupBy(F.col("event_type").alias("judge"), "uid").agg(F.round(F.avg("score"), 9).alias("score"))
    return r6(N.rank_agreement(j), "rho")


def judge_outliers(spark, sf):
    e = responses(spark, sf).join(read(spark, sf, "events").select("event_id", "event_type"), "event_id")
    j = e.where("score is not null").groupBy(F.col("event_type").alias("judge"), "uid").agg(F.round(F.avg("score"), 9).alias("score"))
    return r6(N.judge_outliers(N.rank_agreement(j)), "mean_rho")


def capped_weights(spark, sf):
    return r6(N.capped_weights(_weights(spark, sf), 0.1, "step"), "weight")


def emitted_weights(spark, sf):
    w = stakes(spark, sf).select("step", "uid", F.round("stake", 2).alias("weight"))
    return N.emitted_weights(w, "step")


def weight_audit(spark, sf):
    return N.weight_audit(_weights(spark, sf), "step")


def processed_weights(spark, sf):
    """Weights under the 10 % quantile of their month left out, the rest shared out again.

    Quantile and comparison see one computation of the weights: a sum of doubles made twice, in the order in which
    rows arrive, may differ in its last bit, and the weights at the quantile would fall under it."""
    every = Window.partitionBy("step")
    place = F.row_number().over(every.orderBy(F.asc_nulls_last("weight"))) - 1
    w = _weights(spark, sf).where("step is not null").withColumns({"place": place, "at": (F.count("weight").over(every) - 1) * F.lit(0.1)})
    low, high = (F.max(F.when(F.col("place") == side("at"), F.col("weight"))).over(every) for side in (F.floor, F.ceil))
    kept = w.withColumn("q", low + (high - low) * (F.col("at") - F.floor("at"))).where("weight >= q")
    return kept.select("step", "uid", F.round(F.col("weight") / F.sum("weight").over(every) + 1e-10, 6).alias("weight"))


def snapshot_changes(spark, sf):
    return r6(N.snapshot_changes(stakes(spark, sf)), "shift")


def coordinated_drops(spark, sf):
    return N.coordinated_drops(_rewards(spark, sf))


def diversity_bonus(spark, sf):
    r = _rewards(spark, sf)
    return r6(N.diversity(r.select("uid", F.col("round").alias("pos"), F.col("reward").alias("value"))), "diversity")


def population_diversity(spark, sf):
    r = _rewards(spark, sf).groupBy("uid").agg(F.stddev_pop("reward").alias("s"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    return r.agg(F.round(F.when(F.count(F.lit(1)) < 2, 0.5).otherwise(F.least(F.avg("s") / 0.5, F.lit(1.0))) + 1e-10, 6).alias("index"), F.count(F.lit(1)).alias("uids"))


def subnet_health(spark, sf):
    """Per day: uids that answered nothing for over 3 days, and the inflammation that makes."""
    days = spark.range(30).select(F.col("id").alias("today"))
    ok = _scores(spark, sf).select("uid", "day").distinct()
    seen = F.broadcast(days).join(ok, F.col("day") <= F.col("today")).groupBy("today", "uid").agg(F.max("day").alias("last"))
    g = seen.groupBy("today").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("today") - F.col("last") > 3).alias("inactive"))
    i = F.least(F.lit(1.0), F.col("inactive") / F.greatest("n", F.lit(1)))
    return g.select("today", "n", "inactive", F.round(i + 1e-10, 6).alias("inflammation"), F.when(i < 0.1, "healthy").when(i < 0.3, "mild").when(i < 0.6, "moderate").otherwise("severe").alias("level"))


def trust_score(spark, sf):
    """Per sample, the answers of the five uids with the largest stakes so far."""
    w = stakes(spark, sf).groupBy("uid").agg(F.round(F.sum("stake"), 2).alias("weight"))
    return r6(N.trust_score(responses(spark, sf).select("sid", "uid", "round", "score", "confidence"), w, 5, "sid", "round"), "score", "confidence")


def api_health(spark, sf):
    r = responses(spark, sf)
    return r.agg(F.count_if(F.coalesce("score", F.lit(0.0)) != 0).alias("nonzero"), F.countDistinct("uid").alias("uids"), F.max("day").alias("last_day"))


def ema_scores(spark, sf):
    return r6(H.ema(_rewards(spark, sf), "round", "reward", "uid"), "ema").select("uid", "round", "ema")


def trajectories(spark, sf):
    t = H.last_n(_trajectory(spark, sf), 20, "day", "uid")
    return t.groupBy("uid").agg(F.min("day").alias("day_start"), F.max("day").alias("day_end"), F.count(F.lit(1)).alias("n"))


def oscillation_events(spark, sf):
    return H.oscillations(H.last_n(_trajectory(spark, sf), 20, "day", "uid"), "day", "score", "uid")


def metastable_events(spark, sf):
    """Long low trajectories with little variance (a bound that these data reach)."""
    t = H.last_n(_trajectory(spark, sf), 20, "day", "uid")
    return r6(H.metastable(t, "score", "uid", variance=0.05), "variance", "median")


def replica_divergence(spark, sf):
    t = _trajectory(spark, sf)
    other = responses(spark, sf).where("score is not null and event_id % 2 = 0").groupBy("uid", "day").agg(F.round(F.avg("score"), 6).alias("score"))
    return r6(H.replica_divergence(t, other, "day", "score", "uid"), "gap")


def replica_gaps(spark, sf):
    """Uids whose daily means of two columns, the score and the confidence, come apart: two replicas over the same rows."""
    r = _scores(spark, sf).groupBy("uid", "day").agg(F.round(F.avg("score"), 6).alias("score"), F.round(F.avg("confidence"), 6).alias("other"))
    return r6(H.replica_divergence(r.select("uid", "day", "score"), r.select("uid", "day", F.col("other").alias("score")), "day", "score", "uid"), "gap")


def convergence_counts(spark, sf):
    o = oscillation_events(spark, sf).select(F.lit("oscillation").alias("event"))
    m = metastable_events(spark, sf).select(F.lit("metastability").alias("event"))
    c = replica_divergence(spark, sf).select(F.lit("convergence_failure").alias("event"))
    return o.unionByName(m).unionByName(c).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def stale_scores(spark, sf):
    r = _scores(spark, sf).withColumn("level", F.round("score", 1))
    return H.stale(r, "event_id", "level", "uid", n=3).where("stale").select("uid", "event_id")


def failure_runs(spark, sf):
    r = H.failure_runs(responses(spark, sf), "event_id", F.col("score").isNull(), "uid")
    return r.where("consecutive_failures > 0").select("uid", "event_id", "consecutive_failures")


def mean_latency(spark, sf):
    w = Window.partitionBy("uid").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return r6(_scores(spark, sf).select("uid", "event_id", F.avg("latency").over(w).alias("mean_latency")), "mean_latency")


def history_window(spark, sf):
    """Mean and count over each uid's last 50 answers."""
    w = Window.partitionBy("uid").orderBy("event_id").rowsBetween(-49, 0)
    return r6(_scores(spark, sf).select("uid", "event_id", F.avg("score").over(w).alias("mean"), F.count("score").over(w).alias("n")), "mean")


def telemetry_percentiles(spark, sf):
    t = H.last_n(read(spark, sf, "events"), 100, "event_id", "event_type")
    return t.groupBy("event_type").agg(*[F.round(F.percentile("value", p / 100) + 1e-10, 6).alias(f"p{p}") for p in (25, 50, 75, 95)])


def feedback_signals(spark, sf):
    return r6(H.feedback_signal(_rewards(spark, sf), "round", "reward", "uid").select("uid", "round", "signal"), "signal")


def alert_cooldown(spark, sf):
    a = responses(spark, sf).where("score is null").select("uid", F.col("day").alias("step"))
    return H.cooled_alerts(a, 10, "uid")


def rate_limit(spark, sf):
    e = read(spark, sf, "events").select("user_id", (F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01', ts)")).alias("t"))
    return H.admitted_calls(e, 3, 86400.0, "user_id")


def rotation_exclusions(spark, sf):
    return H.excluded_ids(responses(spark, sf).select("uid", "round", "sid"), "uid", "round", "sid", 2)


def unseen_samples(spark, sf):
    """How many labelled samples each uid has not had in its last two rounds."""
    seen = H.excluded_ids(responses(spark, sf).select("uid", "round", "sid"), "uid", "round", "sid", 2).join(manifest(spark, sf).select("sid"), "sid", "left_semi")
    n = manifest(spark, sf).count()
    return seen.groupBy("uid").agg((F.lit(n) - F.count(F.lit(1))).alias("unseen"))


def round_samples(spark, sf):
    """Per round 16 regular samples and 4 honeypots in hash order."""
    rounds = responses(spark, sf).select("round").distinct()
    key = F.sha2(F.concat_ws(":", F.col("sid").cast("string"), F.col("round").cast("string")), 256)
    w = Window.partitionBy("round").orderBy("key", "sid")
    keyed = manifest(spark, sf).join(F.broadcast(rounds)).withColumn("key", key)
    best = lambda pot, n: keyed.where(F.col("is_honeypot") == pot).withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)  # noqa: E731  each task keeps its own n before the shuffle
    return best(True, 4).unionByName(best(False, 16)).select("round", "sid", "is_honeypot")


def miner_challenge(spark, sf):
    """Ten of each uid's samples per round, by the challenge key."""
    key = hash_int(F.concat_ws(":", F.col("sid").cast("string"), F.col("uid").cast("string"), F.col("round").cast("string")))
    w = Window.partitionBy("uid", "round").orderBy(key, "sid")
    r = responses(spark, sf).select("uid", "round", "sid", key.alias("key")).withColumn("place", F.row_number().over(w).cast("long"))
    return r.where("place <= 10")


def dataset_refresh(spark, sf):
    """Months in which the number of customers with orders changed."""
    v = stakes(spark, sf).groupBy("step").agg(F.count(F.lit(1)).alias("version"))
    return v.select("step", "version", F.coalesce(F.col("version") != F.lag("version").over(Window.orderBy("step")), F.lit(False)).alias("refreshed"))


def paired_bootstrap(spark, sf):
    """Ten resampled rounds, shared by all domains: mean score per round and domain."""
    s = _scores(spark, sf).groupBy("sid").agg(F.round(F.avg("score"), 9).alias("score"))
    n = read(spark, sf, "documents").count()
    draws = spark.range(10 * n).select(F.floor(F.col("id") / n).alias("round"), (hash_int(F.concat(F.lit("b"), F.col("id").cast("string"))) % n).alias("sid"))
    return r6(draws.join(s, "sid").groupBy("round").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n")), "mean")


def next_ids(spark, sf):
    """Next sequential id of each source, from ids like source-123."""
    d = read(spark, sf, "documents").select("source", F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("id"))
    return d.groupBy("source").agg((F.max(F.substring_index("id", "-", -1).try_cast("bigint")) + 1).alias("next_id"))


def random_peers(spark, sf):
    """Two other uids for each uid: hashed steps around the ring of all uids, so that no uid meets every other."""
    ring = H.numbered(responses(spark, sf).select("uid").distinct(), "uid", "at")
    n = ring.count()
    step = hash_int(F.concat(F.lit("peer:"), F.col("uid").cast("string"))) % max(1, n - 2) + 1
    each = ring.select("uid", F.explode(F.array(F.pmod(F.col("at") + step, F.lit(n)), F.pmod(F.col("at") + step + 1, F.lit(n)))).alias("at"))
    return each.join(ring.withColumnRenamed("uid", "peer"), "at").select("uid", "peer")


def orphans(spark, sf):
    d, m = read(spark, sf, "documents").select("doc_id"), manifest(spark, sf).select("sid")
    both = d.join(m, d.doc_id == m.sid, "full")
    return both.agg(F.count_if(F.col("sid").isNull()).alias("without_label"), F.count_if(F.col("doc_id").isNull()).alias("without_document"))


def labelled_semi(spark, sf):
    m = manifest(spark, sf)
    return responses(spark, sf).join(m, "sid", "left_semi").groupBy("uid").agg(F.count(F.lit(1)).alias("n"))


def hotkey_differences(spark, sf):
    """Uids seen in round 0 only, in round 1 only, and in both."""
    r = responses(spark, sf)
    a, b = (r.where(F.col("round") == k).select("uid").distinct() for k in (0, 1))
    kinds = a.exceptAll(b).withColumn("side", F.lit("removed")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new"))).unionByName(a.intersect(b).withColumn("side", F.lit("both")))
    return kinds.select("side", "uid")


def hotkey_changes(spark, sf):
    """Uids new, removed or in both, of each round against the round before it."""
    seen = responses(spark, sf).select("round", "uid").distinct()
    rounds = seen.select("round").distinct().withColumn("place", F.row_number().over(Window.orderBy("round")))  # a row per round
    now = seen.join(F.broadcast(rounds), "round").select("place", "uid", F.lit(True).alias("here"))
    was = now.select((F.col("place") + 1).alias("place"), "uid", F.lit(True).alias("before"))
    side = F.when(F.col("here").isNull(), "removed").when(F.col("before").isNull(), "new").otherwise("both")
    both = now.join(was, ["place", "uid"], "full").select("place", "uid", side.alias("side"))
    return both.where("place > 1").join(F.broadcast(rounds), "place").select("round", "side", "uid")


def right_wins_merge(spark, sf):
    """Documents' language with labelled ones overwritten by their truth."""
    d, m = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("old")), manifest(spark, sf).select(F.col("sid").alias("id"), F.col("truth").alias("new"))
    return d.join(m, "id", "full").select("id", F.coalesce("new", "old").alias("value"))


def duplicate_ids(spark, sf):
    """Samples answered more than once by a uid: first and repeated event."""
    r = responses(spark, sf).select("uid", "sid", "event_id")
    w = Window.partitionBy("uid", "sid")
    d = r.withColumns({"n": F.count(F.lit(1)).over(w), "first_event": F.min("event_id").over(w)})
    return d.where("n > 1 and event_id <> first_event").select("uid", "sid", "first_event", F.col("event_id").alias("repeated"))


def schema_validation(spark, sf):
    """Rows that break a rule, one per rule."""
    d = read(spark, sf, "documents")
    rules = F.array(
        F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, "empty_text"), F.when(~F.coalesce("lang", F.lit("")).isin("en", "de", "fr"), "unknown_lang"),
        F.when(F.col("n_chars") != F.length("text"), "wrong_n_chars"), F.when(F.col("n_chars") > 5000, "long"),
    )
    return d.select("doc_id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("issue"))


def balance_by_source(spark, sf):
    d, m = read(spark, sf, "documents"), manifest(spark, sf)
    g = d.join(m, d.doc_id == m.sid).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("truth") == "anomalous").alias("anomalous"))
    share = F.col("anomalous") / F.col("n")
    return g.select("source", "n", "anomalous", F.round(share, 6).alias("share"), (~share.between(0.4, 0.6)).alias("unbalanced"))


def synthetic_responses(spark, sf):
    """Answers of three made-up scorers per labelled sample: a base by truth, a bias, and hash noise."""
    from ..functions.scalars import hash_fraction

    m = manifest(spark, sf)
    each = m.withColumn("miner", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])))
    noise = (hash_fraction(F.concat_ws(":", F.col("sid").cast("string"), F.col("miner").cast("string"))) - 0.5) * 0.18
    raw = F.when(F.col("truth") == "anomalous", 0.76).otherwise(0.24) + (F.col("miner") - 1) * 0.12 + noise
    return each.select("sid", "miner", F.round(F.greatest(F.lit(0.01), F.least(F.lit(0.99), raw)) + 1e-10, 6).alias("score"))


QUERIES = {f.__name__: f for f in (
    collusion_pairs, collusion_groups, collusion_penalty, rank_agreement, judge_outliers, capped_weights, emitted_weights, weight_audit, processed_weights,
    snapshot_changes, coordinated_drops, diversity_bonus, population_diversity, subnet_health, trust_score, api_health, ema_scores, trajectories,
    oscillation_events, metastable_events, replica_divergence, replica_gaps, convergence_counts, stale_scores, failure_runs, mean_latency, history_window,
    telemetry_percentiles, feedback_signals, alert_cooldown, rate_limit, rotation_exclusions, unseen_samples, round_samples, miner_challenge, dataset_refresh,
    paired_bootstrap, next_ids, random_peers, orphans, labelled_semi, hotkey_differences, hotkey_changes, right_wins_merge, duplicate_ids, schema_validation,
    balance_by_source, synthetic_responses,
)}

from .metric_queries import _g, _rewards as _rw  # noqa: E402

_V = "v AS (SELECT uid, sid, avg(score) AS score FROM responses WHERE score IS NOT NULL GROUP BY ALL)"
_PAIRS = f"""{_V}, pr AS (SELECT a.uid AS a, b.uid AS b, count(*) AS shared, CASE WHEN sqrt(sum(a.score * a.score) * sum(b.score * b.score)) > 0 THEN sum(a.score * b.score) / sqrt(sum(a.score * a.score) * sum(b.score * b.score)) ELSE 0 END AS cosine
    FROM v a JOIN v b ON a.sid = b.sid AND a.uid < b.uid GROUP BY ALL HAVING count(*) >= 3)"""
_JUDGES = """j AS (SELECT event_type AS judge, uid, round(avg(score), 9) AS score FROM responses JOIN events USING (event_id) WHERE score IS NOT NULL GROUP BY ALL),
    mt AS (SELECT x.judge AS a, y.judge AS b, x.score AS x, y.score AS y FROM j x JOIN j y ON x.uid = y.uid AND x.judge < y.judge),
    rk AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS ry FROM mt),
    rho AS (SELECT a, b, count(*) AS n, CASE WHEN count(DISTINCT rx) > 1 AND count(DISTINCT ry) > 1 THEN corr(rx, ry) ELSE 0.0 END AS rho FROM rk GROUP BY a, b)"""
_W = "w AS (SELECT step, uid, stake / sum(stake) OVER (PARTITION BY step) AS weight FROM stakes)"
_T = "t AS (SELECT uid, day, round(avg(score), 6) AS score FROM responses WHERE score IS NOT NULL GROUP BY ALL), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY day DESC) AS k FROM t) WHERE k <= 20)"
_OSC = """d AS (SELECT uid, day, sign(score - lag(score) OVER (PARTITION BY uid ORDER BY day)) AS s FROM l), e AS (SELECT uid, s <> lag(s) OVER (PARTITION BY uid ORDER BY day) AS c FROM d WHERE s <> 0),
    osc AS (SELECT uid, count(*) FILTER (c) AS sign_changes FROM e GROUP BY uid HAVING count(*) FILTER (c) >= 4)"""
_META = "meta AS (SELECT uid, count(*) AS n, var_pop(score) AS variance, median(score) AS median FROM l GROUP BY uid HAVING count(*) >= 10 AND var_pop(score) < 0.05 AND median(score) < 0.5)"
_GAP = "o AS (SELECT uid, day, round(avg(score), 6) AS score FROM responses WHERE score IS NOT NULL AND event_id % 2 = 0 GROUP BY ALL), gap AS (SELECT uid, max(abs(t.score - o.score)) AS gap FROM t JOIN o USING (uid, day) GROUP BY uid HAVING max(abs(t.score - o.score)) > 0.05)"
_SEEN = "s AS (SELECT DISTINCT uid, sid FROM (SELECT uid, sid, dense_rank() OVER (PARTITION BY uid ORDER BY round DESC) AS r FROM responses) WHERE r <= 2)"
_r = lambda x, as_: f"round(({x})::DOUBLE + 1e-10, 6) AS {as_}"

SQL = {
    "collusion_pairs": with_views(f"WITH {_PAIRS} SELECT a, b, shared, {_r('cosine', 'cosine')} FROM pr WHERE round(cosine, 9) >= 0.99", "responses"),
    "collusion_penalty": _g(f"WITH {_rw('round', 'uid')}, {_PAIRS}, m AS (SELECT a AS uid FROM pr WHERE round(cosine, 9) >= 0.99 UNION SELECT b FROM pr WHERE round(cosine, 9) >= 0.99) SELECT uid, round, {_r('CASE WHEN uid IN (SELECT uid FROM m) THEN 0 ELSE reward END', 'reward')} FROM rw"),
    "rank_agreement": with_views(f"WITH {_JUDGES} SELECT a, b, n, {_r('rho', 'rho')} FROM rho", "responses"),
    "judge_outliers": with_views(f"WITH {_JUDGES}, u AS (SELECT a AS judge, rho FROM rho UNION ALL SELECT b, rho FROM rho) SELECT judge, {_r('avg(rho)', 'mean_rho')}, avg(rho) < 0.5 AS outlier FROM u GROUP BY judge", "responses"),
    "capped_weights": with_views(f"""WITH {_W},
        b AS (SELECT *, count(*) OVER p AS n, sum(weight) OVER p AS s, max(weight) OVER p AS top, row_number() OVER o AS i, sum(weight) OVER o AS c FROM w WINDOW p AS (PARTITION BY step), o AS (PARTITION BY step ORDER BY weight, uid ROWS UNBOUNDED PRECEDING)),
        k AS (SELECT *, count(*) FILTER (weight / s / ((n - i) * weight / s + c / s + 1e-7) < 0.1) OVER (PARTITION BY step) AS k FROM b),
        x AS (SELECT *, max(CASE WHEN i = k THEN c / s END) OVER (PARTITION BY step) AS ck FROM k),
        y AS (SELECT *, CASE WHEN top / s <= 0.1 THEN weight ELSE least(weight, (0.1 * ck - 1e-7) / (1 - 0.1 * (n - k)) * s) END AS cut FROM x)
        SELECT step, uid, {_r('CASE WHEN s = 0 OR n * 0.1 <= 1 THEN 1.0 / n ELSE cut / sum(cut) OVER (PARTITION BY step) END', 'weight')} FROM y""", "stakes"),
    "emitted_weights": with_views("SELECT step, uid, CAST(round_even(round(stake, 2) / max(round(stake, 2)) OVER (PARTITION BY step) * 65535, 0) AS BIGINT) AS u16 FROM stakes QUALIFY u16 > 0", "stakes"),
    "weight_audit": with_views(f"WITH {_W}, a AS (SELECT step, stddev_pop(weight) FILTER (weight > 0) AS sd, count(*) FILTER (weight > 0) AS n, max(weight) AS top FROM w GROUP BY step) SELECT step, 'low_variance' AS warning FROM a WHERE n >= 2 AND sd < 0.001 UNION ALL SELECT step, 'dominant_weight' FROM a WHERE top > 0.5", "stakes"),
    "processed_weights": with_views(f"WITH {_W}, q AS (SELECT step, quantile_cont(weight, 0.1) AS q FROM w GROUP BY step) SELECT step, uid, {_r('weight / sum(weight) OVER (PARTITION BY step)', 'weight')} FROM w JOIN q USING (step) WHERE weight >= q", "stakes"),
    "snapshot_changes": with_views(f"""WITH st AS (SELECT DISTINCT step FROM stakes), p AS (SELECT a.step FROM st a JOIN st b ON b.step = a.step - 1),
        f AS (SELECT coalesce(h.step, l.step + 1) AS step, h.stake, l.stake AS was FROM stakes h FULL JOIN stakes l ON l.uid = h.uid AND l.step = h.step - 1),
        g AS (SELECT step, count(*) FILTER (was IS NULL) AS came, count(*) FILTER (stake IS NULL) AS went, sum(coalesce(stake, 0)) AS total, sum(coalesce(was, 0)) AS before FROM f JOIN p USING (step) GROUP BY step),
        m AS (SELECT *, abs(total - before) / greatest(before, 1e-6) AS moved FROM g)
        SELECT step, came, went, {_r('moved', 'shift')}, came > 3 AS mass_registration, went > 3 AS mass_deregistration, moved > 0.1 AS stake_shift, came >= 3 AS surge FROM m""", "stakes"),
    "coordinated_drops": _g(f"WITH {_rw('round', 'uid')}, l AS (SELECT round, reward, lag(reward) OVER (PARTITION BY uid ORDER BY round) AS was FROM rw), f AS (SELECT round, coalesce(was > 1e-6 AND (was - reward) / was > 0.5, false) AS fell FROM l) SELECT round, count(*) FILTER (fell) AS fell, count(*) AS n, count(*) FILTER (fell) > 0.3 * count(*) AS attack FROM f GROUP BY round"),
    "diversity_bonus": _g(f"""WITH {_rw('round', 'uid')},
        c AS (SELECT a.uid AS a, b.uid AS b, CASE WHEN sum(a.reward * a.reward) * sum(b.reward * b.reward) > 0 THEN sum(a.reward * b.reward) / sqrt(sum(a.reward * a.reward) * sum(b.reward * b.reward)) ELSE 0 END AS c FROM rw a JOIN rw b ON a.round = b.round AND a.uid <> b.uid GROUP BY ALL),
        t AS (SELECT a AS uid, max(c) AS top FROM c GROUP BY a), n AS (SELECT uid, sum(reward * reward) AS norm FROM rw GROUP BY uid)
        SELECT n.uid, {_r('CASE WHEN top IS NULL OR norm = 0 THEN 0.5 ELSE greatest(0, least(1, 1 - greatest(0, top))) END', 'diversity')} FROM n LEFT JOIN t ON t.uid = n.uid"""),
    "population_diversity": _g(f"WITH {_rw('round', 'uid')}, s AS (SELECT stddev_pop(reward) AS s FROM rw GROUP BY uid HAVING count(*) >= 5) SELECT {_r('CASE WHEN count(*) < 2 THEN 0.5 ELSE least(avg(s) / 0.5, 1) END', 'index')}, count(*) AS uids FROM s"),
    "subnet_health": with_views(f"""WITH s AS (SELECT i AS today, uid, max(day) AS last FROM range(30) t(i) JOIN (SELECT DISTINCT uid, day FROM responses WHERE score IS NOT NULL) ON day <= i GROUP BY ALL),
        g AS (SELECT today, count(*) AS n, count(*) FILTER (today - last > 3) AS inactive FROM s GROUP BY today), h AS (SELECT *, least(1, inactive / greatest(n, 1)) AS i FROM g)
        SELECT today, n, inactive, {_r('i', 'inflammation')}, CASE WHEN i < 0.1 THEN 'healthy' WHEN i < 0.3 THEN 'mild' WHEN i < 0.6 THEN 'moderate' ELSE 'severe' END AS level FROM h""", "responses"),
    "trust_score": with_views(f"""WITH w AS (SELECT uid, round(sum(stake), 2) AS weight FROM stakes GROUP BY uid),
        p AS (SELECT r.*, weight, row_number() OVER (PARTITION BY sid, round ORDER BY weight DESC, r.uid) AS k FROM responses r JOIN w ON w.uid = r.uid),
        g AS (SELECT sid, round, count(score) AS n, sum(weight) FILTER (score IS NOT NULL) AS sw, sum(weight * score) AS ws, sum(weight * coalesce(confidence, 0.5)) FILTER (score IS NOT NULL) AS wc FROM p WHERE k <= 5 GROUP BY ALL)
        SELECT sid, round, {_r('coalesce(ws / sw, 0.5)', 'score')}, {_r('CASE WHEN n > 0 THEN wc / sw ELSE 0 END', 'confidence')}, n FROM g""", "responses", "stakes"),
    "api_health": with_views("SELECT count(*) FILTER (coalesce(score, 0) <> 0) AS nonzero, count(DISTINCT uid) AS uids, max(day) AS last_day FROM responses", "responses"),
    "ema_scores": _g(f"""WITH RECURSIVE {_rw('round', 'uid')}, o AS (SELECT uid, round, reward, row_number() OVER (PARTITION BY uid ORDER BY round) AS i FROM rw),
        e AS (SELECT uid, round, i, 0.1 * reward AS ema FROM o WHERE i = 1 UNION ALL SELECT o.uid, o.round, o.i, 0.1 * o.reward + 0.9 * e.ema FROM o JOIN e ON e.uid = o.uid AND o.i = e.i + 1)
        SELECT uid, round, {_r('ema', 'ema')} FROM e""".replace("WITH RECURSIVE", "WITH")).replace("WITH responses", "WITH RECURSIVE responses", 1),
    "trajectories": with_views(f"WITH {_T} SELECT uid, min(day) AS day_start, max(day) AS day_end, count(*) AS n FROM l GROUP BY uid", "responses"),
    "oscillation_events": with_views(f"WITH {_T}, {_OSC} SELECT * FROM osc", "responses"),
    "metastable_events": with_views(f"WITH {_T}, {_META} SELECT uid, n, {_r('variance', 'variance')}, {_r('median', 'median')} FROM meta", "responses"),
    "replica_gaps": with_views(f"WITH r AS (SELECT uid, day, round(avg(score), 6) AS a, round(avg(confidence), 6) AS b FROM responses WHERE score IS NOT NULL GROUP BY uid, day) SELECT uid, {_r('max(abs(a - b))', 'gap')} FROM r GROUP BY uid HAVING max(abs(a - b)) > 0.05", "responses"),
    "replica_divergence": with_views(f"WITH {_T}, {_GAP} SELECT uid, {_r('gap', 'gap')} FROM gap", "responses"),
    "convergence_counts": with_views(f"WITH {_T}, {_OSC}, {_META}, {_GAP}, u AS (SELECT 'oscillation' AS event FROM osc UNION ALL SELECT 'metastability' FROM meta UNION ALL SELECT 'convergence_failure' FROM gap) SELECT event, count(*) AS n FROM u GROUP BY event", "responses"),
    "stale_scores": with_views("""WITH r AS (SELECT uid, event_id, round(score, 1) AS v FROM responses WHERE score IS NOT NULL), x AS (SELECT uid, event_id, v, lag(v) OVER w AS a, lag(v, 2) OVER w AS b FROM r WINDOW w AS (PARTITION BY uid ORDER BY event_id))
        SELECT uid, event_id FROM x WHERE abs(v - b) < 1e-6 AND abs(a - b) < 1e-6""", "responses"),
    "failure_runs": with_views("""WITH i AS (SELECT uid, event_id, score IS NULL AS f, sum(CASE WHEN score IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY uid ORDER BY event_id) AS g FROM responses)
        SELECT uid, event_id, CAST(count(*) OVER (PARTITION BY uid, g ORDER BY event_id) - CASE WHEN g > 0 THEN 1 ELSE 0 END AS BIGINT) AS consecutive_failures FROM i QUALIFY f""", "responses"),
    "mean_latency": with_views(f"SELECT uid, event_id, {_r('avg(latency) OVER (PARTITION BY uid ORDER BY event_id ROWS UNBOUNDED PRECEDING)', 'mean_latency')} FROM responses WHERE score IS NOT NULL", "responses"),
    "history_window": with_views(f"SELECT uid, event_id, {_r('avg(score) OVER w', 'mean')}, count(score) OVER w AS n FROM responses WHERE score IS NOT NULL WINDOW w AS (PARTITION BY uid ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)", "responses"),
    "telemetry_percentiles": "WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) WHERE k <= 100) SELECT event_type, " + ", ".join(_r(f"quantile_cont(value, {p / 100})", f"p{p}") for p in (25, 50, 75, 95)) + " FROM l GROUP BY event_type",
    "feedback_signals": _g(f"WITH {_rw('round', 'uid')}, l AS (SELECT uid, round, reward, lag(reward) OVER (PARTITION BY uid ORDER BY round) AS w FROM rw) SELECT uid, round, {_r('greatest(-1, least(1, CASE WHEN w IS NULL OR w = 0 THEN 0 ELSE (reward - w) / abs(w) * 10 END))', 'signal')} FROM l"),
    "alert_cooldown": with_views("""WITH RECURSIVE a AS (SELECT DISTINCT uid, day AS step FROM responses WHERE score IS NULL),
        e AS (SELECT uid, min(step) AS step FROM a GROUP BY uid UNION ALL (SELECT a.uid, min(a.step) FROM a JOIN e ON e.uid = a.uid AND a.step - e.step > 10 GROUP BY a.uid, e.step)) SELECT uid, step FROM e""".replace("WITH RECURSIVE", "WITH"), "responses").replace("WITH responses", "WITH RECURSIVE responses", 1),
    "rotation_exclusions": with_views(f"WITH {_SEEN} SELECT uid, sid FROM s", "responses"),
    "unseen_samples": with_views(f"WITH {_SEEN} SELECT uid, (SELECT count(*) FROM manifest) - count(*) AS unseen FROM s WHERE sid IN (SELECT sid FROM manifest) GROUP BY uid", "responses", "manifest"),
    "round_samples": with_views("""WITH r AS (SELECT DISTINCT round FROM responses), p AS (SELECT round, sid, is_honeypot, row_number() OVER (PARTITION BY round, is_honeypot ORDER BY sha256(sid || ':' || round), sid) AS k FROM manifest, r)
        SELECT round, sid, is_honeypot FROM p WHERE k <= CASE WHEN is_honeypot THEN 4 ELSE 16 END""", "responses", "manifest"),
    "miner_challenge": with_views("""WITH k AS (SELECT uid, round, sid, CAST('0x' || substr(sha256(sid || ':' || uid || ':' || round), 1, 8) AS BIGINT) AS key FROM responses), p AS (SELECT *, row_number() OVER (PARTITION BY uid, round ORDER BY key, sid) AS place FROM k) SELECT * FROM p WHERE place <= 10""", "responses"),
    "dataset_refresh": with_views("WITH v AS (SELECT step, count(*) AS version FROM stakes GROUP BY step) SELECT step, version, coalesce(version <> lag(version) OVER (ORDER BY step), false) AS refreshed FROM v", "stakes"),
    "paired_bootstrap": with_views(f"""WITH s AS (SELECT sid, round(avg(score), 9) AS score FROM responses WHERE score IS NOT NULL GROUP BY sid), n AS (SELECT count(*) AS n FROM documents),
        d AS (SELECT i // n AS round, CAST('0x' || substr(sha256('b' || i), 1, 8) AS BIGINT) % n AS sid FROM n, range(10 * (SELECT count(*) FROM documents)) t(i)) SELECT round, {_r('avg(score)', 'mean')}, count(*) AS n FROM d JOIN s USING (sid) GROUP BY round""", "responses"),
    "next_ids": "SELECT source, max(doc_id) + 1 AS next_id FROM documents GROUP BY source",
    "random_peers": with_views("""WITH r AS (SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS at_, count(*) OVER () AS n FROM (SELECT DISTINCT uid FROM responses)),
        e AS (SELECT uid, (at_ + CAST('0x' || substr(sha256('peer:' || uid), 1, 8) AS BIGINT) % greatest(1, n - 2) + 1 + k) % n AS at_ FROM r, range(2) t(k)) SELECT e.uid, r.uid AS peer FROM e JOIN r ON r.at_ = e.at_""", "responses"),
    "orphans": "SELECT count(*) FILTER (l.doc_id IS NULL) AS without_label, count(*) FILTER (d.doc_id IS NULL) AS without_document FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id",
    "labelled_semi": with_views("SELECT uid, count(*) AS n FROM responses WHERE sid IN (SELECT doc_id FROM labels) GROUP BY uid", "responses"),
    "hotkey_differences": with_views("""WITH a AS (SELECT DISTINCT uid FROM responses WHERE round = 0), b AS (SELECT DISTINCT uid FROM responses WHERE round = 1)
        SELECT CASE WHEN b.uid IS NULL THEN 'removed' WHEN a.uid IS NULL THEN 'new' ELSE 'both' END AS side, coalesce(a.uid, b.uid) AS uid FROM a FULL JOIN b ON a.uid = b.uid""", "responses"),
    "right_wins_merge": with_views("SELECT coalesce(doc_id, sid) AS id, coalesce(truth, lang) AS value FROM documents FULL JOIN manifest ON sid = doc_id", "manifest"),
    "duplicate_ids": with_views("SELECT uid, sid, min(event_id) OVER (PARTITION BY uid, sid) AS first_event, event_id AS repeated FROM responses QUALIFY event_id <> first_event", "responses"),
    "schema_validation": """SELECT doc_id, issue FROM (SELECT doc_id, unnest([CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty_text' END, CASE WHEN coalesce(lang, '') NOT IN ('en', 'de', 'fr') THEN 'unknown_lang' END, CASE WHEN n_chars <> length(text) THEN 'wrong_n_chars' END, CASE WHEN n_chars > 5000 THEN 'long' END]) AS issue FROM documents) WHERE issue IS NOT NULL""",
    "balance_by_source": with_views("WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (truth = 'anomalous') AS anomalous FROM documents JOIN manifest ON sid = doc_id GROUP BY source) SELECT source, n, anomalous, round((anomalous / n)::DOUBLE, 6) AS share, NOT (anomalous / n BETWEEN 0.4 AND 0.6) AS unbalanced FROM g", "manifest"),
    "synthetic_responses": with_views(f"""WITH e AS (SELECT sid, truth, m AS miner FROM manifest, range(3) t(m)), n AS (SELECT *, (CAST('0x' || substr(sha256(sid || ':' || miner), 1, 16) AS UBIGINT) / 18446744073709551615.0 - 0.5) * 0.18 AS noise FROM e)
        SELECT sid, miner, {_r("greatest(0.01, least(0.99, CASE truth WHEN 'anomalous' THEN 0.76 ELSE 0.24 END + (miner - 1) * 0.12 + noise))", 'score')} FROM n""", "manifest"),
}
