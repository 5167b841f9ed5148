"""Callers, rotation, surveillance and rewards with the parameters of the running service."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import history as H
from ..operators import metrics as M
from ..operators import network as N
from ..sources.tables import read, responses, stakes, with_views
from .detect_queries import _NN, _neighbours
from .metric_queries import _ECE, _g, _graded, _rewards as _rw
from .network_queries import _rewards, _scores, _trajectory, r6

# Steps without an answer before a uid is inactive, and before it may go; equal scores that make it stale.
INACTIVE, DEREGISTER, STALE = 10, 50, 5


def caller_gate(spark, sf):
    """Each caller's admission and priority: unknown ones and those without stake are rejected, else the stake is the priority."""
    calls = read(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"))
    known = stakes(spark, sf).groupBy("uid").agg(F.round(F.sum("stake"), 2).alias("stake"))
    met = calls.join(known, calls.user_id == known.uid, "left")
    status = F.when(F.col("user_id").isNull(), "missing_caller").when(F.col("uid").isNull(), "unrecognized").when(F.col("stake") <= 0, "insufficient_stake").otherwise("recognized")
    return met.select("user_id", "calls", status.alias("status"), (status != "recognized").alias("rejected"), F.coalesce("stake", F.lit(0.0)).alias("priority"))


def rotation_ema(spark, sf):
    """EMA of each uid's rewards that starts anew whenever the key behind the uid changes (here its first kind of answer in a round)."""
    kinds = responses(spark, sf).join(read(spark, sf, "events").select("event_id", "event_type"), "event_id")
    keys = kinds.groupBy("uid", "round").agg(F.min_by("event_type", "event_id").alias("hotkey"))
    w = Window.partitionBy("uid").orderBy("round")
    turned = _rewards(spark, sf).join(keys, ["uid", "round"]).withColumn("turned", F.coalesce((F.col("hotkey") != F.lag("hotkey").over(w)).cast("long"), F.lit(0)))
    runs = turned.withColumn("run", F.sum("turned").over(w))
    return r6(H.ema(runs, "round", "reward", "uid", "run").select("uid", "run", "round", "ema"), "ema")


def stale_counts(spark, sf):
    """How often each uid's last five scores were one."""
    r = H.stale(_scores(spark, sf), "event_id", "score", "uid", n=STALE)
    return r.groupBy("uid").agg(F.count_if("stale").alias("n_stale"), F.count(F.lit(1)).alias("n"))


def metastability(spark, sf):
    """Whether each uid's last 20 daily scores stay low without moving: 10 or more, variance below 1e-4, median below a half."""
    t = H.last_n(_trajectory(spark, sf), 20, "day", "uid")
    g = t.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.var_pop("score").alias("variance"), F.median("score").alias("median"))
    return r6(g.withColumn("metastable", (F.col("n") >= 10) & (F.col("variance") < 1e-4) & (F.col("median") < 0.5)), "variance", "median")


def self_region_scores(spark, sf):
    """How far the vectors divisible by 20 are outside the self region, of the whole radius."""
    found = _neighbours(spark, sf, 1)
    return found.select("qid", F.round(D.negative_selection(F.col("distance"), D.self_radius(found)), 5).alias("score"))


def daily_health(spark, sf, after: int = 3):
    """Per day from the first to the last: uids seen so far, those that answered nothing for over `after` days, and what that means.

    A uid's answer makes it active until `after` days later or its next answer, so it adds to the counts at
    few days and the counts are running sums over days: no day meets every other."""
    ok = _scores(spark, sf).select("uid", "day").distinct()
    w = Window.partitionBy("uid").orderBy("day")
    seen = ok.withColumns({"next": F.lead("day").over(w), "k": F.row_number().over(w)})
    deltas = seen.select(F.inline(F.array(
        F.struct(F.col("day").alias("day"), F.when(F.col("k") == 1, 1).otherwise(0).alias("n"), F.lit(0).alias("off")),
        F.struct((F.col("day") + after + 1).alias("day"), F.lit(0).alias("n"), F.when(F.col("next").isNull() | (F.col("next") > F.col("day") + after + 1), 1).otherwise(0).alias("off")),
        F.struct(F.col("next").alias("day"), F.lit(0).alias("n"), F.when(F.col("next") > F.col("day") + after + 1, -1).otherwise(0).alias("off")),
    )))
    span = ok.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    every = span.select(F.explode(F.sequence("lo", "hi")).alias("day"), F.lit(0).alias("n"), F.lit(0).alias("off"))
    days = deltas.unionByName(every).groupBy("day").agg(F.sum("n").alias("n"), F.sum("off").alias("off"))
    upto = Window.orderBy("day")  # a row a day
    run = days.where("day is not null").select("day", F.sum("n").over(upto).alias("n"), F.sum("off").over(upto).alias("inactive"))
    i = F.least(F.lit(1.0), F.col("inactive") / F.greatest("n", F.lit(1)))
    level = F.when(i < 0.1, "low").when(i < 0.3, "medium").when(i < 0.6, "high").otherwise("critical")
    inside = run.join(F.broadcast(span), (F.col("day") >= F.col("lo")) & (F.col("day") <= F.col("hi")))
    return inside.select("day", "n", "inactive", F.round(i + 1e-10, 6).alias("inflammation"), level.alias("level"), (F.col("n") - F.col("inactive")).alias("active"))


def surveillance(spark, sf):
    """Alerts of a whole cycle: coordinated drops and surges by step, and the uids that are inactive, stale or may go at the end."""
    r = _rewards(spark, sf)
    attacks = N.coordinated_drops(r).where("attack").select(F.lit("coordinated_attack").alias("type"), F.lit(-1).cast("long").alias("uid"), F.col("round").cast("long").alias("step"))
    surges = N.snapshot_changes(stakes(spark, sf)).where("surge").select(F.lit("registration_surge").alias("type"), F.lit(-1).cast("long").alias("uid"), F.col("step").cast("long").alias("step"))
    answers = responses(spark, sf)
    last = answers.groupBy("uid").agg(F.max(F.when(F.col("score").isNotNull(), F.col("day"))).alias("last"))
    end = answers.agg(F.max("day").alias("now"))
    gaps = last.crossJoin(F.broadcast(end)).withColumn("gap", F.col("now") - F.coalesce("last", F.lit(0)))
    own = lambda kind, cond: gaps.where(cond).select(F.lit(kind).alias("type"), "uid", F.col("now").alias("step"))
    five = H.last_n(H.stale(_scores(spark, sf), "event_id", "score", "uid", n=STALE), 1, "event_id", "uid").where("stale")
    still = five.select("uid").crossJoin(F.broadcast(end)).select(F.lit("stale").alias("type"), "uid", F.col("now").alias("step"))
    return attacks.unionByName(surges).unionByName(own("inactive", F.col("gap") > INACTIVE)).unionByName(own("deregistration", F.col("gap") > DEREGISTER)).unionByName(still)


def blended_rewards(spark, sf):
    """0.7 base, 0.1 calibration, 0.1 robustness and 0.1 diversity of each uid, 0 for a failed honeypot."""
    g = _graded(spark, sf)
    base = M.exact_rewards(g, "uid").select("uid", "reward", "failed")
    cal = M.calibration_error(g.where("valid"), F.col("confidence"), F.when(F.col("flagged") == F.col("actual"), 1.0).otherwise(0.0), "uid").select("uid", "bonus")
    st = M.stability(g.where("valid"), F.col("score"), "uid")
    div = N.diversity(_rewards(spark, sf).select("uid", F.col("round").alias("pos"), F.col("reward").alias("value")))
    total = M.clip(0.7 * F.col("reward") + 0.1 * F.coalesce("bonus", F.lit(1.0)) + 0.1 * F.coalesce("stability", F.lit(1.0)) + 0.1 * F.coalesce("diversity", F.lit(0.5)))
    met = base.join(cal, "uid", "left").join(st, "uid", "left").join(div, "uid", "left")
    return met.select("uid", F.round(F.when(F.col("failed"), 0.0).otherwise(total) + 1e-10, 6).alias("reward"))


def telemetry_calibration(spark, sf):
    """Expected calibration error of the last 100 answers of each kind: confidence against the share of scores over a half."""
    e = responses(spark, sf).where("score is not null").join(read(spark, sf, "events").select("event_id", "event_type"), "event_id")
    t = H.last_n(e, 100, "event_id", "event_type")
    return r6(M.calibration_error(t, F.col("confidence"), (F.col("score") > 0.5).cast("double"), "event_type").select("event_type", "ece"), "ece")


QUERIES = {f.__name__: f for f in (
    caller_gate, rotation_ema, stale_counts, metastability, self_region_scores, daily_health, surveillance, blended_rewards, telemetry_calibration,
)}

_r = lambda x, as_: f"round(({x})::DOUBLE + 1e-10, 6) AS {as_}"
_BINS = " + ".join(f"CASE WHEN confidence >= CAST({e!r} AS DOUBLE) THEN 1 ELSE 0 END" for e in M.EDGES)
_STALE = """x AS (SELECT uid, event_id, score AS v, lag(score) OVER w AS a, lag(score, 2) OVER w AS b, lag(score, 3) OVER w AS c, lag(score, 4) OVER w AS d FROM responses WHERE score IS NOT NULL WINDOW w AS (PARTITION BY uid ORDER BY event_id)),
    st AS (SELECT uid, event_id, coalesce(abs(v - d) < 1e-6 AND abs(a - d) < 1e-6 AND abs(b - d) < 1e-6 AND abs(c - d) < 1e-6, false) AS stale FROM x)"""

SQL = {
    "caller_gate": with_views("""
        WITH c AS (SELECT user_id, count(*) AS calls FROM events GROUP BY user_id), k AS (SELECT uid, round(sum(stake), 2) AS stake FROM stakes GROUP BY uid),
        s AS (SELECT user_id, calls, CASE WHEN user_id IS NULL THEN 'missing_caller' WHEN uid IS NULL THEN 'unrecognized' WHEN stake <= 0 THEN 'insufficient_stake' ELSE 'recognized' END AS status, coalesce(stake, 0.0) AS priority FROM c LEFT JOIN k ON uid = user_id)
        SELECT user_id, calls, status, status <> 'recognized' AS rejected, priority FROM s""", "stakes"),
    "rotation_ema": _g(f"""WITH RECURSIVE {_rw('round', 'uid')}, h AS (SELECT uid, round, arg_min(event_type, event_id) AS hotkey FROM responses JOIN events USING (event_id) GROUP BY uid, round),
        t AS (SELECT rw.uid, rw.round, reward, coalesce((hotkey <> lag(hotkey) OVER (PARTITION BY rw.uid ORDER BY rw.round))::BIGINT, 0) AS turned FROM rw JOIN h ON h.uid = rw.uid AND h.round = rw.round),
        u AS (SELECT *, CAST(sum(turned) OVER (PARTITION BY uid ORDER BY round) AS BIGINT) AS run FROM t), o AS (SELECT uid, run, round, reward, row_number() OVER (PARTITION BY uid, run ORDER BY round) AS i FROM u),
        e AS (SELECT uid, run, round, i, 0.1 * reward AS ema FROM o WHERE i = 1 UNION ALL SELECT o.uid, o.run, o.round, o.i, 0.1 * o.reward + 0.9 * e.ema FROM o JOIN e ON e.uid = o.uid AND e.run = o.run AND o.i = e.i + 1)
        SELECT uid, run, round, {_r('ema', 'ema')} FROM e""".replace("WITH RECURSIVE", "WITH")).replace("WITH responses", "WITH RECURSIVE responses", 1),
    "stale_counts": with_views(f"WITH {_STALE} SELECT uid, count(*) FILTER (stale) AS n_stale, count(*) AS n FROM st GROUP BY uid", "responses"),
    "metastability": with_views(f"""
        WITH t AS (SELECT uid, day, round(avg(score), 6) AS score FROM responses WHERE score IS NOT NULL GROUP BY ALL), l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY uid ORDER BY day DESC) <= 20)
        SELECT uid, count(*) AS n, {_r('var_pop(score)', 'variance')}, {_r('median(score)', 'median')}, count(*) >= 10 AND var_pop(score) < 1e-4 AND median(score) < 0.5 AS metastable FROM l GROUP BY uid""", "responses"),
    "self_region_scores": f"WITH {_NN}, o AS (SELECT * FROM nn WHERE place = 1), r AS (SELECT greatest(0.05, least(2.0, quantile_cont(distance, 0.95))) AS r FROM o) SELECT qid, round(greatest(0, least(1, (distance - r) / (2 * r))), 5) AS score FROM o, r",
    "daily_health": with_views(f"""
        WITH ok AS (SELECT DISTINCT uid, day FROM responses WHERE score IS NOT NULL), dd AS (SELECT unnest(range(min(day), max(day) + 1)) AS d FROM ok),
        s AS (SELECT d, uid, max(day) AS last FROM dd JOIN ok ON day <= d GROUP BY ALL), c AS (SELECT d AS day, count(*) AS n, count(*) FILTER (d - last > 3) AS inactive FROM s GROUP BY d), h AS (SELECT *, least(1, inactive / greatest(n, 1)) AS i FROM c)
        SELECT day, n, inactive, {_r('i', 'inflammation')}, CASE WHEN i < 0.1 THEN 'low' WHEN i < 0.3 THEN 'medium' WHEN i < 0.6 THEN 'high' ELSE 'critical' END AS level, n - inactive AS active FROM h""", "responses"),
    "surveillance": _g(f"""WITH {_rw('round', 'uid')}, l AS (SELECT round, reward, lag(reward) OVER (PARTITION BY uid ORDER BY round) AS was FROM rw), f AS (SELECT round, coalesce(was > 1e-6 AND (was - reward) / was > 0.5, false) AS fell FROM l),
        ks AS (SELECT (year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS step, o_custkey AS uid FROM orders GROUP BY ALL), sp AS (SELECT DISTINCT step FROM ks),
        cm AS (SELECT a.step, count(*) AS came FROM ks a JOIN sp ON sp.step = a.step - 1 LEFT JOIN ks b ON b.uid = a.uid AND b.step = a.step - 1 WHERE b.uid IS NULL GROUP BY a.step),
        la AS (SELECT uid, (SELECT max(day) FROM responses) AS now, (SELECT max(day) FROM responses) - coalesce(max(day) FILTER (score IS NOT NULL), 0) AS gap FROM responses GROUP BY uid), {_STALE},
        fi AS (SELECT uid, arg_max(stale, event_id) AS stale FROM st GROUP BY uid)
        SELECT 'coordinated_attack' AS type, -1::BIGINT AS uid, round AS step FROM f GROUP BY round HAVING count(*) FILTER (fell) > 0.3 * count(*)
        UNION ALL SELECT 'registration_surge', -1, step::BIGINT FROM cm WHERE came >= 3 UNION ALL SELECT 'inactive', uid, now FROM la WHERE gap > 10 UNION ALL SELECT 'deregistration', uid, now FROM la WHERE gap > 50
        UNION ALL SELECT 'stale', uid, (SELECT max(day) FROM responses) FROM fi WHERE stale"""),
    "blended_rewards": _g(f"""WITH {_rw('uid').replace('rw AS', 'rb AS', 1)}, {_ECE}, sy AS (SELECT uid, CASE WHEN count(*) < 2 THEN 1.0 ELSE greatest(0, 1 - stddev_pop(score)) END::DOUBLE AS s FROM g WHERE valid GROUP BY uid), {_rw('round', 'uid')},
        c AS (SELECT a.uid AS a, b.uid AS b, CASE WHEN sum(a.reward * a.reward) * sum(b.reward * b.reward) > 0 THEN sum(a.reward * b.reward) / sqrt(sum(a.reward * a.reward) * sum(b.reward * b.reward)) ELSE 0 END AS c FROM rw a JOIN rw b ON a.round = b.round AND a.uid <> b.uid GROUP BY ALL),
        t AS (SELECT a AS uid, max(c) AS top FROM c GROUP BY a), n AS (SELECT uid, sum(reward * reward) AS norm FROM rw GROUP BY uid),
        dv AS (SELECT n.uid, CASE WHEN top IS NULL OR norm = 0 THEN 0.5 ELSE greatest(0, least(1, 1 - greatest(0, top))) END AS d FROM n LEFT JOIN t ON t.uid = n.uid)
        SELECT rb.uid, {_r('CASE WHEN failed THEN 0 ELSE greatest(0, least(1, 0.7 * rb.reward + 0.1 * coalesce(1 - ece, 1) + 0.1 * coalesce(s, 1) + 0.1 * coalesce(d, 0.5))) END', 'reward')}
        FROM rb LEFT JOIN ece ON ece.uid = rb.uid LEFT JOIN sy ON sy.uid = rb.uid LEFT JOIN dv ON dv.uid = rb.uid"""),
    "telemetry_calibration": with_views(f"""
        WITH e AS (SELECT event_type, score, confidence FROM responses JOIN events USING (event_id) WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 100),
        b AS (SELECT event_type, {_BINS} AS bin, count(*) AS n, avg(confidence) AS conf, avg((score > 0.5)::INT::DOUBLE) AS acc FROM e GROUP BY ALL)
        SELECT event_type, {_r('sum(n * abs(conf - acc)) / sum(n)', 'ece')} FROM b GROUP BY event_type""", "responses"),
}
