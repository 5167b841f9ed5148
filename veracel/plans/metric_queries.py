"""Queries of response checks, rewards, calibration and score quality."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources.tables import domain_of, manifest, read, responses, with_views


def _graded(spark, sf):
    return M.graded(responses(spark, sf), manifest(spark, sf))


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def validate_responses(spark, sf):
    e = read(spark, sf, "events")
    score = F.when(F.col("event_type") != "error", F.col("value") / 200)
    kind = F.when(F.col("event_type") == "purchase", "normal").when(F.col("event_type") == "signup", "xss")
    return e.select("event_id", M.validity(score, kind).alias("status"))


def policy_decisions(spark, sf):
    r = responses(spark, sf).where("score is not null")
    s, c = F.col("score"), F.col("confidence")
    return r.select("event_id", M.policy(s, c).alias("multiband"), M.policy(s, c, "operator").alias("simple"))


def request_gate(spark, sf):
    c = read(spark, sf, "conversations")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    return c.select("conv_id", "turn", F.when(blank, 400).when(~F.col("role").isin("user", "assistant"), 400).otherwise(200).cast("long").alias("status"))


def partition_honeypots(spark, sf):
    d, m = read(spark, sf, "documents"), manifest(spark, sf)
    return d.join(m, d.doc_id == m.sid, "left").select("doc_id", F.coalesce("is_honeypot", F.lit(False)).alias("is_honeypot"), F.coalesce("truth", F.lit("normal")).alias("truth"))


def score_payload(spark, sf):
    """Responses with a manifest row, their fields over the manifest's."""
    m = manifest(spark, sf)
    return responses(spark, sf).join(m, "sid").select("event_id", "sid", "truth", F.coalesce("score", F.lit(-1.0)).alias("score"))


def confusion_by_domain(spark, sf):
    g = _graded(spark, sf).where("valid").withColumn("domain", domain_of(F.col("sid")))
    out = M.rates(g.groupBy("domain").agg(*M.confusion(F.col("flagged"), F.col("actual")), F.round(F.avg("score"), 6).alias("mean_score")))
    return r6(out, "precision", "recall", "f1", "accuracy", "balanced_accuracy")


def round_rewards(spark, sf):
    return r6(M.exact_rewards(_graded(spark, sf), "round", "uid"), "reward")


def top_uids_by_reward(spark, sf):
    """The five best uids of each round."""
    w = Window.partitionBy("round").orderBy(F.desc("reward"), "uid")
    r = r6(M.exact_rewards(_graded(spark, sf), "round", "uid"), "reward")
    return r.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("round", "place", "uid", "reward")


def calibration_by_uid(spark, sf):
    g = _graded(spark, sf).where("valid")
    return r6(M.calibration_error(g, F.col("confidence"), F.when(F.col("flagged") == F.col("actual"), 1.0).otherwise(0.0), "uid"), "ece", "bonus")


def stability_by_uid(spark, sf):
    return r6(M.stability(responses(spark, sf).where("score is not null"), F.col("score"), "uid", "round"), "stability")


def hardened_rewards(spark, sf):
    """0.85 base + 0.15 stability."""
    base = M.exact_rewards(_graded(spark, sf), "uid", "round").select("uid", "round", "reward", "failed")
    st = M.stability(responses(spark, sf).where("score is not null"), F.col("score"), "uid", "round")
    mixed = F.when(F.col("failed"), 0.0).otherwise(0.85 * F.col("reward") + 0.15 * F.coalesce("stability", F.lit(1.0)))
    return base.join(st, ["uid", "round"], "left").select("uid", "round", F.round(mixed + 1e-10, 6).alias("reward"))


def composite_rewards(spark, sf):
    """0.7 base, 0.1 calibration, 0.1 robustness, 0.1 diversity (neutral 0.5 here), 0 for a failed honeypot."""
    g = _graded(spark, sf)
    base = M.exact_rewards(g, "uid").select("uid", "reward", "failed")
    cal = M.calibration_error(g.where("valid"), F.col("confidence"), F.when(F.col("flagged") == F.col("actual"), 1.0).otherwise(0.0), "uid").select("uid", "bonus")
    st = M.stability(g.where("valid"), F.col("score"), "uid")
    total = M.clip(0.7 * F.col("reward") + 0.1 * F.coalesce("bonus", F.lit(1.0)) + 0.1 * F.coalesce("stability", F.lit(1.0)) + 0.05)
    return base.join(cal, "uid", "left").join(st, "uid", "left").select("uid", F.round(F.when(F.col("failed"), 0.0).otherwise(total), 6).alias("reward"))


def score_quality(spark, sf):
    g = _graded(spark, sf).where("valid").withColumn("domain", domain_of(F.col("sid")))
    y = F.col("actual").cast("double")
    base = g.groupBy("domain").agg(
        F.avg((F.col("score") - y) * (F.col("score") - y)).alias("brier"),
        (F.coalesce(F.avg(F.when(F.col("actual"), F.col("score"))), F.lit(0.0)) - F.coalesce(F.avg(F.when(~F.col("actual"), F.col("score"))), F.lit(0.0))).alias("separation"),
        F.avg("latency").alias("latency"),
    )
    out = base.join(M.roc_auc(g, "score", "actual", "domain"), "domain").join(M.average_precision(g, "score", "actual", "domain"), "domain")
    return r6(out, "brier", "separation", "latency", "roc_auc", "average_precision")


def reliability_bins(spark, sf):
    g = _graded(spark, sf).where("valid")
    b = F.least(F.floor(F.col("score") * 5), F.lit(4)).alias("bin")
    return g.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(F.col("actual").cast("double")), 6).alias("share"))


def best_thresholds(spark, sf):
    g = _graded(spark, sf).where("valid").withColumn("domain", domain_of(F.col("sid")))
    return r6(M.threshold_search(g, "score", "actual", "domain"), "threshold", "reward")


def global_threshold(spark, sf):
    g = _graded(spark, sf).where("valid").withColumn("scope", F.lit("all"))
    return r6(M.threshold_search(g, "score", "actual", "scope"), "threshold", "reward")


def kl_of_rounds(spark, sf):
    r = responses(spark, sf).where("score is not null")
    return r6(M.kl_divergence(r.where("round = 0"), r.where("round = 1"), "score"), "kl")


def kl_by_round(spark, sf):
    """Divergence of each round's scores from those of the round before it."""
    r = responses(spark, sf).where("score between 0 and 1")
    counts = r.groupBy("round", F.least(F.floor(F.col("score") * 20), F.lit(19)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    rounds = counts.groupBy("round").agg(F.sum("n").alias("all")).withColumn("before", F.lag("round").over(Window.orderBy("round")))  # a row a round
    bins = rounds.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))))
    p = bins.join(counts, ["round", "bin"], "left").select("round", "before", "bin", (F.coalesce("n", F.lit(0)) / F.col("all") + 1e-10).alias("p"))
    q = p.select(F.col("round").alias("before"), "bin", F.col("p").alias("q"))
    return p.join(q, ["before", "bin"]).groupBy("round").agg(F.round(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))), 6).alias("kl"))


def multiband_grid(spark, sf):
    """Reward plus 0.05 coverage of every (low, high, confidence) on a grid; review counts as flagged.

    Rows are first counted per cell of the grid, so each setting meets cells and not rows."""
    g = _graded(spark, sf).where("valid")
    cut = lambda c: F.floor(F.col(c) * 10).cast("int")
    cells = g.groupBy(cut("score").alias("s"), cut("confidence").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.count_if("actual").alias("pos"))
    grid = spark.range(11).select(F.col("id").cast("int").alias("low")).crossJoin(spark.range(11).select(F.col("id").cast("int").alias("high"))).crossJoin(spark.range(10).select(F.col("id").cast("int").alias("least"))).where("low < high")
    met = F.broadcast(grid).crossJoin(cells)
    review = (F.col("c") < F.col("least")) | ((F.col("s") < F.col("high")) & (F.col("s") >= F.col("low")))
    flagged = review | (F.col("s") >= F.col("high"))
    n = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0))
    out = met.groupBy("low", "high", "least").agg(n(flagged, "pos").alias("tp"), (n(flagged, "n") - n(flagged, "pos")).alias("fp"), n(~flagged, "pos").alias("fn"), (1 - n(review, "n") / F.sum("n")).alias("coverage"))
    return out.select("low", "high", "least", F.round(M.reward(F.col("tp"), F.col("fp"), F.col("fn")) + 0.05 * F.col("coverage"), 6).alias("objective"))


def policy_overlays(spark, sf):
    """Flag rate per policy and domain, less the control policy's."""
    g = _graded(spark, sf).where("valid").withColumn("domain", domain_of(F.col("sid")))
    s, c = F.col("score"), F.col("confidence")
    each = g.select("domain", F.explode(F.create_map(F.lit("control"), M.policy(s, c, "simple") == "block", F.lit("multiband"), M.policy(s, c) != "allow", F.lit("strict"), s >= 0.3)).alias("policy", "flagged"))
    rate = each.groupBy("domain", "policy").agg(F.avg(F.col("flagged").cast("double")).alias("rate"))
    control = F.max(F.when(F.col("policy") == "control", F.col("rate"))).over(Window.partitionBy("domain"))
    return rate.select("domain", "policy", F.round("rate", 6).alias("rate"), F.round(F.col("rate") - control, 6).alias("delta"))


def score_surfaces(spark, sf):
    """Fixed weightings of two scores per document, with Brier scores against the labels."""
    weights = spark.createDataFrame([("control_equal", 0.5, False), ("w65", 0.65, False), ("w80", 0.8, False), ("modulated", 0.65, True)], "surface string, w double, modulated boolean")
    g = _graded(spark, sf).where("valid").select("event_id", F.col("score").alias("a"), F.col("confidence").alias("ca"), (1 - F.col("confidence")).alias("b"), F.col("score").alias("cb"), "actual")
    wa, wb = F.when(F.col("modulated"), F.col("w") * F.col("ca")).otherwise(F.col("w")), F.when(F.col("modulated"), (1 - F.col("w")) * F.col("cb")).otherwise(1 - F.col("w"))
    s = F.when(wa + wb == 0, F.col("w") * F.col("a") + (1 - F.col("w")) * F.col("b")).otherwise((wa * F.col("a") + wb * F.col("b")) / F.when(wa + wb == 0, 1.0).otherwise(wa + wb))
    y = F.col("actual").cast("double")
    return g.crossJoin(F.broadcast(weights)).groupBy("surface").agg(F.round(F.avg(s), 6).alias("mean_score"), F.round(F.avg((s - y) * (s - y)), 6).alias("brier"))


def ensemble_combinations(spark, sf):
    """Mean score of every combination of event types as scorers per (sid, round), graded."""
    g = _graded(spark, sf).where("valid")
    kinds = g.join(read(spark, sf, "events").select("event_id", "event_type"), "event_id")
    names = ("signup", "click", "view", "purchase")
    per = kinds.groupBy("sid", "actual").agg(
        *[F.sum(F.when(F.col("event_type") == k, F.col("score"))).alias(f"s{i}") for i, k in enumerate(names)], *[F.count_if(F.col("event_type") == k).alias(f"n{i}") for i, k in enumerate(names)]
    )
    made = []
    for combo in range(1, 16):  # each combination is four counts of one pass over the samples
        of = [i for i in range(4) if combo >> i & 1]
        n = sum((F.col(f"n{i}") for i in of), F.lit(0))
        flagged = F.round(sum((F.coalesce(f"s{i}", F.lit(0.0)) for i in of), F.lit(0.0)) / F.nullif(n, F.lit(0)), 9) >= 0.5
        made += [F.count_if(c).alias(f"{k}{combo}") for k, c in zip(("tp", "fp", "fn", "tn"), (flagged & F.col("actual"), flagged & ~F.col("actual"), ~flagged & F.col("actual"), ~flagged & ~F.col("actual")))]
    each = [F.struct(F.lit(combo).cast("long").alias("combo"), *[F.col(f"{k}{combo}").alias(k) for k in ("tp", "fp", "fn", "tn")]) for combo in range(1, 16)]
    out = M.rates(per.agg(*made).select(F.inline(F.array(*each))).where("tp + fp + fn + tn > 0"))
    return out.select("combo", "tp", "fp", "fn", "tn", F.round("f1", 6).alias("f1"))


def reward_spread(spark, sf):
    """Spread of each uid's round rewards: mean, deviation, variation, extremes."""
    r = M.exact_rewards(_graded(spark, sf), "uid", "round")
    g = r.groupBy("uid").agg(F.avg("reward").alias("mean"), F.stddev_pop("reward").alias("std"), F.min("reward").alias("low"), F.max("reward").alias("high"))
    return r6(g.withColumn("cv", F.when(F.abs("mean") > 1e-9, F.col("std") / F.when(F.abs("mean") > 1e-9, F.col("mean"))).otherwise(0.0)), "mean", "std", "low", "high", "cv")


def flip_counts(spark, sf):
    r = responses(spark, sf).where("score is not null")
    w = Window.partitionBy("uid").orderBy("event_id")
    p = r.withColumn("flag", F.col("score") >= 0.5).withColumn("before", F.lag("flag").over(w))
    return p.groupBy("uid").agg(F.count_if(F.col("flag") != F.col("before")).alias("flips"))


def quality_gates(spark, sf):
    """Pass or fail of each check over the graded responses."""
    g = _graded(spark, sf).where("valid")
    s = M.rates(g.agg(*M.confusion(F.col("flagged"), F.col("actual")), F.avg(F.when(~F.col("actual"), F.col("score"))).alias("mean_normal")))
    checks = F.array(*[F.struct(F.lit(n).alias("gate"), c.alias("passed")) for n, c in (("recall_at_least_half", F.col("recall") >= 0.5), ("mean_normal_at_most_.3", F.col("mean_normal") <= 0.3), ("accuracy_at_least_.5", F.col("accuracy") >= 0.5))])
    return s.select(F.inline(checks))


def mean_median_aggregation(spark, sf):
    """Mean and median of each sample's scores, and whether one extreme score flips them."""
    r = responses(spark, sf).where("score is not null").groupBy("sid").agg(F.avg("score").alias("mean"), F.median("score").alias("median"), F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))
    forced = (F.col("mean") * F.col("n") - F.col("top") + 1.0) / F.col("n")
    return r.select("sid", F.round(F.col("mean") + 1e-10, 6).alias("mean"), F.round(F.col("median") + 1e-10, 6).alias("median"), ((F.round("mean", 9) >= 0.5) != (F.round(forced, 9) >= 0.5)).alias("mean_flips"))


QUERIES = {f.__name__: f for f in (
    validate_responses, policy_decisions, request_gate, partition_honeypots, score_payload, confusion_by_domain, round_rewards, top_uids_by_reward,
    calibration_by_uid, stability_by_uid, hardened_rewards, composite_rewards, score_quality, reliability_bins, best_thresholds, global_threshold,
    kl_of_rounds, kl_by_round, multiband_grid, policy_overlays, score_surfaces, ensemble_combinations, reward_spread, flip_counts, quality_gates, mean_median_aggregation,
)}

_G = """g AS (SELECT r.*, m.truth = 'anomalous' AS actual, m.is_honeypot, score IS NOT NULL AND score BETWEEN 0 AND 1 AS valid,
              coalesce(score IS NOT NULL AND score BETWEEN 0 AND 1 AND score >= 0.5, false) AS flagged,
              CASE r.sid % 4 WHEN 0 THEN 'hallucination' WHEN 1 THEN 'code_security' WHEN 2 THEN 'reasoning' ELSE 'bio' END AS domain
       FROM responses r JOIN manifest m USING (sid))"""


def _g(sql):
    sql = sql.strip()
    return with_views(f"WITH {_G}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {_G} {sql}", "responses", "manifest")


_CONF = "count(*) FILTER (flagged AND actual) AS tp, count(*) FILTER (flagged AND NOT actual) AS fp, count(*) FILTER (NOT flagged AND actual) AS fn, count(*) FILTER (NOT flagged AND NOT actual) AS tn"
_P, _R = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END", "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END"
_REWARD = f"greatest(0, least(1, 0.7 * ({_P}) + 0.3 * ({_R})))::DOUBLE"


def _rewards(*keys):
    k = ", ".join(keys)
    return f"""rw AS (SELECT {k}, tp, fp, fn, failed, n, CASE WHEN failed THEN 0.0 ELSE {_REWARD} END AS reward FROM (
        SELECT {k}, count(*) FILTER (valid AND flagged AND actual) AS tp, count(*) FILTER (valid AND flagged AND NOT actual) AS fp,
               count(*) FILTER (valid AND NOT flagged AND actual) AS fn, bool_or(is_honeypot AND (NOT valid OR flagged <> actual)) AS failed, count(*) AS n
        FROM g GROUP BY {k}))"""


_BIN = " + ".join(f"CASE WHEN confidence >= CAST({e!r} AS DOUBLE) THEN 1 ELSE 0 END" for e in M.EDGES)
_ECE = f"""bins AS (SELECT uid, {_BIN} AS bin, count(*) AS n, avg(confidence) AS conf, avg(CASE WHEN flagged = actual THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc FROM g WHERE valid GROUP BY ALL),
    ece AS (SELECT uid, sum(n * abs(conf - acc)) / sum(n) AS ece FROM bins GROUP BY uid)"""
_MULTI = "CASE WHEN confidence < 0.6 THEN 'review' WHEN score >= 0.5 THEN 'block' WHEN score < 0.493536 THEN 'allow' ELSE 'review' END"
_SIMPLE = "CASE WHEN confidence < 0.6 THEN 'allow' WHEN score >= 0.5 THEN 'block' ELSE 'allow' END"


def _search(key):
    return _g(f"""
        WITH v AS (SELECT {key} AS k, score, actual FROM g WHERE valid), d AS (SELECT DISTINCT k, score FROM v),
        c AS (SELECT k, score AS t FROM d UNION SELECT k, (score + nxt) / 2 FROM (SELECT k, score, lead(score) OVER (PARTITION BY k ORDER BY score) AS nxt FROM d) WHERE nxt IS NOT NULL
              UNION SELECT DISTINCT k, 0.5::DOUBLE FROM v),
        n AS (SELECT c.k, t, count(*) FILTER (score >= t AND actual) AS tp, count(*) FILTER (score >= t AND NOT actual) AS fp, count(*) FILTER (score < t AND actual) AS fn FROM c JOIN v ON v.k = c.k GROUP BY c.k, t),
        s AS (SELECT *, round({_REWARD}, 9) AS reward FROM n),
        b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY reward DESC, t = 0.5 DESC, t) AS o FROM s)
        SELECT k AS {"domain" if key == "domain" else "scope"}, round(t, 6) AS threshold, tp, fp, fn, round(reward, 6) AS reward FROM b WHERE o = 1""")


SQL = {
    "validate_responses": """
        WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value / 200 END AS s, CASE event_type WHEN 'purchase' THEN 'normal' WHEN 'signup' THEN 'xss' END AS k FROM events)
        SELECT event_id, CASE WHEN s IS NULL THEN 'missing_anomaly_score' WHEN isnan(s) OR s < 0 OR s > 1 THEN 'anomaly_score_out_of_range' WHEN k = 'normal' THEN 'unknown_anomaly_type' ELSE 'valid' END AS status FROM e""",
    "policy_decisions": with_views(f"SELECT event_id, {_MULTI} AS multiband, {_SIMPLE} AS simple FROM responses WHERE score IS NOT NULL", "responses"),
    "request_gate": "SELECT conv_id, turn, CAST(CASE WHEN trim(coalesce(text, '')) = '' THEN 400 WHEN role NOT IN ('user', 'assistant') THEN 400 ELSE 200 END AS BIGINT) AS status FROM conversations",
    "partition_honeypots": with_views("SELECT doc_id, coalesce(is_honeypot, false) AS is_honeypot, coalesce(truth, 'normal') AS truth FROM documents LEFT JOIN manifest ON sid = doc_id", "manifest"),
    "score_payload": with_views("SELECT event_id, sid, truth, coalesce(score, -1.0) AS score FROM responses JOIN manifest USING (sid)", "responses", "manifest"),
    "confusion_by_domain": _g(f"""
        WITH c AS (SELECT domain, {_CONF}, round(avg(score), 6) AS mean_score FROM g WHERE valid GROUP BY domain), r AS (SELECT *, {_P} AS p, {_R} AS r FROM c)
        SELECT domain, tp, fp, fn, tn, mean_score, round(p::DOUBLE, 6) AS precision, round(r::DOUBLE, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END::DOUBLE, 6) AS f1,
               round(((tp + tn) / (tp + fp + fn + tn))::DOUBLE, 6) AS accuracy,
               round((CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (r + tn / (tn + fp)) / 2 WHEN tp + fn > 0 THEN r ELSE tn / (tn + fp) END)::DOUBLE, 6) AS balanced_accuracy FROM r"""),
    "round_rewards": _g(f"WITH {_rewards('round', 'uid')} SELECT round, uid, tp, fp, fn, failed, n, round(reward::DOUBLE, 6) AS reward FROM rw"),
    "top_uids_by_reward": _g(f"""WITH {_rewards('round', 'uid')}, o AS (SELECT round, uid, round(reward::DOUBLE, 6) AS reward FROM rw),
        p AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY reward DESC, uid) AS place FROM o) SELECT round, place, uid, reward FROM p WHERE place <= 5"""),
    "calibration_by_uid": _g(f"WITH {_ECE} SELECT uid, round(ece, 6) AS ece, round(1 - ece, 6) AS bonus FROM ece"),
    "stability_by_uid": with_views("SELECT uid, round, round(CASE WHEN count(*) < 2 THEN 1.0 ELSE greatest(0, 1 - stddev_pop(score)) END::DOUBLE, 6) AS stability FROM responses WHERE score IS NOT NULL GROUP BY uid, round", "responses"),
    "hardened_rewards": _g(f"""WITH {_rewards('uid', 'round')}, st AS (SELECT uid, round, CASE WHEN count(*) < 2 THEN 1.0 ELSE greatest(0, 1 - stddev_pop(score)) END::DOUBLE AS s FROM responses WHERE score IS NOT NULL GROUP BY uid, round)
        SELECT rw.uid, rw.round, round(CASE WHEN failed THEN 0 ELSE 0.85 * reward + 0.15 * coalesce(s, 1) END::DOUBLE + 1e-10, 6) AS reward FROM rw LEFT JOIN st ON st.uid = rw.uid AND st.round = rw.round"""),
    "composite_rewards": _g(f"""WITH {_rewards('uid')}, {_ECE}, st AS (SELECT uid, CASE WHEN count(*) < 2 THEN 1.0 ELSE greatest(0, 1 - stddev_pop(score)) END::DOUBLE AS s FROM g WHERE valid GROUP BY uid)
        SELECT rw.uid, round(CASE WHEN failed THEN 0 ELSE greatest(0, least(1, 0.7 * reward + 0.1 * coalesce(1 - ece, 1) + 0.1 * coalesce(s, 1) + 0.05)) END::DOUBLE, 6) AS reward FROM rw LEFT JOIN ece ON ece.uid = rw.uid LEFT JOIN st ON st.uid = rw.uid"""),
    "score_quality": _g("""
        WITH v AS (SELECT domain, score, actual, latency FROM g WHERE valid),
        b AS (SELECT domain, avg((score - actual::INT) * (score - actual::INT)) AS brier, coalesce(avg(score) FILTER (actual), 0) - coalesce(avg(score) FILTER (NOT actual), 0) AS separation, avg(latency) AS latency FROM v GROUP BY domain),
        rk AS (SELECT domain, actual, rank() OVER (PARTITION BY domain ORDER BY score) + (count(*) OVER (PARTITION BY domain, score) - 1) / 2 AS r FROM v),
        a AS (SELECT domain, sum(r) FILTER (actual) AS s, count(*) FILTER (actual) AS p, count(*) FILTER (NOT actual) AS q FROM rk GROUP BY domain),
        c AS (SELECT domain, score, count(*) AS n, count(*) FILTER (actual) AS pos FROM v GROUP BY ALL),
        t AS (SELECT domain, pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER (PARTITION BY domain) AS allp FROM c WINDOW w AS (PARTITION BY domain ORDER BY score DESC)),
        ap AS (SELECT domain, coalesce(sum(cp / cn * pos / allp), 0) AS ap FROM t GROUP BY domain)
        SELECT b.domain, round(brier::DOUBLE, 6) AS brier, round(separation::DOUBLE, 6) AS separation, round(latency, 6) AS latency,
               round(CASE WHEN p > 0 AND q > 0 THEN (s - p * (p + 1) / 2) / (p * q) ELSE 0.5 END::DOUBLE, 6) AS roc_auc, round(ap::DOUBLE, 6) AS average_precision FROM b JOIN a USING (domain) JOIN ap USING (domain)"""),
    "reliability_bins": _g("SELECT CAST(least(floor(score * 5), 4) AS BIGINT) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(actual::INT::DOUBLE), 6) AS share FROM g WHERE valid GROUP BY 1"),
    "best_thresholds": _search("domain"),
    "global_threshold": _search("'all'"),
    "kl_by_round": with_views("""
        WITH r AS (SELECT round, CAST(least(floor(score * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM responses WHERE score BETWEEN 0 AND 1 GROUP BY ALL),
        a AS (SELECT round, sum(n) AS every, lag(round) OVER (ORDER BY round) AS before FROM r GROUP BY round),
        p AS (SELECT a.round, before, i AS bin, coalesce(n, 0) / every + 1e-10 AS p FROM a CROSS JOIN range(20) t(i) LEFT JOIN r ON r.round = a.round AND r.bin = i)
        SELECT p.round, round(sum(p.p * ln(p.p / q.p)), 6) AS kl FROM p JOIN p q ON q.round = p.before AND q.bin = p.bin GROUP BY p.round""", "responses"),
    "kl_of_rounds": with_views("""
        WITH h AS (SELECT i AS bin, count(*) FILTER (round = 0) AS a, count(*) FILTER (round = 1) AS b FROM range(20) t(i) LEFT JOIN responses ON score IS NOT NULL AND least(floor(score * 20), 19) = i GROUP BY i),
        p AS (SELECT a / sum(a) OVER () + 1e-10 AS p, b / sum(b) OVER () + 1e-10 AS q FROM h) SELECT round(sum(p * ln(p / q)), 6) AS kl FROM p""", "responses"),
    "multiband_grid": _g(f"""
        WITH v AS (SELECT CAST(floor(score * 10) AS INT) AS s, CAST(floor(confidence * 10) AS INT) AS c, actual FROM g WHERE valid),
        grid AS (SELECT a.i::INT AS low, b.i::INT AS high, d.i::INT AS least FROM range(11) a(i), range(11) b(i), range(10) d(i) WHERE a.i < b.i),
        n AS (SELECT low, high, least, count(*) FILTER ((c < least OR s >= low) AND actual) AS tp, count(*) FILTER ((c < least OR s >= low) AND NOT actual) AS fp,
                     count(*) FILTER (NOT (c < least OR s >= low) AND actual) AS fn, 1 - count(*) FILTER (c < least OR (s < high AND s >= low)) / count(*) AS cov FROM v, grid GROUP BY ALL)
        SELECT low, high, least, round(({_REWARD} + 0.05 * cov)::DOUBLE, 6) AS objective FROM n"""),
    "policy_overlays": _g(f"""
        WITH p AS (SELECT domain, 'control' AS policy, ({_SIMPLE}) = 'block' AS f FROM g WHERE valid UNION ALL SELECT domain, 'multiband', ({_MULTI}) <> 'allow' FROM g WHERE valid UNION ALL SELECT domain, 'strict', score >= 0.3 FROM g WHERE valid),
        r AS (SELECT domain, policy, avg(f::INT::DOUBLE) AS rate FROM p GROUP BY ALL)
        SELECT domain, policy, round(rate, 6) AS rate, round(rate - max(rate) FILTER (policy = 'control') OVER (PARTITION BY domain), 6) AS delta FROM r"""),
    "score_surfaces": _g("""
        WITH w AS (SELECT * FROM (VALUES ('control_equal', 0.5::DOUBLE, false), ('w65', 0.65::DOUBLE, false), ('w80', 0.8::DOUBLE, false), ('modulated', 0.65::DOUBLE, true)) AS v(surface, w, m)),
        x AS (SELECT surface, score AS a, 1 - confidence AS b, CASE WHEN m THEN w * confidence ELSE w END AS wa, CASE WHEN m THEN (1 - w) * score ELSE 1 - w END AS wb, w, actual::INT AS y FROM g, w WHERE valid),
        s AS (SELECT surface, y, CASE WHEN wa + wb = 0 THEN w * a + (1 - w) * b ELSE (wa * a + wb * b) / (wa + wb) END AS s FROM x)
        SELECT surface, round(avg(s), 6) AS mean_score, round(avg((s - y) * (s - y)), 6) AS brier FROM s GROUP BY surface"""),
    "ensemble_combinations": _g("""
        WITH k AS (SELECT g.sid, g.actual, g.score, CASE e.event_type WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 4 ELSE 8 END AS bit FROM g JOIN events e USING (event_id) WHERE valid),
        m AS (SELECT i AS combo, sid, actual, round(avg(score), 9) >= 0.5 AS flagged FROM k, range(1, 16) t(i) WHERE i & bit <> 0 GROUP BY i, sid, actual),
        c AS (SELECT combo, count(*) FILTER (flagged AND actual) AS tp, count(*) FILTER (flagged AND NOT actual) AS fp, count(*) FILTER (NOT flagged AND actual) AS fn, count(*) FILTER (NOT flagged AND NOT actual) AS tn FROM m GROUP BY combo)
        SELECT combo, tp, fp, fn, tn, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END::DOUBLE, 6) AS f1 FROM c"""),
    "reward_spread": _g(f"""WITH {_rewards('uid', 'round')}, s AS (SELECT uid, avg(reward) AS mean, stddev_pop(reward) AS std, min(reward) AS low, max(reward) AS high FROM rw GROUP BY uid)
        SELECT uid, round(mean::DOUBLE, 6) AS mean, round(std::DOUBLE, 6) AS std, round(low::DOUBLE, 6) AS low, round(high::DOUBLE, 6) AS high, round(CASE WHEN abs(mean) > 1e-9 THEN std / mean ELSE 0 END::DOUBLE, 6) AS cv FROM s"""),
    "flip_counts": with_views("""WITH p AS (SELECT uid, score >= 0.5 AS f, lag(score >= 0.5) OVER (PARTITION BY uid ORDER BY event_id) AS b FROM responses WHERE score IS NOT NULL)
        SELECT uid, count(*) FILTER (f <> b) AS flips FROM p GROUP BY uid""", "responses"),
    "quality_gates": _g(f"""
        WITH c AS (SELECT {_CONF}, avg(score) FILTER (NOT actual) AS m FROM g WHERE valid)
        SELECT 'recall_at_least_half' AS gate, ({_R}) >= 0.5 AS passed FROM c UNION ALL SELECT 'mean_normal_at_most_.3', m <= 0.3 FROM c UNION ALL SELECT 'accuracy_at_least_.5', (tp + tn) / (tp + fp + fn + tn) >= 0.5 FROM c"""),
    "mean_median_aggregation": with_views("""
        WITH a AS (SELECT sid, avg(score) AS m, median(score) AS d, count(*) AS n, max(score) AS t FROM responses WHERE score IS NOT NULL GROUP BY sid)
        SELECT sid, round(m + 1e-10, 6) AS mean, round(d + 1e-10, 6) AS median, (round(m, 9) >= 0.5) <> (round((m * n - t + 1) / n, 9) >= 0.5) AS mean_flips FROM a""", "responses"),
}
