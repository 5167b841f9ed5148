"""Queries of rules over settings, samples with their manifest, and rewards under the rules of history."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import network as N
from ..operators import rounds as R
from ..operators import sample_rules, settings_rules
from ..sources.tables import domain_of, read, responses, stakes, with_views
from . import vector_queries as V
from .metric_queries import _ECE, _g, _graded, _rewards as _rw
from .network_queries import SQL as _NETWORK
from .network_queries import _trajectory, ema_scores, r6

# Scores that a uid needs for a diversity of its own, and uids that there must be.
MIN_HISTORY, MIN_UIDS = 10, 8


def uid_settings(spark, sf) -> DataFrame:
    """artifact, json: a settings document of each uid, its values from the uid's answers."""
    r = responses(spark, sf).groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("valid"), F.round(F.avg("score"), 6).alias("mean"))
    failed, twice = F.col("n") - F.col("valid"), F.round(F.col("mean") * 2, 6)
    device = F.when(F.col("n") % 3 == 0, "auto").when(F.col("n") % 3 == 1, "cuda").otherwise("tpu")
    s = lambda **parts: F.struct(*[c.alias(k) for k, c in parts.items()])
    layers = s(
        nk=s(z_threshold=F.round(F.col("mean") - 0.5, 6)), danger=s(enabled=F.col("n") % 2 == 0, alpha=twice), bcell=s(k=failed, max_memory=F.col("n")),
        domains=s(bio=s(danger_alpha=twice, memory=F.col("n"))),
    )
    rules = s(policy=s(mode=F.lit("global_threshold"), high_threshold=F.col("mean"), low_threshold=F.lit(0.5)), scoring=s(repeats=failed, ci_level=F.lit(0.95), seed=F.lit(7)))
    return r.select(F.concat(F.lit("uid-"), F.col("uid").cast("string")).alias("artifact"), F.to_json(s(miner=s(orchestrator=layers, model=s(device=device)), validator=rules)).alias("json"))


def settings_issues(spark, sf):
    """Everything wrong with the settings of each uid."""
    return settings_rules.issues(uid_settings(spark, sf))


def sample_issues(spark, sf):
    """Everything wrong with the texts as samples and the labels as their manifest: difficulty by length, source by language."""
    n = F.length("text")
    level = F.when(n < 500, "easy").when(n < 2000, "medium").when(n < 5000, "hard").otherwise("extreme")
    source = F.when(F.col("lang") == "en", "synthetic").when(F.col("lang") == "de", "template").when(F.col("lang") == "fr", "llm").otherwise(F.col("lang"))
    docs = read(spark, sf, "documents").where(n > 0)
    samples = docs.select(F.col("doc_id").alias("id"), F.lit("").alias("prompt"), F.col("text").alias("output"), domain_of(F.col("doc_id")).alias("domain"), F.when(n > 200, F.col("text")).alias("code"), F.struct(level.alias("difficulty"), source.alias("source")).alias("metadata"))
    truth = F.when(F.col("quality") == 1, "normal").when(F.col("quality") == 0, "anomalous")
    entries = read(spark, sf, "labels").select(F.col("doc_id").alias("id"), truth.alias("truth"), F.when(F.col("toxic") == 0, F.lit("plain")).alias("type"), (F.col("doc_id") % 11 == 0).alias("is_honeypot"))
    return sample_rules.sample_issues(samples, entries)


def history_rewards(spark, sf):
    """0.7 base, 0.1 calibration, 0.1 robustness and 0.1 diversity of the daily scores, which is neutral for a uid of fewer than ten days and among fewer than eight uids; 0 for a failed honeypot."""
    g = _graded(spark, sf)
    base = M.exact_rewards(g, "uid").select("uid", "reward", "failed")
    cal = M.calibration_error(g.where("valid"), F.col("confidence"), F.when(F.col("flagged") == F.col("actual"), 1.0).otherwise(0.0), "uid").select("uid", "bonus")
    st = M.stability(g.where("valid"), F.col("score"), "uid")
    days = _trajectory(spark, sf).select("uid", F.col("day").alias("pos"), F.col("score").alias("value"))
    div = N.diversity(days, min_history=MIN_HISTORY, min_uids=MIN_UIDS)
    total = M.clip(0.7 * F.col("reward") + 0.1 * F.coalesce("bonus", F.lit(1.0)) + 0.1 * F.coalesce("stability", F.lit(1.0)) + 0.1 * F.coalesce("diversity", F.lit(0.5)))
    met = base.join(cal, "uid", "left").join(st, "uid", "left").join(div, "uid", "left")
    return met.select("uid", F.round(F.when(F.col("failed"), 0.0).otherwise(total) + 1e-10, 6).alias("reward"))


def text_attributions(spark, sf):
    """The five heaviest terms (words or pairs) of each text in the vectors that the text detectors see, ties by term."""
    return R.keep_best(V.text_vectors(spark, sf), 5, "weight", "term", "id")


def trust_answers(spark, sf):
    """Per sample and round, the trust in the answers of the five uids with the highest EMA of rewards, the kinds they told and who they are."""
    kinds = responses(spark, sf).join(read(spark, sf, "events").select("event_id", F.col("event_type").alias("type")), "event_id")
    w = ema_scores(spark, sf).groupBy("uid").agg(F.max_by("ema", "round").alias("weight"))
    t = N.trust_answers(kinds.select("sid", "uid", "round", "score", "confidence", "type"), w, 5, "sid", "round")
    said = F.array_join(F.transform("answers", lambda a: a["uid"].cast("string")), ",")
    return r6(t.select("sid", "round", "score", "confidence", "n", F.array_join("types", ",").alias("types"), said.alias("uids")), "score", "confidence")


def call_statuses(spark, sf):
    """How the calls of each user are met: those with a stake may call three times a day."""
    calls = read(spark, sf, "events").select(F.col("user_id").alias("caller"), F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01', ts)").alias("t"))
    return N.call_statuses(calls, stakes(spark, sf).select(F.col("uid").alias("caller")), 3, 86400.0)


QUERIES = {f.__name__: f for f in (settings_issues, sample_issues, history_rewards, text_attributions, trust_answers, call_statuses)}

_r = lambda x, as_: f"round(({x})::DOUBLE + 1e-10, 6) AS {as_}"
_told = lambda level, section, key, message, bad: f"{{'level': '{level}', 'section': '{section}', 'key': '{key}', 'message': '{message}', 'bad': {bad}}}"
_LAYERS = "miner.orchestrator"

SQL = {
    "settings_issues": with_views(f"""
        WITH r AS (SELECT uid, count(*) AS n, count(*) - count(score) AS failed, round(avg(score), 6) AS m FROM responses GROUP BY uid),
        b AS (SELECT 'uid-' || uid AS artifact, unnest([
          {_told('error', f'{_LAYERS}.nk', 'z_threshold', 'must be number in [0,]', 'round(m - 0.5, 6) < 0')}, {_told('error', f'{_LAYERS}.danger', 'alpha', 'must be number in [0,1]', 'round(m * 2, 6) > 1')},
          {_told('warning', f'{_LAYERS}.danger', 'alpha', 'no effect while danger is not enabled', 'n % 2 <> 0 AND m > 0')}, {_told('error', f'{_LAYERS}.bcell', 'k', 'must be int in (0,]', 'failed = 0')},
          {_told('error', f'{_LAYERS}.domains.bio', 'danger_alpha', 'must be number in [0,1]', 'round(m * 2, 6) > 1')}, {_told('warning', f'{_LAYERS}.domains.bio', 'memory', 'unknown key', 'true')},
          {_told('error', 'miner.model', 'device', 'must be one of auto|cpu|cuda', 'n % 3 = 2')}, {_told('error', 'validator.policy', 'low_threshold', 'must be at most high_threshold', 'm < 0.5')},
          {_told('error', 'validator.scoring', 'repeats', 'must be int in (0,]', 'failed = 0')}, {_told('warning', 'validator.scoring', 'seed', 'unknown key', 'true')}]) AS x FROM r)
        SELECT artifact, x.level AS level, x.section AS section, x.key AS key, x.message AS message FROM b WHERE x.bad""", "responses"),
    "sample_issues": """
        WITH s AS (SELECT doc_id AS id, length(text) AS n, lang FROM documents WHERE length(text) > 0), b AS (
          SELECT coalesce(s.id, l.doc_id) AS id, unnest([
            CASE WHEN s.id % 4 = 1 AND n <= 200 THEN 'missing code' END, CASE WHEN l.doc_id IS NULL THEN 'not in manifest' END, CASE WHEN s.id IS NOT NULL AND l.doc_id IS NOT NULL AND quality IS NULL THEN 'missing truth' END,
            CASE WHEN s.id IS NOT NULL AND l.doc_id IS NOT NULL AND coalesce(toxic, 1) <> 0 THEN 'missing type' END, CASE WHEN n >= 5000 THEN 'invalid difficulty' END,
            CASE WHEN s.id IS NOT NULL AND lang IS NULL THEN 'missing source' END, CASE WHEN lang NOT IN ('en', 'de', 'fr', 'synthetic', 'template', 'llm') THEN 'invalid source' END, CASE WHEN s.id IS NULL THEN 'orphan' END]) AS issue
          FROM s FULL JOIN labels l ON l.doc_id = s.id)
        SELECT id, issue FROM b WHERE issue IS NOT NULL""",
    "history_rewards": _g(f"""WITH {_rw('uid').replace('rw AS', 'rb AS', 1)}, {_ECE}, sy AS (SELECT uid, CASE WHEN count(*) < 2 THEN 1.0 ELSE greatest(0, 1 - stddev_pop(score)) END::DOUBLE AS s FROM g WHERE valid GROUP BY uid),
        tr AS (SELECT uid, day, round(avg(score), 6) AS v FROM responses WHERE score IS NOT NULL GROUP BY ALL), el AS (SELECT * FROM tr QUALIFY count(*) OVER (PARTITION BY uid) >= {MIN_HISTORY}),
        c AS (SELECT a.uid AS a, CASE WHEN sum(a.v * a.v) * sum(b.v * b.v) > 0 THEN sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)) ELSE 0 END AS c FROM el a JOIN el b ON a.day = b.day AND a.uid <> b.uid GROUP BY a.uid, b.uid),
        t AS (SELECT a AS uid, max(c) AS top FROM c GROUP BY a), n AS (SELECT uid, sum(v * v) AS norm FROM tr GROUP BY uid), p AS (SELECT count(*) AS population FROM n),
        dv AS (SELECT n.uid, CASE WHEN top IS NULL OR norm = 0 OR population < {MIN_UIDS} THEN 0.5 ELSE greatest(0, least(1, 1 - greatest(0, top))) END AS d FROM p, n LEFT JOIN t ON t.uid = n.uid)
        SELECT rb.uid, {_r('CASE WHEN failed THEN 0 ELSE greatest(0, least(1, 0.7 * rb.reward + 0.1 * coalesce(1 - ece, 1) + 0.1 * coalesce(s, 1) + 0.1 * coalesce(d, 0.5))) END', 'reward')}
        FROM rb LEFT JOIN ece ON ece.uid = rb.uid LEFT JOIN sy ON sy.uid = rb.uid LEFT JOIN dv ON dv.uid = rb.uid"""),
    "text_attributions": f"SELECT id, term, weight FROM ({V.SQL['text_vectors']}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) <= 5",
    "trust_answers": f"""
        WITH e AS ({_NETWORK['ema_scores']}), w AS (SELECT uid, arg_max(ema, round) AS weight FROM e GROUP BY uid), r AS ({with_views('SELECT * FROM responses', 'responses')}),
        p AS (SELECT r.*, event_type, weight, row_number() OVER (PARTITION BY sid, round ORDER BY weight DESC, r.uid) AS k FROM r JOIN w ON w.uid = r.uid JOIN events v ON v.event_id = r.event_id),
        g AS (SELECT sid, round, count(score) AS n, sum(weight) FILTER (score IS NOT NULL) AS sw, sum(weight * score) AS ws, sum(weight * coalesce(confidence, 0.5)) FILTER (score IS NOT NULL) AS wc, avg(score) AS ms,
              avg(coalesce(confidence, 0.5)) FILTER (score IS NOT NULL) AS mc, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (score IS NOT NULL), '') AS types,
              coalesce(string_agg(uid::VARCHAR, ',' ORDER BY k) FILTER (score IS NOT NULL), '') AS uids FROM p WHERE k <= 5 GROUP BY ALL)
        SELECT sid, round, {_r('CASE WHEN n = 0 THEN 0.5 WHEN sw > 0 THEN ws / sw ELSE ms END', 'score')}, {_r('CASE WHEN n = 0 THEN 0 WHEN sw > 0 THEN wc / sw ELSE mc END', 'confidence')}, n, types, uids FROM g""",
}
