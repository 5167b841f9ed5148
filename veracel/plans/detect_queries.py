"""Queries of detectors, the gated pipeline, feature profiles and the audit log."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..operators import chain as C
from ..operators import detect as D
from ..operators import history as H
from ..sources.shared import materialize
from ..sources.tables import domain_of, manifest, read, responses, samples, with_views
from .metric_queries import _graded
from .network_queries import _rewards, r6


def _vectors(spark, sf):
    return read(spark, sf, "embeddings")


def _neighbours(spark, sf, k=5):
    """Every row divisible by 20 against all rows."""
    e = _vectors(spark, sf)
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return D.nearest(q, e.select(F.col("vec_id").alias("mid"), F.col("embedding").alias("m")), k)


def nearest_vectors(spark, sf):
    return r6(_neighbours(spark, sf), "distance").select("qid", "mid", "place", "distance")


def neighbour_prior(spark, sf):
    out = _vectors(spark, sf).select(F.col("vec_id").alias("mid"), (F.col("label") / 9).alias("outcome"))
    return D.neighbour_prior(_neighbours(spark, sf), out).select("qid", F.round("prior", 4).alias("prior"))


def negative_selection(spark, sf):
    """Scores of the vectors divisible by 20; the self radius is an estimate from their nearest distances among all vectors."""
    found = _neighbours(spark, sf, 1)
    r = D.self_radius(found)
    return found.select("qid", F.round(D.negative_selection(F.col("distance"), r / 2), 5).alias("score"))


def local_outliers(spark, sf):
    """Local outlier factor of the vectors divisible by 20, among all vectors."""
    e = _vectors(spark, sf)
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    found = D.neighbourhoods(q, e.select(F.col("vec_id").alias("mid"), F.col("embedding").alias("m")), 5)
    return D.local_outlier_factor(found).where("qid % 20 = 0").select("qid", F.round("lof", 4).alias("lof"))


def reconstruction_error(spark, sf):
    e = _vectors(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return D.reconstruction_error(e).select("id", F.round("error", 4).alias("error"))


def _profile_rows(spark, sf):
    f = text.with_features(samples(spark, sf), text.dendritic(F.col("output")), "id", "domain")
    return f.unpivot(["id", "domain"], list(text.DENDRITIC), "feature", "value").withColumn("value", F.round("value", 6))


def isolation_forest(spark, sf):
    f = text.with_features(samples(spark, sf), text.dendritic(F.col("output")), "id")
    return D.isolation_scores(f, text.DENDRITIC).select("id", F.round("score", 6).alias("score"))


def percentile_scores(spark, sf):
    """Text lengths scored against those of normal labelled documents."""
    d, m = read(spark, sf, "documents"), manifest(spark, sf).where("truth = 'normal'")
    v = d.select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("x"))
    return r6(D.percentile_score(v, v.join(m, v.id == m.sid).select("x"), "x"), "score")


def feature_profile(spark, sf):
    g = _profile_rows(spark, sf).groupBy("domain", "feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.percentile("value", 0.5).alias("p50"), F.countDistinct("value").alias("n_distinct"), (F.count_if(~F.col("value").isin(0.0, 1.0)) == 0).alias("is_binary"),
    )
    return r6(g.withColumn("is_constant", F.col("n_distinct") == 1), "mean", "std", "low", "high", "p50")


def feature_correlations(spark, sf):
    """Correlation of every pair of text-length features; null where one is constant."""
    names = ("n_chars", "n_words", "n_sentences", "n_upper")
    d = read(spark, sf, "documents").select(F.col("n_chars").cast("double").alias("n_chars"), F.size(text.tokens(F.col("text"))).cast("double").alias("n_words"), F.regexp_count("text", F.lit("[.!?]")).cast("double").alias("n_sentences"), F.regexp_count("text", F.lit("[A-Z]")).cast("double").alias("n_upper"))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = d.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    one = row.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    return one.select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), F.round(F.col("r"), 6).alias("r"), (F.abs("r") > 0.7).alias("redundant"))


def gated_pipeline(spark, sf):
    """z-gate on text lengths per domain, then signals, maturation, tier, score and danger modulation, in one plan."""
    s = samples(spark, sf)
    f = text.with_features(s, text.dendritic(F.col("output")), "id", "domain").join(s.select("id", F.length("output").cast("double").alias("size")), "id")
    stats = s.groupBy("domain").agg(F.avg(F.length("output")).alias("m"), F.stddev_pop(F.length("output")).alias("d"))  # a row a domain
    f = f.join(F.broadcast(stats), "domain")
    cols = {n: F.col(n) for n in text.DENDRITIC}
    sig = D.signals(cols)
    state = D.maturation(sig)
    gate = D.z_gate({"size": F.col("size")}, {"size": (F.col("m"), F.col("d"))})
    tier = F.when(state == "mature", "all").otherwise("ocsvm,negsel")
    raw = text.clip((sig["pamp"] + sig["danger"]) / 2)
    out = f.select("id", gate.alias("gate"), state.alias("state"), tier.alias("tier"), D.danger_modulation(raw, F.col("pamp_score"), F.col("danger_signal")).alias("scored"))
    return out.select("id", "state", "tier", F.col("gate").isNotNull().alias("gated"), F.round(F.coalesce("gate.score", "scored") + 1e-10, 6).alias("score"))


def tuning_grid(spark, sf):
    """F1 of every (z, alpha) setting of the gate and the modulation over labelled documents, in one plan."""
    d, m = read(spark, sf, "documents"), manifest(spark, sf)
    rows = d.join(m, d.doc_id == m.sid).select(F.col("n_chars").cast("double").alias("size"), (F.regexp_count("text", F.lit("[!|%#$&*]")) / F.greatest(F.length("text"), F.lit(1)) * 10).alias("danger"), (F.col("truth") == "anomalous").alias("actual"))
    w = Window.partitionBy(F.lit(0))
    st = rows.agg(F.avg("size").alias("m"), F.stddev_pop("size").alias("sd"))
    grid = spark.createDataFrame([(z, a) for z in (2.0, 3.0, 5.0, 8.0) for a in (0.0, 0.05, 0.1, 0.2, 0.3)], "z double, alpha double")
    met = rows.crossJoin(F.broadcast(st)).crossJoin(F.broadcast(grid))
    s = F.when((F.col("size") - F.col("m")) / F.col("sd") > F.col("z"), 1.0).otherwise(text.clip(F.col("danger") + (1 - text.clip(F.col("danger"))) * F.col("alpha")))
    from ..operators import metrics as M

    out = M.rates(met.groupBy("z", "alpha").agg(*M.confusion(s >= 0.5, F.col("actual"))))
    return out.select("z", "alpha", "tp", "fp", "fn", "tn", F.round("f1", 6).alias("f1"))


def best_configs(spark, sf):
    """The best setting of each z, the first in grid order on ties."""
    w = Window.partitionBy("z").orderBy(F.desc("f1"), "alpha")
    return tuning_grid(spark, sf).withColumn("k", F.row_number().over(w)).where("k = 1").select("z", "alpha", "f1")


def detector_ensemble(spark, sf):
    e = responses(spark, sf).where("score is not null").join(read(spark, sf, "events").select("event_id", "event_type"), "event_id")
    each = e.select("sid", F.col("event_id").alias("ord"), "score", "confidence", F.col("event_type").alias("type"))
    return r6(D.ensemble(each, "sid"), "score", "confidence")


def semantic_gate(spark, sf):
    """Similarity of each vector to its label's first one; under 0.3 it is scored 1 - similarity."""
    e = _vectors(spark, sf)
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    sim = F.round(text.clip(scalars.cosine(F.col("embedding"), F.col("anchor"))), 5)
    return e.join(F.broadcast(first), "label").select("vec_id", sim.alias("similarity"), F.when(sim < 0.3, 1 - sim).alias("score")).withColumn("score", F.round("score", 5))


def semantic_scorer(spark, sf):
    """Label by similarity under the domain's threshold, accuracy per label class of the vectors."""
    t = {0: 0.85, 1: 0.95, 2: 0.9, 3: 0.92}
    g = semantic_gate(spark, sf).join(_vectors(spark, sf).select("vec_id", "label"), "vec_id")
    thr = F.element_at(F.create_map(*[F.lit(x) for kv in t.items() for x in kv]), (F.col("label") % 4).cast("int"))
    return g.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("similarity") < thr).alias("anomalous"))


def syndromes(spark, sf):
    """Ternary signature of each uid's standardised event profile, its class and digest."""
    e = read(spark, sf, "events")
    kinds = ("click", "error", "purchase", "signup", "view")
    g = e.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).cast("double").alias(k) for k in kinds])
    st = g.agg(*[F.avg(k).alias(f"m_{k}") for k in kinds], *[F.stddev_pop(k).alias(f"s_{k}") for k in kinds])
    z = F.array(*[F.round((F.col(k) - F.col(f"m_{k}")) / F.col(f"s_{k}"), 9) for k in kinds], *[F.lit(0.0)] * 3)
    sig = F.array_join(scalars.ternary(z).cast("array<string>"), ",")
    return C.classified(g.crossJoin(F.broadcast(st)).select("user_id", sig.alias("signature")), "user_id")


def chain_replay(spark, sf):
    """Audit log of all rounds: hashes linked in order, EMA per uid."""
    return C.linked(C.entries(_rewards(spark, sf), "round"))


def chain_verify(spark, sf):
    rows = materialize(C.entries(_rewards(spark, sf), "round"), "entries")
    return C.verified(C.linked(rows), rows)


def log_digests(spark, sf):
    """SHA-256 of the sorted answers of each round, as canonical text."""
    line = F.concat_ws(":", F.col("uid").cast("string"), F.col("sid").cast("string"), F.col("event_id").cast("string"))
    return H.digests(responses(spark, sf).select("round", line.alias("line")), "round", "line")


def adaptive_weights(spark, sf):
    """Danger weights of each domain after folding its graded answers in order."""
    g = _graded(spark, sf).where("valid").withColumn("domain", domain_of(F.col("sid")))
    return C.adapted(g.select("domain", "event_id", F.array("score", "confidence", (1 - F.col("score"))).alias("x"), F.when(F.col("flagged") == F.col("actual"), 1.0).otherwise(-1.0).alias("outcome")))


def event_slopes(spark, sf):
    """Least-squares slope of value over time per event type."""
    e = read(spark, sf, "events").withColumn("d", F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01', ts)") / 86400)
    return e.groupBy("event_type").agg(F.round(F.regr_slope("value", "d"), 6).alias("slope"))


def staleness(spark, sf):
    """Seconds between each uid's last event and the last of all."""
    e = read(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("t"))
    last = e.agg(F.max("t").alias("now"))
    return e.crossJoin(F.broadcast(last)).select("user_id", F.expr("timestampdiff(SECOND, t, now)").alias("seconds"), (F.expr("timestampdiff(SECOND, t, now)") > 86400).alias("stale"))


def tumbling_windows(spark, sf):
    """Events and value per hour and type (the streaming rounds, in batch)."""
    e = read(spark, sf, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "total")


QUERIES = {f.__name__: f for f in (
    nearest_vectors, neighbour_prior, negative_selection, local_outliers, reconstruction_error, isolation_forest, percentile_scores, feature_profile,
    feature_correlations, gated_pipeline, tuning_grid, best_configs, detector_ensemble, semantic_gate, semantic_scorer, syndromes, chain_replay,
    chain_verify, log_digests, adaptive_weights, event_slopes, staleness, tumbling_windows,
)}

from .text_queries import SQL as _TEXT  # noqa: E402

_DIST = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2)))"
_NN = f"nn AS (SELECT qid, mid, place, distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, mid) AS place FROM (SELECT a.vec_id AS qid, b.vec_id AS mid, round({_DIST}, 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)) WHERE place <= 5)"
_DEN = _TEXT["dendritic_features"]
_SIM = "sim AS (SELECT vec_id, e.label, round(greatest(0, least(1, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(anchor, lambda x: x::DOUBLE)))), 5) AS similarity FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS anchor FROM embeddings GROUP BY label) f ON f.label = e.label)"
_GRID = """gr AS (SELECT z, a FROM (VALUES (2.0::DOUBLE), (3.0), (5.0), (8.0)) AS u(z), (VALUES (0.0::DOUBLE), (0.05), (0.1), (0.2), (0.3)) AS v(a)),
    rw AS (SELECT n_chars::DOUBLE AS size, len(regexp_extract_all(text, '[!|%#$&*]')) / greatest(length(text), 1) * 10 AS danger, truth = 'anomalous' AS actual FROM documents JOIN manifest ON sid = doc_id),
    st AS (SELECT avg(size) AS m, stddev_pop(size) AS sd FROM rw),
    f AS (SELECT z, a, actual, CASE WHEN (size - m) / sd > z THEN 1 ELSE greatest(0, least(1, danger + (1 - greatest(0, least(1, danger))) * a)) END >= 0.5 AS flagged FROM rw, st, gr),
    cf AS (SELECT z, a AS alpha, count(*) FILTER (flagged AND actual) AS tp, count(*) FILTER (flagged AND NOT actual) AS fp, count(*) FILTER (NOT flagged AND actual) AS fn, count(*) FILTER (NOT flagged AND NOT actual) AS tn FROM f GROUP BY ALL),
    sc AS (SELECT *, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END::DOUBLE, 6) AS f1 FROM cf)"""

SQL = {
    "nearest_vectors": f"WITH {_NN} SELECT qid, mid, place, round(distance + 1e-10, 6) AS distance FROM nn",
    "neighbour_prior": f"WITH {_NN} SELECT qid, round(sum(label / 9 / (distance + 1e-8)) / sum(1 / (distance + 1e-8)), 4) AS prior FROM nn JOIN embeddings ON vec_id = mid GROUP BY qid",
    "negative_selection": f"WITH {_NN}, o AS (SELECT * FROM nn WHERE place = 1), r AS (SELECT greatest(0.05, least(2.0, quantile_cont(distance, 0.95))) / 2 AS r FROM o) SELECT qid, round(greatest(0, least(1, (distance - r) / (2 * r))), 5) AS score FROM o, r",
    "percentile_scores": with_views("""
        WITH b AS (SELECT n_chars::DOUBLE AS x FROM documents JOIN manifest ON sid = doc_id WHERE truth = 'normal'), s AS (SELECT count(*) AS n, max(x) - min(x) AS rg, list_sort(list(x))[count(*) // 2 + 1] AS mid FROM b),
        v AS (SELECT doc_id AS id, n_chars::DOUBLE AS x, (SELECT count(*) FROM b WHERE b.x <= n_chars) AS idx FROM documents)
        SELECT id, round(CASE WHEN idx > 0 AND idx < n THEN 1 - idx / n WHEN rg < 1e-10 THEN 0.5 ELSE greatest(0, least(1, abs(x - mid) / rg)) END::DOUBLE + 1e-10, 6) AS score FROM v, s""", "manifest"),
    "feature_profile": f"""WITH d AS ({_DEN}), u AS (UNPIVOT d ON COLUMNS(* EXCLUDE id) INTO NAME feature VALUE value),
        k AS (SELECT CASE WHEN id >= 0 THEN CASE id % 4 WHEN 0 THEN 'hallucination' WHEN 1 THEN 'code_security' WHEN 2 THEN 'reasoning' ELSE 'bio' END ELSE CASE id WHEN -1 THEN 'bio' WHEN -2 THEN 'reasoning' WHEN -3 THEN 'bio' WHEN -4 THEN 'reasoning' ELSE 'hallucination' END END AS domain, feature, value FROM u)
        SELECT domain, feature, round(avg(value) + 1e-10, 6) AS mean, round(stddev_pop(value) + 1e-10, 6) AS std, round(min(value) + 1e-10, 6) AS low, round(max(value) + 1e-10, 6) AS high, round(quantile_cont(value, 0.5) + 1e-10, 6) AS p50,
               count(DISTINCT value) AS n_distinct, count(*) FILTER (value NOT IN (0, 1)) = 0 AS is_binary, count(DISTINCT value) = 1 AS is_constant FROM k GROUP BY ALL""",
    "feature_correlations": r"""
        WITH d AS (SELECT n_chars::DOUBLE AS n_chars, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::DOUBLE AS n_words, len(regexp_extract_all(text, '[.!?]'))::DOUBLE AS n_sentences, len(regexp_extract_all(text, '[A-Z]'))::DOUBLE AS n_upper FROM documents),
        c AS (SELECT 'n_chars' AS a, 'n_words' AS b, corr(n_chars, n_words) AS r FROM d UNION ALL SELECT 'n_chars', 'n_sentences', corr(n_chars, n_sentences) FROM d UNION ALL SELECT 'n_chars', 'n_upper', corr(n_chars, n_upper) FROM d
              UNION ALL SELECT 'n_words', 'n_sentences', corr(n_words, n_sentences) FROM d UNION ALL SELECT 'n_words', 'n_upper', corr(n_words, n_upper) FROM d UNION ALL SELECT 'n_sentences', 'n_upper', corr(n_sentences, n_upper) FROM d)
        SELECT a, b, round(r, 6) AS r, abs(r) > 0.7 AS redundant FROM c""",
    "gated_pipeline": f"""WITH d AS ({_DEN}), {with_views('x', 'samples')[5:-2]},
        z AS (SELECT s.id, length(output)::DOUBLE AS size, avg(length(output)) OVER (PARTITION BY domain) AS m, stddev_pop(length(output)) OVER (PARTITION BY domain) AS sd FROM samples s),
        g AS (SELECT d.*, coalesce(sd > 0 AND abs((size - m) / sd) > 3, false) AS gated, greatest(0, least(1, pamp_score)) AS p, greatest(0, least(1, (exaggeration + controversy + claim_density) / 3)) AS dn,
                     greatest(0, least(1, 0.2 * (citation_count + hedging_ratio + numeric_density + certainty + specificity))) AS sf FROM d JOIN z ON z.id = d.id),
        h AS (SELECT *, CASE WHEN p >= 0.3 THEN 'mature' WHEN sf > p + dn THEN 'immature' ELSE 'semi-mature' END AS state, greatest(0, least(1, (p + dn) / 2)) AS raw FROM g)
        SELECT id, state, CASE WHEN state = 'mature' THEN 'all' ELSE 'ocsvm,negsel' END AS tier, gated, round(CASE WHEN gated THEN 1 ELSE greatest(0, least(1, raw + (1 - raw) * greatest(pamp_score, danger_signal) * 0.3)) END::DOUBLE + 1e-10, 6) AS score FROM h""",
    "tuning_grid": with_views(f"WITH {_GRID} SELECT z, alpha, tp, fp, fn, tn, f1 FROM sc", "manifest"),
    "best_configs": with_views(f"WITH {_GRID} SELECT z, alpha, f1 FROM sc QUALIFY row_number() OVER (PARTITION BY z ORDER BY f1 DESC, alpha) = 1", "manifest"),
    "detector_ensemble": with_views("SELECT sid, round(avg(score) + 1e-10, 6) AS score, round(avg(confidence) + 1e-10, 6) AS confidence, arg_min(event_type, event_id) AS type FROM responses JOIN events USING (event_id) WHERE score IS NOT NULL GROUP BY sid", "responses"),
    "semantic_gate": f"WITH {_SIM} SELECT vec_id, similarity, CASE WHEN similarity < 0.3 THEN round(1 - similarity, 5) END AS score FROM sim",
    "semantic_scorer": f"WITH {_SIM} SELECT label, count(*) AS n, count(*) FILTER (similarity < [0.85, 0.95, 0.9, 0.92][label % 4 + 1]) AS anomalous FROM sim GROUP BY label",
    "syndromes": """
        WITH g AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'error') AS b, count(*) FILTER (event_type = 'purchase') AS c, count(*) FILTER (event_type = 'signup') AS d, count(*) FILTER (event_type = 'view') AS e FROM events GROUP BY user_id),
        z AS (SELECT user_id, [(a - avg(a) OVER ()) / stddev_pop(a) OVER (), (b - avg(b) OVER ()) / stddev_pop(b) OVER (), (c - avg(c) OVER ()) / stddev_pop(c) OVER (), (d - avg(d) OVER ()) / stddev_pop(d) OVER (), (e - avg(e) OVER ()) / stddev_pop(e) OVER (), 0, 0, 0] AS z FROM g),
        s AS (SELECT user_id, array_to_string(list_transform(z, lambda x: CASE WHEN round(x, 9) > 1 THEN 1 WHEN round(x, 9) < -1 THEN -1 ELSE 0 END), ',') AS signature FROM z)
        SELECT user_id, signature, CASE signature WHEN '0,0,0,0,0,0,0,0' THEN 'self' WHEN '1,1,1,1,1,1,1,1' THEN 'saturation_storm' WHEN '-1,-1,-1,-1,-1,-1,-1,-1' THEN 'total_collapse' WHEN '1,0,1,0,1,0,1,0' THEN 'alternating_spike' ELSE 'unclassified' END AS class,
               sha256('{"bucket_signature":[' || signature || '],"domain":"generic","schema_version":1}') AS digest FROM s""",
    "log_digests": with_views("SELECT round, sha256(string_agg(uid || ':' || sid || ':' || event_id, ',' ORDER BY uid || ':' || sid || ':' || event_id)) AS digest, count(*) AS n FROM responses GROUP BY round", "responses"),
    "event_slopes": "SELECT event_type, round(regr_slope(value, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) // 1000000 / 86400), 6) AS slope FROM events GROUP BY event_type",
    "staleness": "WITH e AS (SELECT user_id, max(ts) AS t FROM events GROUP BY user_id), n AS (SELECT max(t) AS now FROM e) SELECT user_id, (epoch_us(now) - epoch_us(t)) // 1000000 AS seconds, (epoch_us(now) - epoch_us(t)) // 1000000 > 86400 AS stale FROM e, n",
    "tumbling_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
}
