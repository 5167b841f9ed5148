"""The detector pipeline as the domains use it: settings, z-gate, packs, tiers, memory, tuning, gates and surfaces."""

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import detect as D
from ..operators import metrics as M
from ..sources.shared import materialize
from ..sources.tables import DOMAINS, manifest, read, samples, values, with_views
from .metric_queries import _g, _graded
from .network_queries import r6

# Settings of the pipeline and of the domains that differ (null: as for all).
SETTINGS = {"z_threshold": 3.0, "pamp_threshold": 0.3, "danger_alpha": 0.3, "memory_weight": 0.2}
OVERRIDES = (("hallucination", None, None, 0.1), ("code_security", 5.0, None, None), ("reasoning", 2.0, 0.2, None), ("bio", None, 0.5, 0.0))
Z_THRESHOLDS, PAMP_THRESHOLDS, ALPHAS = (2.0, 3.0, 5.0, 8.0), (0.1, 0.3, 0.5, 0.7), (0.0, 0.05, 0.1, 0.2, 0.3)
SURFACES = (
    ("control_equal", 0.5, False), ("weighted_ocsvm_0.20_negsel_0.80", 0.2, False), ("weighted_ocsvm_0.35_negsel_0.65", 0.35, False),
    ("weighted_ocsvm_0.50_negsel_0.50", 0.5, False), ("weighted_ocsvm_0.65_negsel_0.35", 0.65, False), ("weighted_ocsvm_0.80_negsel_0.20", 0.8, False),
    ("confidence_modulated_static", 0.65, True),
)
#: The gate leaves out the feature that repeats another.
GATED = tuple(c for c in text.DENDRITIC if c != "danger_signal")


def domain_settings(spark, sf):
    """Each domain's settings: its own where given, else those of all; and how many samples they govern."""
    own = values(spark, OVERRIDES, "domain string, z double, pamp double, alpha double")
    n = samples(spark, sf).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    pick = lambda c, name: F.coalesce(F.col(c), F.lit(SETTINGS[name])).alias(name)
    return n.join(F.broadcast(own), "domain", "left").select("domain", "n", pick("z", "z_threshold"), pick("pamp", "pamp_threshold"), pick("alpha", "danger_alpha"))


def _features(spark, sf) -> DataFrame:
    s = samples(spark, sf)
    made = text.dendritic(F.col("output"))
    return s.select("id", "domain", *[F.round(v, 6).alias(k) for k, v in made.items()])


def _stats(f: DataFrame) -> DataFrame:
    """domain, feature, mean, std, is_binary, is_constant: a row per domain and feature."""
    u = f.unpivot(["id", "domain"], list(text.DENDRITIC), "feature", "value")
    return u.groupBy("domain", "feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), (F.count_if(~F.col("value").isin(0.0, 1.0)) == 0).alias("is_binary"), (F.min("value") == F.max("value")).alias("is_constant"),
    )


def _with_z(f: DataFrame) -> DataFrame:
    """f with z, the features that the gate looks at, in order, with their |z|."""
    st = _stats(f).where(~F.col("is_binary") & ~F.col("is_constant") & F.col("feature").isin(*GATED))
    wide = st.groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("st"))
    met = f.join(F.broadcast(wide), "domain", "left")
    each = [F.struct(F.lit(c).alias("feature"), F.round(F.abs(F.col(c) - F.col("st")[c]["mean"]) / F.col("st")[c]["std"], 9).alias("z")) for c in GATED]
    return met.withColumn("z", F.filter(F.array(*each), lambda x: x["z"].isNotNull())).drop("st")


def _first_over(threshold):
    return F.try_element_at(F.filter("z", lambda x: x["z"] > threshold), F.lit(1))


def feature_gate(spark, sf):
    """The first of the features in order whose |z| in its domain is over the domain's threshold, and the gate's confidence."""
    f = _with_z(_features(spark, sf)).join(F.broadcast(domain_settings(spark, sf)), "domain").withColumn("hit", _first_over(F.col("z_threshold")))
    return f.where("hit is not null").select("id", "domain", "hit.feature", F.round(F.least(F.lit(1.0), F.col("hit.z") / (2 * F.col("z_threshold"))) + 1e-10, 6).alias("confidence"))


def _normal(f: DataFrame, spark, sf) -> DataFrame:
    return f.join(manifest(spark, sf).where("truth = 'normal'").select(F.col("sid").alias("id")), "id", "left_semi")


def _ranked(f: DataFrame, columns, spark, sf) -> DataFrame:
    """id, score, confidence: an isolation forest fitted on normal labelled rows, scores by their place among those rows' scores."""
    own = _normal(f, spark, sf)
    forest = D.fit_forest(own, columns)
    raw = lambda df: D.forest_scores(df, columns, forest).select("id", F.round(-F.col("score"), 9).alias("raw"))
    every = materialize(raw(f), "raw-scores")
    scored = D.percentile_score(every, every.join(own.select("id"), "id", "left_semi").select("raw"), "raw")
    return scored.withColumn("confidence", F.least(F.lit(1.0), F.abs(F.col("score") - 0.5) * 2))


PACKS = {
    "hallucination": ("claim_density", "citation_count", "citation_pattern_score", "hedging_ratio", "numeric_claim_density", "avg_sentence_length", "text_length"),
    "code_security": text.CODE_FEATURES,
    "reasoning": ("connective_density", "negation_count", "premise_conclusion_ratio", "total_length", "step_count", "contradiction_score", "avg_step_length"),
    "bio": ("numeric_value_count", "z_score_outlier_count", "negative_value_count", "unit_mention_count", "value_magnitude_range", "statistical_summary_count", "out_of_range_count"),
}


def pack_features(s: DataFrame, domain: str) -> DataFrame:
    """id and the domain's seven features of its samples."""
    own = s.where(F.col("domain") == domain)
    if domain == "code_security":
        code = text.code_from(F.lit(None).cast("string"), F.col("output"))
        return own.select("id", code.alias("code")).select("id", text.code_security("code").alias("r")).select("id", "r.*")
    if domain == "reasoning":
        made = text.with_features(own, text.reasoning(F.col("prompt"), F.col("output")) | {"r": text.reasoning_steps(text.pair_text(F.col("prompt"), F.col("output")))}, "id")
        return made.select("id", *PACKS[domain][:4], "r.*")
    return text.with_features(own, getattr(text, domain)(F.col("prompt"), F.col("output")), "id")


def pack_scores(spark, sf):
    """Every sample scored by its domain's pack: an isolation forest over the domain's features, fitted on its normal labelled samples."""
    s, parts = materialize(samples(spark, sf), "samples"), []
    for domain in DOMAINS:
        f = materialize(pack_features(s, domain), f"pack-{domain}")
        parts.append(_ranked(f, PACKS[domain], spark, sf).withColumn("domain", F.lit(domain)))
    every = functools.reduce(DataFrame.unionByName, parts)
    return every.select("id", "domain", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), (F.col("score") >= 0.5).alias("flagged"))


def fractal_scores(spark, sf):
    """Every sample scored by an isolation forest over the fractal vector, fitted on normal labelled samples."""
    f = samples(spark, sf).select("id", text.fractal("output").alias("r")).select("id", "r.*")
    got = _ranked(materialize(f, "fractal"), text.FRACTAL, spark, sf)
    return got.select("id", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


def _detectors(f: DataFrame, spark, sf) -> DataFrame:
    """f with the scores of three detectors: iforest and negsel over its ten features, and the domain's pack."""
    forest = _ranked(f, text.DENDRITIC, spark, sf).select("id", F.round("score", 6).alias("iforest"))
    near, radius = D.self_distance(f, text.DENDRITIC, _normal(f, spark, sf))
    negsel = near.select("id", F.round(D.negative_selection(F.col("distance"), radius), 6).alias("negsel"))
    pack = pack_scores(spark, sf).select("id", F.col("score").alias("pack"))
    return f.join(forest, "id").join(negsel, "id").join(pack, "id")


def _mean_of(names: tuple[str, ...]):
    return sum((F.col(n) for n in names), F.lit(0.0)) / len(names)


def scored_features(spark, sf):
    """Features, gate distances and detector scores of every sample, written once for the queries that combine them."""
    f = materialize(_features(spark, sf), "dendritic")
    return materialize(_with_z(_detectors(f, spark, sf)), "scored-features")


def _combined(rows: DataFrame, z, pamp, alpha) -> DataFrame:
    """state, tier and score of scored features under a setting.  Detectors are matched with a tier by name; a tier that matches none runs all."""
    sig = D.signals({n: F.col(n) for n in text.DENDRITIC})
    state = D.maturation(sig, pamp)
    all_of = ("iforest", "negsel", "pack")
    two = tuple(n for n in all_of if any(key in n for key in D.TIERS["immature"])) or all_of
    tier = F.when(state == "mature", ",".join(all_of)).otherwise(",".join(two))
    flat = F.when(state == "mature", _mean_of(all_of)).otherwise(_mean_of(two))
    modulated = text.clip(flat + (1 - flat) * F.greatest("pamp_score", "danger_signal") * alpha)
    return rows.withColumns({"state": state, "tier": tier, "gated": _first_over(z).isNotNull(), "ensemble": _mean_of(all_of), "modulated": modulated})


def tiered_pipeline(spark, sf):
    """Gate, state, tier and score of every sample under its domain's settings; a score that no gate has set meets the
    mean outcome that its state had among labelled samples of its domain (memory)."""
    rows = scored_features(spark, sf).join(F.broadcast(domain_settings(spark, sf)), "domain")
    got = materialize(_combined(rows, F.col("z_threshold"), F.col("pamp_threshold"), F.col("danger_alpha")), "pipeline")
    known = got.join(manifest(spark, sf), got.id == F.col("sid")).groupBy("domain", "state").agg(F.avg((F.col("truth") == "anomalous").cast("double")).alias("prior"))  # a row a domain and state
    w = SETTINGS["memory_weight"]
    score = F.when(F.col("gated"), 1.0).otherwise(F.coalesce((1 - w) * F.col("modulated") + w * F.col("prior"), F.col("modulated")))
    out = got.join(F.broadcast(known), ["domain", "state"], "left")
    return out.select("id", "domain", "state", "tier", "gated", F.round("ensemble", 6).alias("ensemble"), F.round("modulated", 6).alias("modulated"), F.round(score, 6).alias("score"))


def tuning_sweep(spark, sf):
    """Counts and F1 of all 80 settings of (z, pamp, alpha) over labelled samples.

    Samples are first counted per outcome under the settings (how many z and pamp thresholds they pass, which alphas
    flag them in either tier), so settings meet counts and not samples."""
    rows = scored_features(spark, sf).join(manifest(spark, sf).select(F.col("sid").alias("id"), (F.col("truth") == "anomalous").alias("actual")), "id")
    sig = D.signals({n: F.col(n) for n in text.DENDRITIC})
    top = F.coalesce(F.array_max(F.transform("z", lambda x: x["z"])), F.lit(0.0))
    passed = lambda c, ts, over: sum((over(c, t).cast("int") for t in ts), F.lit(0))
    danger = F.greatest("pamp_score", "danger_signal")
    mask = lambda s: sum((F.when(F.round(text.clip(s + (1 - s) * danger * a), 9) >= 0.5, 1 << k).otherwise(0) for k, a in enumerate(ALPHAS)), F.lit(0))
    cells = rows.groupBy(
        passed(top, Z_THRESHOLDS, lambda c, t: c > t).alias("nz"), passed(sig["pamp"], PAMP_THRESHOLDS, lambda c, t: c >= t).alias("np"),
        mask(F.col("negsel")).alias("two"), mask(_mean_of(("iforest", "negsel", "pack"))).alias("all"), "actual",
    ).count()
    grid = [(i, z, j, p, k, a) for i, z in enumerate(Z_THRESHOLDS) for j, p in enumerate(PAMP_THRESHOLDS) for k, a in enumerate(ALPHAS)]
    met = F.broadcast(values(spark, grid, "i int, z double, j int, pamp double, k int, alpha double")).crossJoin(cells)  # 80 settings, at most some thousand cells
    bits = F.when(F.col("np") > F.col("j"), F.col("all")).otherwise(F.col("two"))
    flagged = (F.col("nz") > F.col("i")) | (F.call_function("shiftright", bits, F.col("k")).bitwiseAND(1) == 1)
    n = lambda c: F.sum(F.when(c, F.col("count")).otherwise(0))
    out = met.groupBy("z", "pamp", "alpha").agg(
        n(flagged & F.col("actual")).alias("tp"), n(flagged & ~F.col("actual")).alias("fp"), n(~flagged & F.col("actual")).alias("fn"), n(~flagged & ~F.col("actual")).alias("tn")
    )
    return M.rates(out).select("z", "pamp", "alpha", "tp", "fp", "fn", "tn", F.round("f1", 6).alias("f1"))


def regression_gates(spark, sf):
    """All 24 checks of the pipeline against the flat ensemble and of the pipeline with memory against the one without."""
    p = tiered_pipeline(spark, sf).join(manifest(spark, sf).select(F.col("sid").alias("id"), (F.col("truth") == "anomalous").alias("actual")), "id")
    rows = materialize(p.select("domain", "actual", F.col("ensemble").alias("flat"), F.when(F.col("gated"), 1.0).otherwise(F.col("modulated")).alias("v8"), F.col("score").alias("v9")), "graded-pipeline")
    m = rows.select("domain").distinct()
    for v in ("flat", "v8", "v9"):
        hit = F.col(v) >= 0.5
        g = rows.groupBy("domain").agg(*M.confusion(hit, F.col("actual")), F.coalesce(F.avg(F.when(~F.col("actual"), F.col(v))), F.lit(0.0)).alias("normal"), F.coalesce(F.avg(F.when(F.col("actual"), F.col(v))), F.lit(0.0)).alias("anomalous"))
        m = m.join(M.rates(g).select("domain", F.round("f1", 4).alias(f"{v}_f1"), F.round("normal", 4).alias(f"{v}_normal"), F.round("anomalous", 4).alias(f"{v}_anomalous")), "domain")
    bins = rows.select("domain", F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.least(F.floor(F.col(v) * 20), F.lit(19)).alias("bin")) for k, v in ((0, "flat"), (1, "v8"))])).alias("b")).select("domain", "b.*")
    counts = bins.groupBy("domain", "bin").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    sums = counts.groupBy("domain").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    a, b = F.col("a") / F.col("na") + 1e-10, F.col("b") / F.col("nb") + 1e-10
    kl = counts.join(sums, "domain").groupBy("domain").agg(F.round(F.sum(a * F.log(a / b)), 4).alias("kl"))
    row = m.join(kl, "domain")
    check = lambda name, actual, ok: F.struct(F.concat(F.col("domain"), F.lit(f" {name}")).alias("gate"), F.round(actual, 4).alias("actual"), ok.alias("passed"))
    c = F.col
    gates = F.array(
        check("F1 against the flat ensemble", c("v8_f1") - c("flat_f1"), F.round(c("flat_f1") - c("v8_f1"), 4) <= 0.02),
        check("KL divergence", c("kl"), c("kl") < 0.5), check("mean of normal samples", c("v8_normal"), c("v8_normal").between(0.0, 0.3)),
        check("mean of anomalous samples against the flat ensemble", c("v8_anomalous") - c("flat_anomalous"), F.round(c("flat_anomalous") - c("v8_anomalous"), 4) <= 0.02),
        check("F1 with memory against without", c("v9_f1") - c("v8_f1"), F.round(c("v8_f1") - c("v9_f1"), 4) <= 0.02),
        check("mean of normal samples with memory", c("v9_normal"), c("v9_normal").between(0.0, 0.3)),
    )
    return row.select("domain", F.inline(gates))


def weighted_surfaces(spark, sf):
    """All seven fixed weightings of two detectors' scores, with mean score and Brier score against the labels.

    A surface is a sum over its samples, so each is one aggregate of one pass and samples are not multiplied."""
    g = _graded(spark, sf).where("valid").select(F.col("score").alias("a"), F.col("confidence").alias("ca"), (1 - F.col("confidence")).alias("b"), F.col("score").alias("cb"), F.col("actual").cast("double").alias("y"))
    made = []
    for i, (_, w, by_confidence) in enumerate(SURFACES):
        wa, wb = (w * F.col("ca"), (1 - w) * F.col("cb")) if by_confidence else (F.lit(w), F.lit(1 - w))
        fixed = w * F.col("a") + (1 - w) * F.col("b")
        s = F.when(wa + wb == 0, fixed).otherwise((wa * F.col("a") + wb * F.col("b")) / F.nullif(wa + wb, F.lit(0.0)))
        made += [F.avg(s).alias(f"m{i}"), F.avg((s - F.col("y")) * (s - F.col("y"))).alias(f"b{i}")]
    row = g.agg(*made)
    each = F.array(*[F.struct(F.lit(name).alias("surface"), F.round(f"m{i}", 6).alias("mean_score"), F.round(f"b{i}", 6).alias("brier")) for i, (name, *_) in enumerate(SURFACES)])
    return row.select(F.inline(each))


def feature_percentiles(spark, sf):
    u = _features(spark, sf).unpivot(["id", "domain"], list(text.DENDRITIC), "feature", "value")
    return r6(u.groupBy("domain", "feature").agg(*[F.percentile("value", p / 100).alias(f"p{p}") for p in (5, 25, 50, 75, 95)]), *[f"p{p}" for p in (5, 25, 50, 75, 95)])


def feature_matrix(spark, sf):
    """Pearson's r of every pair of the ten features, both ways and with themselves; null where one is constant."""
    f, names = _features(spark, sf), text.DENDRITIC
    r = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    row = f.agg(*[r(a, b).alias(f"{a}|{b}") for i, a in enumerate(names) for b in names[i:]], *[(F.min(c) == F.max(c)).alias(f"flat|{c}") for c in names])
    one = lambda i, j: f"{names[min(i, j)]}|{names[max(i, j)]}"
    each = [
        F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.when(~F.col(f"`flat|{names[i]}`") & ~F.col(f"`flat|{names[j]}`"), F.round(F.col(f"`{one(i, j)}`"), 5)).alias("r"), F.lit(i < j).alias("upper"))
        for i in range(len(names)) for j in range(len(names))
    ]
    return row.select(F.inline(F.array(*each))).select("a", "b", F.col("r") + F.lit(0.0), F.coalesce(F.col("upper") & (F.abs("r") > 0.7), F.lit(False)).alias("redundant")).toDF("a", "b", "r", "redundant")


def audit_stats(spark, sf):
    """Feature statistics as the JSON of an audit file, read back as rows: what a gate is built from."""
    st = _stats(_features(spark, sf))
    stat = F.struct(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "is_binary", "is_constant")
    files = st.groupBy("domain").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("feature", stat)))).alias("json"))  # ten entries a domain
    kind = "map<string,struct<mean:double,std:double,is_binary:boolean,is_constant:boolean>>"
    return files.select("domain", F.explode(F.from_json("json", kind)).alias("feature", "s")).select("domain", "feature", "s.*")


def margin_scores(spark, sf):
    """Text lengths on the range of the normal labelled ones, a tenth wider on both sides, with confidences."""
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("x"))
    own = _normal(d, spark, sf).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    margin = (F.col("hi") - F.col("lo")) * 0.1
    low, high = F.col("lo") - margin, F.col("hi") + margin
    s = text.clip((F.col("x") - low) / F.when(high <= low, 1.0).otherwise(high - low))
    return r6(d.crossJoin(F.broadcast(own)).select("id", s.alias("score")).withColumn("confidence", F.least(F.lit(1.0), F.abs(F.col("score") - 0.5) * 2)), "score", "confidence")


def code_of_samples(spark, sf):
    """The code of each turn: its own where it has one (here, what a user says), else its output, else nothing."""
    c = read(spark, sf, "conversations")
    code = text.code_from(F.when(F.col("role") == "user", F.col("text")), F.col("text"))
    return c.select("conv_id", "turn", F.length(code).cast("long").alias("n_chars"), F.sha2(code, 256).alias("sha256"))


QUERIES = {f.__name__: f for f in (
    domain_settings, feature_gate, pack_scores, fractal_scores, tiered_pipeline, tuning_sweep, regression_gates, weighted_surfaces, feature_percentiles,
    feature_matrix, audit_stats, margin_scores, code_of_samples,
)}

from .text_queries import SQL as _TEXT  # noqa: E402

_DOMAIN = "CASE WHEN id >= 0 THEN CASE id % 4 WHEN 0 THEN 'hallucination' WHEN 1 THEN 'code_security' WHEN 2 THEN 'reasoning' ELSE 'bio' END ELSE CASE id WHEN -1 THEN 'bio' WHEN -2 THEN 'reasoning' WHEN -3 THEN 'bio' WHEN -4 THEN 'reasoning' ELSE 'hallucination' END END"
_SET = "own AS (SELECT * FROM (VALUES ('hallucination', NULL::DOUBLE, NULL::DOUBLE, 0.1::DOUBLE), ('code_security', 5.0, NULL, NULL), ('reasoning', 2.0, 0.2, NULL), ('bio', NULL, 0.5, 0.0)) AS v(domain, z, pamp, alpha))"
_LONG = f"d AS ({_TEXT['dendritic_features']}), u AS (SELECT id, {_DOMAIN} AS domain, feature, value FROM (UNPIVOT d ON COLUMNS(* EXCLUDE id) INTO NAME feature VALUE value))"
_ST = "st AS (SELECT domain, feature, avg(value) AS mean, stddev_pop(value) AS std, count(*) FILTER (value NOT IN (0, 1)) = 0 AS is_binary, min(value) = max(value) AS is_constant FROM u GROUP BY ALL)"
_ORDER = "CASE feature " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(text.DENDRITIC)) + " END"
_SURF = "(VALUES " + ", ".join(f"('{n}', {w}::DOUBLE, {str(m).lower()})" for n, w, m in SURFACES) + ") AS v(surface, w, m)"

SQL = {
    "domain_settings": with_views(f"WITH {_SET} SELECT s.domain, count(*) AS n, coalesce(any_value(z), 3.0) AS z_threshold, coalesce(any_value(pamp), 0.3) AS pamp_threshold, coalesce(any_value(alpha), 0.3) AS danger_alpha FROM samples s LEFT JOIN own ON own.domain = s.domain GROUP BY s.domain", "samples"),
    "feature_gate": f"""WITH {_LONG}, {_ST}, {_SET},
        z AS (SELECT u.id, u.domain, u.feature, round(abs(u.value - mean) / std, 9) AS z, coalesce(own.z, 3.0) AS t FROM u JOIN st ON st.domain = u.domain AND st.feature = u.feature JOIN own ON own.domain = u.domain
              WHERE NOT is_binary AND NOT is_constant AND u.feature <> 'danger_signal')
        SELECT id, domain, feature, round(least(1.0, z / (2 * t)) + 1e-10, 6) AS confidence FROM z WHERE z > t QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_ORDER}) = 1""",
    "weighted_surfaces": _g(f"""
        WITH w AS (SELECT * FROM {_SURF}),
        x AS (SELECT surface, score AS a, 1 - confidence AS b, CASE WHEN m THEN w * confidence ELSE w END AS wa, CASE WHEN m THEN (1 - w) * score ELSE 1 - w END AS wb, w, actual::INT AS y FROM g, w WHERE valid),
        s AS (SELECT surface, y, CASE WHEN wa + wb = 0 THEN w * a + (1 - w) * b ELSE (wa * a + wb * b) / (wa + wb) END AS s FROM x)
        SELECT surface, round(avg(s), 6) AS mean_score, round(avg((s - y) * (s - y)), 6) AS brier FROM s GROUP BY surface"""),
    "feature_percentiles": f"WITH {_LONG} SELECT domain, feature, " + ", ".join(f"round(quantile_cont(value, {p / 100}) + 1e-10, 6) AS p{p}" for p in (5, 25, 50, 75, 95)) + " FROM u GROUP BY ALL",
    "feature_matrix": f"""WITH {_LONG}, c AS (SELECT feature, min(value) = max(value) AS flat FROM u GROUP BY feature),
        p AS (SELECT a.feature AS a, b.feature AS b, corr(a.value, b.value) AS r FROM u a JOIN u b ON a.id = b.id GROUP BY ALL),
        q AS (SELECT p.a, p.b, CASE WHEN NOT x.flat AND NOT y.flat THEN round(r, 5) + 0.0::DOUBLE END AS r FROM p JOIN c x ON x.feature = p.a JOIN c y ON y.feature = p.b)
        SELECT a, b, r, coalesce(abs(r) > 0.7 AND {_ORDER.replace('feature', 'a')} < {_ORDER.replace('feature', 'b')}, false) AS redundant FROM q""",
    "audit_stats": f"WITH {_LONG}, {_ST} SELECT domain, feature, round(mean, 6) AS mean, round(std, 6) AS std, is_binary, is_constant FROM st",
    "margin_scores": with_views("""
        WITH o AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM documents JOIN manifest ON sid = doc_id WHERE truth = 'normal'),
        r AS (SELECT lo - (hi - lo) * 0.1::DOUBLE AS lo, hi + (hi - lo) * 0.1::DOUBLE AS hi FROM o),
        s AS (SELECT doc_id AS id, greatest(0, least(1, (n_chars - lo) / CASE WHEN hi <= lo THEN 1 ELSE hi - lo END))::DOUBLE AS score FROM documents, r)
        SELECT id, round(score + 1e-10, 6) AS score, round(least(1.0, abs(score - 0.5) * 2) + 1e-10, 6) AS confidence FROM s""", "manifest"),
    "code_of_samples": "SELECT conv_id, turn, length(coalesce(nullif(CASE WHEN role = 'user' THEN text END, ''), nullif(text, ''), '')) AS n_chars, sha256(coalesce(nullif(CASE WHEN role = 'user' THEN text END, ''), nullif(text, ''), '')) AS sha256 FROM conversations",
}
