"""Grading: confusion metrics, rewards, calibration, score quality and threshold search."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Anomaly types that a response may name.
KNOWN_TYPES = (
    "factual_error", "fabricated_citation", "unsupported_claim", "sql_injection", "xss", "code_backdoor", "buffer_overflow",
    "logic_inconsistency", "constraint_violation", "data_anomaly", "pipeline_error", "mock_anomaly",
)
#: Inner edges of ten bins over [0, 1] as linspace gives them: the third is 0.30000000000000004, and so on.
EDGES = (0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)
POLICY = {"high": 0.5, "low": 0.493536, "min_confidence": 0.6}


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def validity(score: Column, kind: Column, known: tuple[str, ...] = KNOWN_TYPES) -> Column:
    """valid, or why a response is not; NaN is out of range."""
    return (
        F.when(score.isNull(), "missing_anomaly_score")
        .when(F.isnan(score) | (score < 0) | (score > 1), "anomaly_score_out_of_range")
        .when(kind.isNotNull() & ~kind.isin(*known), "unknown_anomaly_type")
        .otherwise("valid")
    )


def policy(score: Column, confidence: Column, mode: str = "multiband", high=POLICY["high"], low=POLICY["low"], least=POLICY["min_confidence"]) -> Column:
    """block, review or allow."""
    if mode == "multiband":
        return F.when(confidence < least, "review").when(score >= high, "block").when(score < low, "allow").otherwise("review")
    return F.when(confidence < least, "allow").when(score >= high, "block").otherwise("allow")


def confusion(predicted: Column, actual: Column) -> list[Column]:
    return [
        F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"),
    ]


def rates(df: DataFrame) -> DataFrame:
    """precision, recall, f1, accuracy and balanced accuracy from tp, fp, fn, tn; 0 for an empty denominator."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    classes = F.when(tp + fn > 0, 1).otherwise(0) + F.when(tn + fp > 0, 1).otherwise(0)
    return df.withColumns({
        "precision": p, "recall": r, "f1": ratio(2 * p * r, p + r), "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "balanced_accuracy": ratio(r + ratio(tn, tn + fp), classes),
    })


def reward(tp: Column, fp: Column, fn: Column) -> Column:
    """0.7 precision + 0.3 recall; 0 where nothing was flagged and nothing was to flag."""
    return clip(0.7 * ratio(tp, tp + fp) + 0.3 * ratio(tp, tp + fn))


def graded(responses: DataFrame, manifest: DataFrame) -> DataFrame:
    """Responses with their truth: flagged, actual, honeypot_failed; those without a manifest row go."""
    met = responses.join(manifest, "sid")
    ok = F.col("score").isNotNull() & ~F.isnan("score") & F.col("score").between(0, 1)
    flagged, actual = F.coalesce(ok & (F.col("score") >= 0.5), F.lit(False)), F.col("truth") == "anomalous"
    return met.withColumns({"valid": ok, "flagged": flagged, "actual": actual, "honeypot_failed": F.col("is_honeypot") & (~ok | (flagged != actual))})


def exact_rewards(graded_rows: DataFrame, *keys: str) -> DataFrame:
    """Reward per key: 0 if any honeypot failed, invalid responses left out otherwise."""
    v = F.col("valid")
    hits = [a.alias(n) for a, n in ((F.count_if(v & F.col("flagged") & F.col("actual")), "tp"), (F.count_if(v & F.col("flagged") & ~F.col("actual")), "fp"), (F.count_if(v & ~F.col("flagged") & F.col("actual")), "fn"))]
    g = graded_rows.groupBy(*keys).agg(*hits, F.bool_or("honeypot_failed").alias("failed"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("reward", F.when(F.col("failed"), 0.0).otherwise(reward(F.col("tp"), F.col("fp"), F.col("fn"))))


def bin_of(x: Column) -> Column:
    """Bin 0 to 9 by comparison with the literal edges."""
    return sum((F.when(x >= e, 1).otherwise(0) for e in EDGES), F.lit(0))


def calibration_error(rows: DataFrame, confidence: Column, accuracy: Column, *keys: str) -> DataFrame:
    """Expected calibration error per key over ten bins, and the bonus 1 - ece."""
    bins = rows.groupBy(*keys, bin_of(confidence).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("conf"), F.avg(accuracy).alias("acc")
    )
    out = bins.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))
    return out.withColumn("bonus", 1 - F.col("ece"))


def stability(rows: DataFrame, score: Column, *keys: str) -> DataFrame:
    """1 - population deviation of repeated scores, at least 0; 1 for fewer than two."""
    d = F.when(F.count(score) < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.stddev_pop(score)))
    return rows.groupBy(*keys).agg(d.alias("stability"))


def roc_auc(rows: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    """Area under the ROC curve from average ranks; 0.5 for one class.

    Ranks come from counts per distinct score, so equal scores meet in one row before the window."""
    counts = rows.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label)).alias("pos"))
    below = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("rank", F.coalesce(F.sum("n").over(below), F.lit(0)) + (F.col("n") + 1) / 2)
    s = ranked.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    auc = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))
    return s.select(*keys, F.when((F.col("p") > 0) & (F.col("q") > 0), auc).otherwise(0.5).alias("roc_auc"))


def average_precision(rows: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    """Sum of precision times the gain in recall over falling distinct thresholds."""
    counts = rows.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label)).alias("pos"))
    upto = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    steps = counts.select(*keys, (F.sum("pos").over(upto) / F.sum("n").over(upto) * F.col("pos") / F.sum("pos").over(every)).alias("gain"))
    return steps.groupBy(*keys).agg(F.coalesce(F.sum("gain"), F.lit(0.0)).alias("average_precision"))


def threshold_search(rows: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    """Best threshold by reward among 0.5, the distinct scores and the midpoints between them.

    Ties keep 0.5, then the lower one.  One pass over distinct scores: what a threshold flags is a
    suffix sum, so no threshold meets every row."""
    n_col, p_col = F.count(F.lit(1)).alias("n"), F.count_if(F.col(label)).alias("pos")
    halves = rows.select(*keys).distinct().withColumns({score: F.lit(0.5), "n": F.lit(0).cast("long"), "pos": F.lit(0).cast("long")})
    points = rows.groupBy(*keys, score).agg(n_col, p_col)
    order = Window.partitionBy(*keys).orderBy(score)
    mids = points.withColumn("next", F.lead(score).over(order)).where("next is not null").select(
        *keys, ((F.col(score) + F.col("next")) / 2).alias(score), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("pos")
    )
    merged = points.unionByName(mids).unionByName(halves).groupBy(*keys, score).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    upward = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    tp, flagged, actual = F.sum("pos").over(upward), F.sum("n").over(upward), F.sum("pos").over(every)
    scored = merged.select(*keys, F.col(score).alias("threshold"), tp.alias("tp"), (flagged - tp).alias("fp"), (actual - tp).alias("fn"))
    scored = scored.withColumn("reward", F.round(reward(F.col("tp"), F.col("fp"), F.col("fn")), 9))
    best = Window.partitionBy(*keys).orderBy(F.desc("reward"), F.desc(F.col("threshold") == 0.5), "threshold")
    return scored.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def kl_divergence(p: DataFrame, q: DataFrame, score: str, bins: int = 20, eps: float = 1e-10) -> DataFrame:
    """Divergence of the histograms of two score columns over [0, 1], natural log."""
    spark = p.sparkSession

    def density(df, name):
        b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin")
        counts = df.where(F.col(score).between(0, 1)).groupBy(b).agg(F.count(F.lit(1)).alias("n"))
        spine = spark.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left")
        every = Window.partitionBy(F.lit(0))
        return spine.select("bin", (F.coalesce("n", F.lit(0)) / F.sum(F.coalesce("n", F.lit(0))).over(every) + eps).alias(name))

    return density(p, "p").join(density(q, "q"), "bin").agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"))


MODES = ("global_threshold", "domain_thresholds", "operator_multiband")


def resolved_policy(config: dict) -> dict:
    """mode, high, low and min_confidence of a configuration of dotted keys.

    Each setting comes from policy.*, else validator.policy.*.  Where none is given, an old reward.decision_threshold stands
    for both thresholds without a band.  Missing thresholds have defaults; outside the band the low one is the high one."""
    given = {k: next((config[p + k] for p in ("policy.", "validator.policy.") if config.get(p + k) is not None), None) for k in ("mode", "high_threshold", "low_threshold", "min_confidence")}
    old = config.get("reward.decision_threshold")
    if old is not None and all(v is None for v in given.values()):
        return {"mode": MODES[0], "high": float(old), "low": float(old), "min_confidence": 0.0}
    mode = (given["mode"] or MODES[2]).lower()
    mode = mode if mode in MODES else MODES[2]
    banded = mode == MODES[2]
    pick = lambda k, default: float(default if given[k] is None else given[k])
    high = pick("high_threshold", POLICY["high"])
    return {"mode": mode, "high": high, "low": pick("low_threshold", POLICY["low"] if banded else high), "min_confidence": pick("min_confidence", POLICY["min_confidence"] if banded else 0.0)}
