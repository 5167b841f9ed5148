"""Queries of sparse text vectors, the detectors over them, the vector index, and statistics."""

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import statistics, text
from ..functions import vectors as V
from ..operators import detect as D
from ..operators import models, one_class
from ..operators import vector_index as X
from ..sources.shared import materialize
from ..sources.tables import DOMAINS, manifest, read, samples, with_views
from .detect_queries import SQL as _DETECT
from .immune_queries import PACKS, SETTINGS, _combined, _normal, domain_settings, pack_features, scored_features

#: Normal rows that a detector is fitted on at most, in hash order.
FOREST_ROWS, MACHINE_ROWS = 800, 400


def _texts(spark, sf) -> DataFrame:
    return samples(spark, sf).select("id", "domain", text.pair_text(F.col("prompt"), F.col("output")).alias("text"))


def vocabulary_terms(spark, sf):
    """The 5,000 most frequent words and pairs of words of all samples."""
    got = V.vocabulary(_texts(spark, sf))
    return got.select("index", "term", "tf", "df", F.round("idf", 6).alias("idf"))


def text_vectors(spark, sf):
    """Every sample's weights over that vocabulary."""
    s = _texts(spark, sf)
    terms = materialize(V.vocabulary(s), "vocabulary")
    return V.weights(s, terms).join(F.broadcast(terms.select("index", "term")), "index").select("id", "term", F.round(F.col("weight") + 1e-10, 6).alias("weight"))


def fitted_vectors(s: DataFrame, own: DataFrame, extra: DataFrame | None = None) -> tuple[DataFrame, int]:
    """id, v, x (further features, if any) of the texts s, over the vocabulary of the normal ones (own: id), and the columns of both."""
    terms = materialize(V.vocabulary(s.join(own, "id", "left_semi")), "vocabulary")
    v = V.vectors(s, terms)
    names = [c for c in extra.columns if c != "id"] if extra is not None else []
    if names:
        v = v.join(extra.select("id", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names]).alias("x")), "id")
    else:
        v = v.withColumn("x", F.array().cast("array<double>"))
    return materialize(v, "vectors"), terms.count() + len(names)


def matrix(vs, xs, width: int) -> np.ndarray:
    """Sparse vectors with further features behind them, as a matrix."""
    out = V.dense(vs, width)
    k = len(xs[0]) if len(xs) else 0
    if k:
        out[:, width - k :] = np.stack(xs)
    return out


def _sample(v: DataFrame, own: DataFrame, width: int, most: int) -> np.ndarray:
    """Rows of the normal vectors, the first `most` in hash order, so many times `width` numbers on the driver at most."""
    picked = v.join(own, "id", "left_semi").orderBy(F.xxhash64("id", F.lit(5)), "id").limit(most).collect()
    return matrix([r.v for r in picked], [r.x for r in picked], width)


def raw_scores(v: DataFrame, width: int, score: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """id, raw: score of every vector, made a few rows at a time where the rows are."""

    @F.pandas_udf("double")
    def of(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.Series]:
        for vs, xs in batches:
            rows, out = vs.to_dict("records"), []
            for lo in range(0, len(rows), 256):
                out.append(score(matrix(rows[lo : lo + 256], xs.iloc[lo : lo + 256].tolist(), width)))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return v.select("id", F.round(of("v", "x"), 9).alias("raw"))


def ranked_forest(v: DataFrame, own: DataFrame, width: int) -> DataFrame:
    """id, score, confidence: an isolation forest over vectors, fitted on normal ones, its scores placed among theirs."""
    forest = D.Forest(_sample(v, own, width, FOREST_ROWS), 100, 256, 5)
    every = materialize(raw_scores(v, width, lambda x: -forest.score(x)), "raw-scores")
    scored = D.percentile_score(every, every.join(own, "id", "left_semi").select("raw"), "raw")
    return scored.withColumn("confidence", F.least(F.lit(1.0), F.abs(F.col("score") - 0.5) * 2))


def _normal_ids(s: DataFrame, spark, sf) -> DataFrame:
    return materialize(_normal(s.select("id"), spark, sf), "normal")


def text_forest(spark, sf):
    """Isolation forest over the text vectors of all samples, fitted on normal labelled ones."""
    s = _texts(spark, sf)
    own = _normal_ids(s, spark, sf)
    got = ranked_forest(*(lambda v, width: (v, own, width))(*fitted_vectors(s, own)))
    return got.select("id", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


def text_pack_scores(spark, sf):
    """Every sample scored by its domain's pack over its text vector and the domain's seven features together."""
    s, all_samples, parts = _texts(spark, sf), samples(spark, sf), []
    for domain in DOMAINS:
        here = s.where(F.col("domain") == domain)
        own = _normal_ids(here, spark, sf)
        v, width = fitted_vectors(here, own, pack_features(all_samples, domain).select("id", *PACKS[domain]))
        parts.append(ranked_forest(v, own, width).withColumn("domain", F.lit(domain)))
    every = functools.reduce(DataFrame.unionByName, parts)
    return every.select("id", "domain", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), (F.col("score") >= 0.5).alias("flagged"))


def _machine(spark, sf, fit) -> DataFrame:
    s = _texts(spark, sf)
    own = _normal_ids(s, spark, sf)
    v, width = fitted_vectors(s, own)
    model = fit(_sample(v, own, width, MACHINE_ROWS))
    got = raw_scores(v, width, model.score).withColumnRenamed("raw", "score")
    return got.select("id", F.round("score", 6).alias("score"), F.round(models.confidence(F.col("score")), 6).alias("confidence"))


def one_class_svm(spark, sf):
    """Every sample scored by a one-class support vector machine (nu 0.1, Gaussian) over text vectors."""
    return _machine(spark, sf, one_class.OneClassSvm.fit)


def autoencoder_scores(spark, sf):
    """Every sample scored by how unusual an autoencoder's error on its text vector is."""
    return _machine(spark, sf, one_class.Autoencoder.fit)


def _embeddings(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf, "embeddings")
    memory = e.select(F.col("vec_id").alias("mid"), F.col("embedding").alias("m"))
    return memory.where("mid % 20 = 0").select(F.col("mid").alias("qid"), F.col("m").alias("q")), memory


def indexed_neighbours(spark, sf):
    """The five nearest vectors of those divisible by 20, through the index, exactly."""
    queries, memory = _embeddings(spark, sf)
    got = X.search(queries, X.build(memory), 5, exact=True)
    return got.select("qid", "mid", "place", F.round("distance", 6).alias("distance"))


def memory_pipeline(spark, sf):
    """The pipeline's score of every sample, drawn towards the scores of its five nearest memories: labelled samples of its
    domain by their ten features, without itself.  A domain without memories keeps its scores."""
    rows = scored_features(spark, sf).join(F.broadcast(domain_settings(spark, sf)), "domain")
    got = materialize(_combined(rows, F.col("z_threshold"), F.col("pamp_threshold"), F.col("danger_alpha")), "pipeline")
    place = F.array(*[F.col(c).cast("double") for c in text.DENDRITIC])
    labelled = manifest(spark, sf).select(F.col("sid").alias("id")).hint("merge")  # ids are small in a file, not on the driver
    known = materialize(got.select("id", "domain", place.alias("place"), "modulated").join(labelled, "id", "left_semi"), "memories")
    parts = []
    for domain in DOMAINS:
        here = F.col("domain") == domain
        index = X.build(known.where(here).select(F.col("id").alias("mid"), F.col("place").alias("m")))
        asked = got.where(here).select(F.col("id").alias("qid"), place.alias("q"))
        parts.append(materialize(X.search(asked, index, 5, exact=True), "nearest"))  # small plans for the driver
    near = functools.reduce(DataFrame.unionByName, parts)
    prior = X.prior(near, known.select(F.col("id").alias("mid"), F.col("modulated").alias("score")).hint("merge"))
    out = got.join(prior.select(F.col("qid").alias("id"), "prior"), "id", "left")
    w = SETTINGS["memory_weight"]
    score = F.when(F.col("gated"), 1.0).otherwise(F.coalesce((1 - w) * F.col("modulated") + w * F.col("prior"), F.col("modulated")))
    return out.select("id", "domain", "state", "gated", F.round("modulated", 6).alias("modulated"), F.round("prior", 6).alias("prior"), F.round(score, 6).alias("score"))


def self_region_model(spark, sf):
    """Calibrated scores of every sample's ten features by the self region of normal labelled ones, read back from its saved table."""
    from ..sources.shared import shared_dir
    from .immune_queries import _features

    f = materialize(_features(spark, sf), "dendritic")
    path = f"{shared_dir(spark)}/models/self-region-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    models.SelfRegion.fit(_normal(f, spark, sf), text.DENDRITIC).save(spark, path)
    got = models.scored(f, text.DENDRITIC, models.SelfRegion.load(spark, path))
    return got.select("id", F.round("score", 6).alias("score"), F.round(models.confidence(F.col("score")), 6).alias("confidence"), F.when(F.col("score") >= 0.5, "anomaly").otherwise("normal").alias("type"))


def hurst_exponents(spark, sf):
    """Rescaled-range exponents of every sample's characters and word lengths."""
    got = samples(spark, sf).select("id", statistics.hurst_exponents(F.col("output")).alias("h"))
    return got.select("id", F.round("h.hurst_char", 6).alias("hurst_char"), F.round("h.hurst_word", 6).alias("hurst_word"))


def rank_significance(spark, sf):
    """Agreement of every two judges with its p-value, and whether it is below 0.05."""
    from .network_queries import rank_agreement

    p = rank_agreement(spark, sf)
    return p.withColumn("p", statistics.p_value(F.col("rho"), F.col("n"))).select("a", "b", "n", "rho", F.round("p", 9).alias("p"), (F.col("p") < 0.05).alias("significant"))


def user_sessions(spark, sf):
    """Each user's sessions: events less than 30 minutes apart."""
    e = read(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max("ts").alias("last"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), "n", "total")


QUERIES = {f.__name__: f for f in (
    vocabulary_terms, text_vectors, text_forest, text_pack_scores, one_class_svm, autoencoder_scores, indexed_neighbours, memory_pipeline, self_region_model,
    hurst_exponents, rank_significance, user_sessions,
)}

_STOP = ", ".join(f"'{w}'" for w in V.STOP_WORDS)
_GRAMS = with_views(f"""
    WITH w AS (SELECT id, list_filter(regexp_extract_all(lower(prompt || ' ' || output), '{V.WORD}'), lambda w: w NOT IN ({_STOP})) AS ws FROM samples),
    g AS (SELECT id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w),
    top AS (SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM g GROUP BY term ORDER BY tf DESC, term LIMIT {V.MAX_TERMS}),
    voc AS (SELECT row_number() OVER (ORDER BY term) - 1 AS index, term, tf, df, ln((1 + (SELECT count(*) FROM w)) / (1 + df)) + 1 AS idf FROM top)""", "samples")

SQL = {
    "vocabulary_terms": f"{_GRAMS} SELECT CAST(index AS INTEGER) AS index, term, tf, df, round(idf, 6) AS idf FROM voc",
    "text_vectors": f"""{_GRAMS}, t AS (SELECT id, term, (1 + ln(count(*))) * any_value(idf) AS raw FROM g JOIN voc USING (term) GROUP BY ALL)
        SELECT id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) + 1e-10, 6) AS weight FROM t""",
    "indexed_neighbours": _DETECT["nearest_vectors"],
    "user_sessions": """
        WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, k""",
}
