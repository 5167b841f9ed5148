"""Queries of text features, projections and scalar functions."""

from pyspark.sql import functions as F

from ..functions import scalars, text
from ..sources.tables import read, samples, with_views


def _rounded(df, *keep):
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in df.columns if c not in keep])


def text_projections(spark, sf):
    s = samples(spark, sf)
    return s.select("id", F.length(text.pair_text(F.col("prompt"), F.col("output"))).cast("long").alias("pair_chars"), F.sha2(text.pair_text(F.col("prompt"), F.col("output")), 256).alias("pair_sha"), F.coalesce(F.expr("nullif(output, '')"), "prompt").alias("audit_text"))


def dendritic_features(spark, sf):
    return _rounded(text.with_features(samples(spark, sf), text.dendritic(F.col("output")), "id"), "id")


def hallucination_features(spark, sf):
    return _rounded(text.with_features(samples(spark, sf), text.hallucination(F.col("prompt"), F.col("output")), "id"), "id")


def reasoning_features(spark, sf):
    return _rounded(text.with_features(samples(spark, sf), text.reasoning(F.col("prompt"), F.col("output")), "id"), "id")


def reasoning_steps(spark, sf):
    s = samples(spark, sf)
    return s.select("id", text.reasoning_steps(text.pair_text(F.col("prompt"), F.col("output"))).alias("r")).select("id", "r.*")


def bio_features(spark, sf):
    return _rounded(text.with_features(samples(spark, sf), text.bio(F.col("prompt"), F.col("output")), "id"), "id")


def code_features(spark, sf):
    return samples(spark, sf).select("id", text.code_security("output").alias("r")).select("id", "r.*")


def shannon_entropy(spark, sf):
    got = samples(spark, sf).select("id", text.fractal("output").alias("r"))
    return got.select("id", *[F.round(f"r.{c}", 6).alias(c) for c in ("shannon_char", "shannon_word", "shannon_bigram")])


def fractal_features(spark, sf):
    return samples(spark, sf).select("id", text.fractal("output").alias("r")).select("id", "r.*")


def tfidf_terms(spark, sf):
    """Sub-linear tf times smooth idf of every (document, word), L2-normed."""
    return scalars.tfidf(samples(spark, sf).select("id", F.lower("output").alias("text")), text.tokens).select("id", "word", F.round("weight", 6).alias("weight"))


def top_attributions(spark, sf):
    """The five heaviest words of each document."""
    return scalars.top_words(scalars.tfidf(samples(spark, sf).select("id", F.lower("output").alias("text")), text.tokens), 5)


def hash_fractions(spark, sf):
    d = read(spark, sf, "documents")
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("source"))
    return d.select("doc_id", scalars.hash_int(key).alias("hash_int"), F.round(scalars.hash_fraction(key), 9).alias("fraction"))


def domain_normaliser(spark, sf):
    s = samples(spark, sf)
    shouted = F.concat(F.lit(" "), F.upper("domain"), F.lit("  "))
    return s.select("id", scalars.canonical_domain(shouted).alias("domain"), F.regexp_replace(F.lower("domain"), "[^a-z0-9]+", "-").alias("slug"))


def embedding_similarity(spark, sf):
    """Cosine of each vector with the next one of its label."""
    from pyspark.sql import Window

    e = read(spark, sf, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    pairs = e.withColumn("next", F.lead("embedding").over(w)).where("next is not null")
    return pairs.select("vec_id", F.round(text.clip(scalars.cosine(F.col("embedding"), F.col("next"))), 5).alias("similarity"))


def perturbations(spark, sf):
    from ..functions.perturb import perturb_variants

    return perturb_variants(samples(spark, sf), seed_round=3, entropy=7)


def challenge_keys(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", scalars.hash_int(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("source"), F.lit("1"))).alias("challenge_key"))


def structured_log_lines(spark, sf):
    e = read(spark, sf, "events")
    return e.select("event_id", F.to_json(F.struct(F.lit("INFO").alias("level"), F.col("event_type").alias("message"), F.col("user_id").alias("uid"), F.col("event_id").alias("step"))).alias("line"))


def json_round_trip(spark, sf):
    """Samples as the JSON of a data file and back."""
    d = read(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    doc = F.to_json(F.struct(F.struct("lang", "source").alias("metadata"), "doc_id", "n_chars"))
    back = F.from_json(doc, "struct<metadata:struct<lang:string,source:string>,doc_id:long,n_chars:long>")
    return d.select(back.alias("b")).select("b.doc_id", "b.metadata.lang", "b.metadata.source", "b.n_chars")


def json_map_scan(spark, sf):
    """Event properties as a map, one row an entry."""
    e = read(spark, sf, "events")
    return e.select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value"))


def path_rules(spark, sf):
    """Longest-prefix include and exclude rules over url paths."""
    return scalars.classify_paths(read(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^[^:]+://[^/?#]*/([^?#]*)", 1).alias("path")), include=("en/", "de/", "fr/"), exclude=("en/9", "de/1"))


QUERIES = {f.__name__: f for f in (
    text_projections, dendritic_features, hallucination_features, reasoning_features, reasoning_steps, bio_features, code_features, shannon_entropy,
    fractal_features, tfidf_terms, top_attributions, hash_fractions, domain_normaliser, embedding_similarity, perturbations, challenge_keys,
    structured_log_lines, json_round_trip, json_map_scan, path_rules,
)}

_T = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"
_LOW, _ALL = _T.format("lower(output)"), _T.format("output")


def _words(ws):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + "]"


def _re(p):
    return "'" + p.replace("'", "''") + "'"


def _any(col, ws):
    return f"CAST(len(list_intersect(list_distinct({col}), {_words(ws)})) > 0 AS DOUBLE)"


def _count(col, ws):
    return f"len(list_intersect(list_distinct({col}), {_words(ws)}))"


_ALARMS = " + ".join(f"CAST(regexp_matches(output, {_re(p)}) AS INT)" for p in text.DANGER)
_PAIR = "trim(prompt || ' ' || output)"
# RE2's word borders are ASCII; with every other character a letter they fall where Unicode's do
_ASCII = f"regexp_replace({_PAIR}, '[^\\x00-\\x7F]', 'x', 'g')"
_SENT = "list_filter(list_transform(regexp_split_to_array(t, '[.!?]+\\s+|[.!?]+$'), lambda s: trim(s, E' \\n\\t\\r')), lambda s: s <> '')"
_BARE = "list_transform(low, lambda w: trim(w, '.,;:!?()\"' || chr(39)))"


def _among(ws):
    return f"len(list_filter(bare, lambda w: list_contains({_words(ws)}, w)))"


def _n(p):
    return f"len(regexp_extract_all(t, {_re(p)}))"


def _context_rules():
    return " OR ".join(
        f"(regexp_matches(tail, {_re(p)}) AND (v < {low} OR v > {'1e308' if high == text.math.inf else high}))" for p, low, high in text.RANGES
    )


SQL = {
    "text_projections": with_views("SELECT id, length(prompt || ' ' || output) AS pair_chars, sha256(prompt || ' ' || output) AS pair_sha, coalesce(nullif(output, ''), prompt) AS audit_text FROM samples", "samples"),
    "dendritic_features": with_views(f"""
        WITH w AS (SELECT id, output, {_LOW} AS low, {_ALL} AS al, {_ALARMS} AS alarms,
                          CAST({' OR '.join(f'regexp_matches(output, {_re(p)})' for p in text.CITATIONS)} AS DOUBLE) AS cited FROM samples),
        f AS (SELECT id, cited AS citation_count, {_any('low', text.HEDGING)} AS hedging_ratio,
                     least(len(list_filter(al, lambda x: length(x) > 1 AND regexp_matches(x, '^\\p{{Lu}}'))) / greatest(len(low), 1) * 5, 1.0) AS specificity,
                     CAST(regexp_matches(lower(output), {_re(text.QUANTITIES)}) AS DOUBLE) AS numeric_density, least(alarms / 3, 1.0) AS pamp_score,
                     least({_count('low', text.EXAGGERATION)} / 3, 1.0) AS exaggeration, {_any('low', text.CERTAINTY)} AS certainty,
                     least({_count('low', text.CONTROVERSY)} / 2, 1.0) AS controversy, least(alarms / 5, 1.0) AS danger_signal FROM w)
        SELECT id, round(greatest(0, least(1, 0.5 + 0.2 * citation_count + 0.1 * hedging_ratio - CASE WHEN exaggeration > 0.5 THEN 0.2 ELSE 0 END - CASE WHEN pamp_score > 0.5 THEN 0.3 ELSE 0 END))::DOUBLE, 6) AS claim_density,
               round(citation_count, 6) AS citation_count, round(hedging_ratio, 6) AS hedging_ratio, round(specificity::DOUBLE, 6) AS specificity, round(numeric_density, 6) AS numeric_density,
               round(pamp_score::DOUBLE, 6) AS pamp_score, round(exaggeration::DOUBLE, 6) AS exaggeration, round(certainty, 6) AS certainty, round(controversy::DOUBLE, 6) AS controversy, round(danger_signal::DOUBLE, 6) AS danger_signal FROM f""", "samples"),
    "hallucination_features": with_views(f"""
        WITH a AS (SELECT id, {_PAIR} AS t, length(prompt) + length(output) AS chars FROM samples),
        b AS (SELECT *, {_SENT} AS s, len({_T.format('t')}) AS words, {_n(text.PAREN_CITATION)} + {_n(text.NARRATIVE_CITATION)} AS formal, {_n(text.BRACKET_CITATION)} AS bracket FROM a),
        c AS (SELECT *, greatest(len(s), 1) AS n FROM b)
        SELECT id,
               round(CASE WHEN t = '' THEN 0 ELSE len(list_filter(s, lambda x: NOT list_contains({_words(text.QUESTION_WORDS)}, ({_T.format('lower(x)')})[1]) AND NOT ends_with(x, '?'))) / n END::DOUBLE, 6) AS claim_density,
               CASE WHEN t = '' THEN 0 ELSE formal + bracket END::DOUBLE AS citation_count,
               round(CASE WHEN t = '' OR formal + bracket = 0 THEN 0 ELSE formal / (formal + bracket) END::DOUBLE, 6) AS citation_pattern_score,
               round(CASE WHEN t = '' THEN 0 ELSE len(list_filter(s, lambda x: len(list_intersect({_T.format('lower(x)')}, {_words(text.SENTENCE_HEDGING)})) > 0)) / n END::DOUBLE, 6) AS hedging_ratio,
               round(CASE WHEN t = '' OR words = 0 THEN 0 ELSE {_n(chr(92) + 'b' + chr(92) + 'd+' + chr(92) + '.?' + chr(92) + 'd*' + chr(92) + 'b')} / words END::DOUBLE, 6) AS numeric_claim_density,
               round(CASE WHEN t = '' THEN 0 ELSE words / n END::DOUBLE, 6) AS avg_sentence_length,
               CASE WHEN t = '' THEN 0 ELSE chars END::DOUBLE AS text_length FROM c""", "samples"),
    "reasoning_features": with_views(f"""
        WITH a AS (SELECT id, {_PAIR} AS t, length(prompt) + length(output) AS chars FROM samples),
        b AS (SELECT *, {_T.format('lower(t)')} AS low FROM a),
        c AS (SELECT * EXCLUDE (t), {_BARE} AS bare, regexp_replace(t, '[^\\x00-\\x7F]', 'x', 'g') AS t FROM b),
        d AS (SELECT *, {_among(text.PREMISES)} AS p, {_among(text.CONCLUSIONS)} AS e FROM c)
        SELECT id, round(CASE WHEN len(low) > 0 THEN ({_among(text.CONNECTIVES)} + {_n('(?i)' + chr(92) + 'bfollows' + chr(92) + 's+that' + chr(92) + 'b')}) / len(low) ELSE 0 END::DOUBLE, 6) AS connective_density,
               {_n(text.NEGATION)}::DOUBLE AS negation_count,
               round(CASE WHEN p > 0 AND e > 0 THEN least(p / e, 5) WHEN p > 0 THEN 5 ELSE 1 END::DOUBLE, 6) AS premise_conclusion_ratio, chars::DOUBLE AS total_length FROM d""", "samples"),
    "bio_features": with_views(f"""
        WITH a AS (SELECT id, {_ASCII} AS t FROM samples),
        b AS (SELECT *, list_transform(regexp_extract_all(t, {_re(text.NUMBER)}), lambda v: CAST(v AS DOUBLE)) AS v, regexp_extract_all(t, {_re(text.NUMBER)}) AS raw, regexp_split_to_array(t, {_re(text.NUMBER)}) AS gap FROM a),
        c AS (SELECT *, list_avg(v) AS m, list_var_pop(v) AS var, list_filter(list_transform(v, lambda x: abs(x)), lambda x: x > 0) AS pos FROM b),
        e AS (SELECT id, i, v[i] AS v, right(array_to_string(list_transform(range(1, i + 1), lambda k: gap[k] || CASE WHEN k < i THEN raw[k] ELSE '' END), ''), 50) AS tail FROM (SELECT id, v, raw, gap, unnest(range(1, len(v) + 1)) AS i FROM b)),
        o AS (SELECT id, count(*) FILTER ({_context_rules()}) AS n FROM e GROUP BY id)
        SELECT c.id, len(v)::DOUBLE AS numeric_value_count,
               CASE WHEN len(v) >= 3 AND var >= 1e-10 THEN len(list_filter(v, lambda x: abs((x - m) / sqrt(var)) > 3)) ELSE 0 END::DOUBLE AS z_score_outlier_count,
               len(list_filter(v, lambda x: x < 0))::DOUBLE AS negative_value_count, {_n(text.UNITS)}::DOUBLE AS unit_mention_count,
               round(CASE WHEN len(pos) >= 2 THEN log10(list_max(pos) / list_min(pos)) ELSE 0 END::DOUBLE, 6) AS value_magnitude_range,
               ({' + '.join(_n('(?i)' + p) for p in text.STATISTICS)})::DOUBLE AS statistical_summary_count, coalesce(o.n, 0)::DOUBLE AS out_of_range_count
        FROM c LEFT JOIN o ON o.id = c.id""", "samples"),
    "shannon_entropy": with_views(f"""
        WITH w AS (SELECT id, {_ALL} AS ws, string_split(output, '') AS cs FROM samples),
        t AS (SELECT id, 'c' AS k, unnest(cs) AS x FROM w UNION ALL SELECT id, 'w', unnest(ws) FROM w
              UNION ALL SELECT id, 'b', unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w),
        n AS (SELECT id, k, x, count(*) AS n FROM t WHERE x <> '' GROUP BY ALL),
        p AS (SELECT id, k, n / sum(n) OVER (PARTITION BY id, k) AS p FROM n),
        h AS (SELECT id, k, -sum(p * log2(p)) AS h FROM p GROUP BY ALL)
        SELECT s.id, round(coalesce(max(h) FILTER (k = 'c'), 0) + 0.0, 6) AS shannon_char, round(coalesce(max(h) FILTER (k = 'w'), 0) + 0.0, 6) AS shannon_word, round(coalesce(max(h) FILTER (k = 'b'), 0) + 0.0, 6) AS shannon_bigram
        FROM samples s LEFT JOIN h ON h.id = s.id GROUP BY s.id""", "samples"),
    "tfidf_terms": with_views(f"""
        WITH t AS (SELECT id, unnest({_LOW}) AS word FROM samples), c AS (SELECT id, word, count(*) AS tf FROM t GROUP BY ALL),
        d AS (SELECT word, count(*) AS df FROM c GROUP BY word), n AS (SELECT count(*) AS n FROM samples),
        w AS (SELECT id, word, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN d USING (word), n)
        SELECT id, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w""", "samples"),
    "top_attributions": with_views(f"""
        WITH t AS (SELECT id, unnest({_LOW}) AS word FROM samples), c AS (SELECT id, word, count(*) AS tf FROM t GROUP BY ALL),
        d AS (SELECT word, count(*) AS df FROM c GROUP BY word), n AS (SELECT count(*) AS n FROM samples),
        w AS (SELECT id, word, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN d USING (word), n),
        l AS (SELECT id, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, word) AS rank FROM l)
        SELECT id, rank, word, weight FROM r WHERE rank <= 5""", "samples"),
    "hash_fractions": """SELECT doc_id, CAST('0x' || substr(sha256(doc_id || ':' || source), 1, 8) AS BIGINT) AS hash_int,
        round(CAST('0x' || substr(sha256(doc_id || ':' || source), 1, 16) AS UBIGINT) / 18446744073709551615.0, 9) AS fraction FROM documents""",
    "domain_normaliser": with_views("SELECT id, CASE domain WHEN 'code_security' THEN 'code' ELSE domain END AS domain, replace(domain, '_', '-') AS slug FROM samples", "samples"),
    "embedding_similarity": """
        WITH p AS (SELECT vec_id, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings)
        SELECT vec_id, round(greatest(0, least(1, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(nxt, lambda x: x::DOUBLE)))), 5) AS similarity FROM p WHERE nxt IS NOT NULL""",
    "challenge_keys": "SELECT doc_id, CAST('0x' || substr(sha256(doc_id || ':' || source || ':1'), 1, 8) AS BIGINT) AS challenge_key FROM documents",
    "structured_log_lines": """SELECT event_id, '{"level":"INFO","message":"' || event_type || '","uid":' || user_id || ',"step":' || event_id || '}' AS line FROM events""",
    "json_round_trip": "SELECT doc_id, lang, source, n_chars FROM documents",
    "json_map_scan": "SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events",
    "path_rules": r"""
        WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]+://[^/?#]*/([^?#]*)', 1) AS path FROM pages)
        SELECT page_id, path, (starts_with(path, 'en/') AND NOT starts_with(path, 'en/9')) OR (starts_with(path, 'de/') AND NOT starts_with(path, 'de/1')) OR starts_with(path, 'fr/') AS included FROM p""",
}
