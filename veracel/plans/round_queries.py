"""Queries of round building, repeats, memory upkeep, rules and reports."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_fraction, hash_int
from ..operators import detect as D
from ..operators import history as H
from ..operators import metrics as M
from ..operators import network as N
from ..operators import rounds as R
from ..sources.tables import domain_of, manifest, read, responses, with_views
from .metric_queries import _g, _graded, _rewards as _rw
from .network_queries import _JUDGES, _r, _rewards, _scores, r6


def adversarial_injection(spark, sf):
    """Each round's samples with two edge cases added."""
    r = responses(spark, sf)
    own = r.select("round", F.col("sid").cast("string").alias("sample_id")).distinct().withColumn("chars", F.lit(None).cast("long"))
    adv = R.adversarial_rows(r.select("round").distinct()).select("round", "sample_id", F.length("output").cast("long").alias("chars"))
    return own.unionByName(adv)


def statistical_scorer(spark, sf):
    return r6(R.interval(_rewards(spark, sf), "reward", "uid"), "mean", "std", "lower", "upper")


def report_criteria(spark, sf):
    """Whether each uid passes: rounds, answered share, mean reward."""
    r = responses(spark, sf).groupBy("uid").agg(F.countDistinct("round").alias("rounds"), F.avg(F.col("score").isNotNull().cast("double")).alias("answered"))
    m = _rewards(spark, sf).groupBy("uid").agg(F.round(F.avg("reward"), 9).alias("reward"))
    return r.join(m, "uid", "left").select("uid", "rounds", ((F.col("rounds") >= 5) & (F.col("answered") >= 0.7) & (F.coalesce("reward", F.lit(0.0)) >= 0.01)).alias("passed"))


def warm_up_sizes(spark, sf):
    """Samples asked of each uid: four at most in the first two rounds."""
    n = responses(spark, sf).groupBy("round", "uid").agg(F.count(F.lit(1)).alias("n"))
    return n.select("round", "uid", F.when(F.col("round") < 2, F.least(F.lit(4), "n")).otherwise(F.col("n")).alias("asked"))


def memory_eviction(spark, sf):
    """The 20 best outcomes of each label's memories."""
    e = read(spark, sf, "embeddings").select("vec_id", "label", hash_fraction(F.col("vec_id").cast("string")).alias("outcome"))
    return R.keep_best(e, 20, "outcome", "vec_id", "label").select("label", "vec_id", F.round("outcome", 9).alias("outcome"))


def memory_decay(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", "label", hash_fraction(F.col("vec_id").cast("string")).alias("outcome"))
    return R.decayed(e, F.col("label") < 5).select("vec_id", F.round("outcome", 9).alias("outcome"))


def clonal_selection(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", hash_fraction(F.col("vec_id").cast("string")).alias("outcome"))
    return R.clones(e, "vec_id", "outcome").select("vec_id", F.col("clone").cast("long").alias("clone"), F.round("outcome", 9).alias("outcome"))


def feedback_tracking(spark, sf):
    """Mean signal over each uid's last three rounds."""
    s = H.feedback_signal(_rewards(spark, sf), "round", "reward", "uid")
    w = Window.partitionBy("uid").orderBy("round").rowsBetween(-2, 0)
    return r6(s.select("uid", "round", F.avg("signal").over(w).alias("mean_signal")), "mean_signal")


def config_rules(spark, sf):
    """Rules over event properties read as settings."""
    e = read(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    rules = {"k_out_of_range": ~F.col("k").between(5, 95), "value_too_large": F.col("value") > 200, "error_with_value": (F.col("event_type") == "error") & (F.col("value") > 50)}
    return R.broken_rules(e, rules, "event_id")


def preflight_rules(spark, sf):
    o = read(spark, sf, "orders")
    rules = {"open_and_old": (F.col("o_orderstatus") == "O") & (F.year("o_orderdate") < 1995), "no_price": F.col("o_totalprice") <= 1000, "urgent_and_cheap": F.startswith(F.col("o_orderpriority"), F.lit("1")) & (F.col("o_totalprice") < 5000)}
    return R.broken_rules(o, rules, "o_orderkey")


def growth_percent(spark, sf):
    """Growth of each month's orders over the first month's, at least 0."""
    m = read(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    base = F.first("total").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0))
    return m.select("month", F.round(F.greatest(F.lit(0.0), (F.col("total") - base) / base * 100), 4).alias("growth"))


def kernel_novelty(spark, sf):
    """1 - mean Gaussian kernel of each query vector to all others (stands in for a one-class SVM)."""
    e = read(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    n = D.kernel_novelty(q, e.select(F.col("vec_id").alias("mid"), F.col("embedding").alias("m")))
    return n.select("qid", F.round("novelty", 6).alias("novelty"))


def generated_samples(spark, sf):
    """A generated sample per document: label, difficulty and honeypot flag by hashes, sequential id per domain."""
    d = read(spark, sf, "documents").select("doc_id", domain_of(F.col("doc_id")).alias("domain"))
    h = lambda tag: hash_int(F.concat(F.lit(tag), F.col("doc_id").cast("string"))) % 100
    bad, level = h("label:") < 50, h("difficulty:")
    d = H.numbered(d.withColumn("place", F.struct("domain", "doc_id")), "place", "n")  # over all domains, in ranges
    first = d.groupBy("domain").agg(F.min("n").alias("first"))  # a row a domain
    d = d.join(F.broadcast(first), "domain")
    n = F.col("n") - F.col("first") + 1
    code = F.when(F.col("domain") == "hallucination", "hall").when(F.col("domain") == "code_security", "cs").when(F.col("domain") == "reasoning", "rea").otherwise("bio")
    return d.select(
        "doc_id", F.concat(F.lit("eval-"), code, F.lit("-"), F.format_string("%03d", n)).alias("id"), F.when(bad, "anomalous").otherwise("normal").alias("truth"),
        F.when(level < 30, "easy").when(level < 70, "medium").otherwise("hard").alias("difficulty"), (bad & (h("honeypot:") < 13)).alias("is_honeypot"),
    )


def round_reports(spark, sf):
    """Per round: uids, mean reward, F1 over all answers."""
    g = _graded(spark, sf)
    m = M.rates(g.where("valid").groupBy("round").agg(*M.confusion(F.col("flagged"), F.col("actual"))))
    r = M.exact_rewards(g, "round", "uid").groupBy("round").agg(F.count(F.lit(1)).alias("uids"), F.avg("reward").alias("mean_reward"), F.stddev_pop("reward").alias("std_reward"))
    return r6(r.join(m.select("round", "f1"), "round"), "mean_reward", "std_reward", "f1")


def variance_decomposition(spark, sf):
    return r6(R.variance_parts(_scores(spark, sf), "score", "sid"), "between", "within")


def metric_folds(spark, sf):
    """Runtime exports folded: counters summed, gauges by their maximum."""
    e = read(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("counter"), F.max("value").alias("gauge"), F.countDistinct("user_id").alias("uids"))


def operator_accuracy(spark, sf):
    """Accuracy of the policy where only block counts as flagged, against review counted too."""
    g = _graded(spark, sf).where("valid")
    p = M.policy(F.col("score"), F.col("confidence"))
    right = lambda flagged: F.round(F.avg((flagged == F.col("actual")).cast("double")), 6)
    return g.groupBy("round").agg(right(p == "block").alias("block_only"), right(p != "allow").alias("with_review"))


def network_agreement(spark, sf):
    """Mean rho over all pairs of judges."""
    e = responses(spark, sf).join(read(spark, sf, "events").select("event_id", "event_type"), "event_id")
    j = e.where("score is not null").groupBy(F.col("event_type").alias("judge"), "uid").agg(F.round(F.avg("score"), 9).alias("score"))
    return N.rank_agreement(j).agg(F.round(F.avg("rho"), 6).alias("mean_rho"), F.count(F.lit(1)).alias("pairs"))


def conversation_pairs(spark, sf):
    """User turns with the assistant turn that follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf, "conversations").withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    return c.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.length("text").cast("long").alias("prompt_chars"), F.length("answer").cast("long").alias("answer_chars"))


QUERIES = {f.__name__: f for f in (
    adversarial_injection, statistical_scorer, report_criteria, warm_up_sizes, memory_eviction, memory_decay, clonal_selection, feedback_tracking, config_rules,
    preflight_rules, growth_percent, kernel_novelty, generated_samples, round_reports, variance_decomposition, metric_folds, operator_accuracy,
    network_agreement, conversation_pairs,
)}

_H = lambda x: f"(CAST('0x' || substr(sha256({x}), 1, 16) AS UBIGINT) / 18446744073709551615.0)"
_I = lambda x: f"CAST('0x' || substr(sha256({x}), 1, 8) AS BIGINT)"
_POL = "CASE WHEN confidence < 0.6 THEN 'review' WHEN score >= 0.5 THEN 'block' WHEN score < 0.493536 THEN 'allow' ELSE 'review' END"
_DIST = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2)))"

SQL = {
    "adversarial_injection": with_views(f"""WITH a AS (SELECT round, 'adv_' || round || '_' || i AS sample_id, {_I("(round + 9999) || ':' || i")} % {len(R.EDGE_OUTPUTS)} AS p FROM (SELECT DISTINCT round FROM responses), range(2) t(i))
        SELECT DISTINCT round, CAST(sid AS VARCHAR) AS sample_id, CAST(NULL AS BIGINT) AS chars FROM responses UNION ALL SELECT round, sample_id, {[len(o) for o in R.EDGE_OUTPUTS]}[p + 1]::BIGINT FROM a""", "responses"),
    "statistical_scorer": _g(f"""WITH {_rw('round', 'uid')}, s AS (SELECT uid, avg(reward) AS m, coalesce(stddev_samp(reward), 0) AS sd, count(*) AS n FROM rw GROUP BY uid),
        h AS (SELECT *, CASE WHEN sd = 0 THEN 0 ELSE coalesce({list(R.T95)}[greatest(n - 1, 1)], {R.NORMAL95}) * sd / sqrt(n) END AS h FROM s)
        SELECT uid, {_r('m', 'mean')}, {_r('sd', 'std')}, n, {_r('m - h', 'lower')}, {_r('m + h', 'upper')} FROM h"""),
    "report_criteria": _g(f"""WITH {_rw('round', 'uid')}, m AS (SELECT uid, round(avg(reward), 9) AS reward FROM rw GROUP BY uid), r AS (SELECT uid, count(DISTINCT round) AS rounds, count(score) / count(*) AS answered FROM responses GROUP BY uid)
        SELECT r.uid, rounds, rounds >= 5 AND answered >= 0.7 AND coalesce(reward, 0) >= 0.01 AS passed FROM r LEFT JOIN m ON m.uid = r.uid"""),
    "warm_up_sizes": with_views("SELECT round, uid, CASE WHEN round < 2 THEN least(4, count(*)) ELSE count(*) END AS asked FROM responses GROUP BY round, uid", "responses"),
    "memory_eviction": f"WITH m AS (SELECT label, vec_id, {_H('vec_id::VARCHAR')} AS o FROM embeddings) SELECT label, vec_id, round(o, 9) AS outcome FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY o DESC, vec_id) <= 20",
    "memory_decay": f"WITH m AS (SELECT vec_id, {_H('vec_id::VARCHAR')} * CASE WHEN label < 5 THEN 0.9::DOUBLE ELSE 1 END AS o FROM embeddings) SELECT vec_id, round(o, 9) AS outcome FROM m WHERE o >= 0.1",
    "clonal_selection": f"SELECT vec_id, c AS clone, round(greatest(0, least(1, {_H('vec_id::VARCHAR')} + ({_H(chr(39).join(['vec_id || ', ':', ' || c']))} - 0.5) * 0.1::DOUBLE)), 9) AS outcome FROM embeddings, range(1, 3) t(c)",
    "feedback_tracking": _g(f"""WITH {_rw('round', 'uid')}, l AS (SELECT uid, round, reward, lag(reward) OVER (PARTITION BY uid ORDER BY round) AS w FROM rw),
        s AS (SELECT uid, round, greatest(-1, least(1, CASE WHEN w IS NULL OR w = 0 THEN 0 ELSE (reward - w) / abs(w) * 10 END)) AS s FROM l)
        SELECT uid, round, {_r('avg(s) OVER (PARTITION BY uid ORDER BY round ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 'mean_signal')} FROM s"""),
    "config_rules": """WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
        SELECT event_id, 'k_out_of_range' AS rule FROM e WHERE k NOT BETWEEN 5 AND 95 UNION ALL SELECT event_id, 'value_too_large' FROM e WHERE value > 200 UNION ALL SELECT event_id, 'error_with_value' FROM e WHERE event_type = 'error' AND value > 50""",
    "preflight_rules": """SELECT o_orderkey, 'open_and_old' AS rule FROM orders WHERE o_orderstatus = 'O' AND year(o_orderdate) < 1995 UNION ALL SELECT o_orderkey, 'no_price' FROM orders WHERE o_totalprice <= 1000
        UNION ALL SELECT o_orderkey, 'urgent_and_cheap' FROM orders WHERE starts_with(o_orderpriority, '1') AND o_totalprice < 5000""",
    "growth_percent": """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)
        SELECT month, round(greatest(0, (total - first_value(total) OVER (ORDER BY month)) / first_value(total) OVER (ORDER BY month) * 100), 4) AS growth FROM m""",
    "kernel_novelty": f"SELECT a.vec_id AS qid, round(1 - avg(exp(-power({_DIST}, 2))), 6) AS novelty FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id GROUP BY a.vec_id",
    "generated_samples": f"""WITH d AS (SELECT doc_id, doc_id % 4 AS k, {_I("'label:' || doc_id")} % 100 < 50 AS bad, {_I("'difficulty:' || doc_id")} % 100 AS lv, {_I("'honeypot:' || doc_id")} % 100 < 13 AS hp FROM documents)
        SELECT doc_id, 'eval-' || ['hall', 'cs', 'rea', 'bio'][k + 1] || '-' || printf('%03d', row_number() OVER (PARTITION BY k ORDER BY doc_id)) AS id, CASE WHEN bad THEN 'anomalous' ELSE 'normal' END AS truth,
               CASE WHEN lv < 30 THEN 'easy' WHEN lv < 70 THEN 'medium' ELSE 'hard' END AS difficulty, bad AND hp AS is_honeypot FROM d""",
    "round_reports": _g(f"""WITH {_rw('round', 'uid')}, r AS (SELECT round, count(*) AS uids, avg(reward) AS m, stddev_pop(reward) AS sd FROM rw GROUP BY round),
        c AS (SELECT round, count(*) FILTER (flagged AND actual) AS tp, count(*) FILTER (flagged <> actual) AS wrong FROM g WHERE valid GROUP BY round)
        SELECT r.round, uids, {_r('m', 'mean_reward')}, {_r('sd', 'std_reward')}, {_r('CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + wrong) ELSE 0 END', 'f1')} FROM r JOIN c ON c.round = r.round"""),
    "variance_decomposition": with_views(f"WITH s AS (SELECT avg(score) AS m, var_pop(score) AS v FROM responses WHERE score IS NOT NULL GROUP BY sid) SELECT {_r('var_pop(m)', 'between')}, {_r('avg(v)', 'within')}, count(*) AS groups FROM s", "responses"),
    "metric_folds": "SELECT event_type, count(*) AS counter, max(value) AS gauge, count(DISTINCT user_id) AS uids FROM events GROUP BY event_type",
    "operator_accuracy": _g(f"SELECT round, round(avg(((({_POL}) = 'block') = actual)::INT::DOUBLE), 6) AS block_only, round(avg(((({_POL}) <> 'allow') = actual)::INT::DOUBLE), 6) AS with_review FROM g WHERE valid GROUP BY round"),
    "network_agreement": with_views(f"WITH {_JUDGES} SELECT round(avg(rho), 6) AS mean_rho, count(*) AS pairs FROM rho", "responses"),
    "conversation_pairs": """WITH c AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, turn, length(text) AS prompt_chars, length(a) AS answer_chars FROM c WHERE role = 'user' AND nr = 'assistant'""",
}
