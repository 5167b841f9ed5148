"""Small cases worked out by hand from the definitions."""

import math
import random

import pytest
from pyspark.sql import functions as F
from veracel.functions import perturb, scalars, text
from veracel.operators import chain as C
from veracel.operators import detect as D
from veracel.operators import history as H
from veracel.operators import metrics as M
from veracel.operators import network as N
from veracel.sources import files, tables


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def graded(spark, rows):
    r = spark.createDataFrame([(0, i, s) for i, (s, _, _) in enumerate(rows)], "uid long, sid long, score double")
    m = spark.createDataFrame([(i, t, h) for i, (_, t, h) in enumerate(rows)], "sid long, truth string, is_honeypot boolean")
    return M.exact_rewards(M.graded(r, m), "uid").first().reward


def test_rewards(spark):
    a, n = "anomalous", "normal"
    assert graded(spark, [(0.9, a, False), (0.8, n, False), (0.2, a, False), (0.6, a, False)]) == pytest.approx(2 / 3)
    assert graded(spark, [(0.1, n, False), (0.2, n, False)]) == 0.0
    assert graded(spark, [(0.9, a, False), (0.1, a, True)]) == 0.0
    assert graded(spark, [(0.9, a, False), (None, a, True)]) == 0.0


def test_validity(spark):
    rows = [(None, None), (1.2, None), (math.nan, None), (0.5, "normal"), (0.5, None), (0.5, "xss")]
    df = spark.createDataFrame(rows, "s double, k string")
    assert [r[0] for r in df.select(M.validity(F.col("s"), F.col("k"))).collect()] == [
        "missing_anomaly_score", "anomaly_score_out_of_range", "anomaly_score_out_of_range", "unknown_anomaly_type", "valid", "valid"]


def test_calibration_edges(spark):
    df = spark.createDataFrame([(1, 0.3, 1.0), (1, 0.25, 0.0)], "uid int, c double, a double")
    assert M.calibration_error(df, F.col("c"), F.col("a"), "uid").first().ece == pytest.approx(0.225)


def test_stability(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7), (2, 0.1)], "uid int, s double")
    got = {r.uid: r.stability for r in M.stability(df, F.col("s"), "uid").collect()}
    assert got[1] == pytest.approx(0.9) and got[2] == 1.0


def test_ema(spark):
    df = spark.createDataFrame([(1, i, r) for i, r in enumerate([1.0, 0.0, 1.0])] + [(2, 0, math.nan)], "uid long, round long, reward double")
    got = {(r.uid, r.round): r.ema for r in H.ema(df, "round", "reward", "uid").collect()}
    assert [got[1, i] for i in range(3)] == pytest.approx([0.1, 0.09, 0.181]) and got[2, 0] == 0


def test_policy(spark):
    df = spark.createDataFrame([(0.9, 0.5), (0.9, 0.8), (0.4, 0.8), (0.495, 0.8)], "s double, c double")
    assert [r[0] for r in df.select(M.policy(F.col("s"), F.col("c"))).collect()] == ["review", "block", "allow", "review"]


def test_danger_and_maturation(spark):
    assert one(spark, x=D.danger_modulation(F.lit(0.5), F.lit(0.5), F.lit(0.0))).x == pytest.approx(0.575)
    state = lambda p, d, s: one(spark, x=D.maturation({"pamp": F.lit(p), "danger": F.lit(d), "safe": F.lit(s)})).x
    assert (state(0.3, 0.0, 1.0), state(0.0, 0.2, 0.3), state(0.0, 0.2, 0.2)) == ("mature", "immature", "semi-mature")


def test_z_gate(spark):
    g = one(spark, x=D.z_gate({"f": F.lit(0.95)}, {"f": (F.lit(0.5), F.lit(0.1))})).x
    assert g.score == 1.0 and g.confidence == pytest.approx(0.75)
    assert one(spark, x=D.z_gate({"f": F.lit(0.95)}, {"f": (F.lit(0.5), F.lit(0.0))})).x is None


def test_literal_features(spark):
    s = tables.literals(spark)
    f = {r.id: r for r in text.with_features(s, text.dendritic(F.col("output")), "id").collect()}
    d = f[-1]
    assert (d.citation_count, d.pamp_score, d.danger_signal, d.numeric_density) == (1, 1, pytest.approx(0.6), 1)
    assert d.exaggeration == pytest.approx(1 / 3) and d.claim_density == pytest.approx(0.4) and d.specificity == pytest.approx(5 / 14)
    b = {r.id: r for r in text.with_features(s, text.bio(F.col("prompt"), F.col("output")), "id").collect()}
    assert b[-3].out_of_range_count == 3 and b[-3].numeric_value_count == 5 and b[-3].negative_value_count == 1
    r = {r.id: r.r for r in s.select("id", text.reasoning_steps(F.col("output")).alias("r")).collect()}
    assert r[-2].contradiction_score == 0.5 and r[-4].step_count == 4


def test_code_features():
    assert text.code_features('import os\nos.system("a"+x)')[:4] == (1, 1, 0, 1)
    assert text.code_features('api_key = "x"\neval(y)') == (1, 0, 1, 0, 4, 1, 1)
    for broken in (None, "", "def (", "\0", "(" * 500):
        assert text.code_features(broken) == (0.0,) * 7


def test_sign_changes(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 2, 2, 1, 3, 3, 2])], "uid int, t int, v double")
    assert H.sign_changes(df, "t", "v", "uid").first().sign_changes == 3


def test_syndromes(spark):
    v = F.array(*map(F.lit, [1.0, 1.1, -1.0, -1.1, 0.0, 0.0, 0.0, 0.0]))
    assert list(one(spark, x=scalars.ternary(v)).x) == [0, 1, 0, -1, 0, 0, 0, 0]
    df = spark.createDataFrame([(1, "0,0,0,0,0,0,0,0"), (2, "0,1,0,-1,0,0,0,0")], "k int, signature string")
    assert [r["class"] for r in C.classified(df, "k").orderBy("k").collect()] == ["self", "unclassified"]


def test_cliques():
    assert N.greedy_cliques([(1, 2), (1, 3), (2, 3), (3, 4)]) == [[1, 2, 3]]
    assert N.greedy_cliques([(1, 2), (2, 3), (3, 4)]) == []


def test_percentile_scores(spark):
    base = spark.createDataFrame([(-3.0,), (-2.0,), (-1.0,), (0.0,)], "x double")
    values = spark.createDataFrame([(1, -1.5), (2, -4.0), (3, 1.0)], "id long, x double")
    got = {r.id: r.score for r in D.percentile_score(values, base, "x").collect()}
    assert got == {1: pytest.approx(0.5), 2: pytest.approx(1.0), 3: pytest.approx(2 / 3)}


def test_weights(spark):
    w = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.25), (0, 3, 0.0)], "step int, uid long, weight double")
    assert {r.uid: r.u16 for r in N.emitted_weights(w, "step").collect()} == {1: 65535, 2: 32768}
    rng = random.Random(1)
    big = spark.createDataFrame([(0, i, rng.random() ** 4) for i in range(60)], "step int, uid long, weight double")
    capped = [r.weight for r in N.capped_weights(big, 0.05, "step").collect()]
    assert sum(capped) == pytest.approx(1) and max(capped) <= 0.05 + 1e-6


def test_challenge_key(spark):
    assert one(spark, x=scalars.hash_int(F.lit("a:b:1"))).x == 1825471671


def test_cooldown_and_rate_limit(spark):
    a = spark.createDataFrame([(1, s) for s in (11, 15, 21, 22)], "uid long, step long")
    assert sorted(r.step for r in H.cooled_alerts(a, 10, "uid").collect()) == [11, 22]
    c = spark.createDataFrame([("k", t) for t in (0.0, 1.0, 2.0, 3.0, 10.0, 10.5)], "k string, t double")
    assert tuple(H.admitted_calls(c, 2, 10.0, "k").first())[1:] == (3, 3)


def test_trust_score(spark):
    w = spark.createDataFrame([(1, 0.75), (2, 0.25)], "uid long, weight double")
    r = spark.createDataFrame([(0, 1, 0.2, None), (0, 2, 0.8, None), (1, 1, None, None)], "q long, uid long, score double, confidence double")
    got = {x.q: (x.score, x.confidence, x.n) for x in N.trust_score(r, w, 5, "q").collect()}
    assert got[0][0] == pytest.approx(0.35) and got[1] == (0.5, 0.0, 0)


def test_chain_detects_tampering(spark):
    rewards = spark.createDataFrame([(u, r, (u + r) / 10) for u in range(3) for r in range(4)], "uid long, round long, reward double")
    log = C.replay(rewards, "round")
    assert C.verify(log).where("not ok").count() == 0
    C.assert_intact(log)
    rows = [r.asDict(recursive=True) for r in log.orderBy("round_index").collect()]

    def damaged(change):
        copy = [dict(r, scores=[dict(s) for s in r["scores"]]) for r in rows]
        return spark.createDataFrame(change(copy) or copy, C.RECORD)

    def mutate(rs):
        rs[2]["scores"][0]["raw_reward"] += 1e-9

    def swap(rs):
        rs[1]["round_index"], rs[2]["round_index"] = 2, 1

    for change in (mutate, swap, lambda rs: rs[:1] + rs[2:], lambda rs: rs[1:]):
        with pytest.raises(C.IntegrityError):
            C.assert_intact(damaged(change))
    with pytest.raises(ValueError):
        C.canonical({"a": math.nan})
    assert C.canonical({"b": 1e-05, "a": "é"}) == '{"a":"é","b":1e-05}'


def test_adaptive_weights_keep_sum_and_bounds():
    rng = random.Random(3)
    w = [1 / 3] * 3
    for _ in range(200):
        w = C.adapt(w, [rng.random() for _ in w], rng.choice([-1, 1]))
        assert sum(w) == pytest.approx(1) and all(0.049 <= x <= 0.501 for x in w)
    assert C.adapt([1.0], [0.3], 1) == [1.0]


def test_perturbations_change_and_repeat():
    t = "the data is a very large error and the method can show the study"
    for seed in range(12):
        assert perturb.perturb(t, seed, 5) == perturb.perturb(t, seed, 5)
    assert perturb.synonyms(t, random.Random(1)) != t and perturb.deletion(t, random.Random(1)) != t
    assert perturb.reorder("x y and z", random.Random(1)) == "z and x y" and perturb.reorder("a b c", random.Random(1)) == "c b a"
    assert all(perturb.perturb("", s) == "" for s in range(3))


def test_threshold_search_equals_brute_force(spark):
    rng = random.Random(9)
    rows = [(1, round(rng.random(), 2), rng.random() < 0.4) for _ in range(60)]
    best = M.threshold_search(spark.createDataFrame(rows, "k int, s double, y boolean"), "s", "y", "k").first()

    def worth(t):
        tp = sum(y for _, s, y in rows if s >= t)
        fp = sum(not y for _, s, y in rows if s >= t)
        fn = sum(y for _, s, y in rows if s < t)
        return round(0.7 * (tp / (tp + fp) if tp + fp else 0) + 0.3 * (tp / (tp + fn) if tp + fn else 0), 9)

    ss = sorted({s for _, s, _ in rows})
    cand = sorted({0.5, *ss, *((a + b) / 2 for a, b in zip(ss, ss[1:]))})
    assert best.reward == max(map(worth, cand)) == worth(best.threshold)


def test_files(spark, tmp_path):
    (tmp_path / "samples.json").write_text('{"samples": [{"id": "a-1", "prompt": "p", "output": "o", "domain": "bio"}, {"id": "a-2", "prompt": "", "output": "x", "domain": "bio"}]}')
    (tmp_path / "manifest.json").write_text('{"a-1": {"ground_truth_label": "normal", "ground_truth_type": null, "is_honeypot": false}, "a-3": {"ground_truth_label": "anomalous", "ground_truth_type": "t", "is_honeypot": true}}')
    base = f"file://{tmp_path}"
    s, m = files.samples_json(spark, f"{base}/samples.json"), files.manifest_json(spark, f"{base}/manifest.json")
    assert [r.id for r in files.training_samples(s, m).collect()] == ["a-1"]
    assert len(files.dataset_version(spark, f"{base}/samples.json")) == 12
    assert {(r.id, r.issue) for r in files.cross_check(s, m).collect()} == {("a-2", "sample_without_manifest"), ("a-3", "manifest_without_sample")}
    rewards = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.7)], "uid long, round long, reward double")
    files.write_log(C.replay(rewards, "round"), f"{base}/log")
    assert C.verify(files.read_log(spark, f"{base}/log")).where("not ok").count() == 0
    (tmp_path / "log" / "part-x.json").write_text("{broken\n")
    with pytest.raises(C.IntegrityError):
        files.read_log(spark, f"{base}/log")
    merged = files.merge_manifests(m, m.where("id = 'a-1'").withColumn("ground_truth_label", F.lit("anomalous")))
    assert {r.id: r.ground_truth_label for r in merged.collect()} == {"a-1": "anomalous", "a-3": "anomalous"}
    conf = files.settings({"a": {"b": 1, "c": 2}}, cli={"a.b": 5}, defaults={"a.c": 0, "a.d": 9})
    assert conf == {"a.b": 5, "a.c": 2, "a.d": 9}
