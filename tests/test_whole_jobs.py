"""Queries that once saw a part of their rows, against plain versions over all of them."""

import hashlib
import json
from collections import defaultdict

import numpy as np
import pytest
from compare import rows_of, rows_of_sql
from pyspark.sql import functions as F
from veracel.functions import scalars
from veracel.operators import chain as C
from veracel.operators import history as H
from veracel.operators import network as N
from veracel.plans import network_queries as NQ
from veracel.plans.registry import QUERIES, SQL
from veracel.sources.tables import read, responses, spread

SF = "/root/testdata/sf0.001"


def test_local_outliers_use_all_vectors(spark):
    rows = sorted((r.vec_id, r.embedding) for r in read(spark, SF, "embeddings").select("vec_id", "embedding").collect())
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).round(6)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :5]
    dist = np.take_along_axis(d, near, 1)
    density = 1 / (np.maximum(dist, dist[:, -1][near]).mean(1) + 1e-10)
    lof = density[near].mean(1) / density
    got = {r.qid: r.lof for r in QUERIES["local_outliers"](spark, SF).collect()}
    assert set(got) == {i for i in ids if i % 20 == 0}
    assert all(abs(got[i] - v) < 2e-4 for i, v in zip(ids, lof) if i in got)


def test_hotkey_changes_cover_all_rounds(spark):
    seen = {}
    for r in responses(spark, SF).select("round", "uid").distinct().collect():
        seen.setdefault(r.round, set()).add(r.uid)
    want, rounds = set(), sorted(seen)
    for a, b in zip(rounds, rounds[1:]):
        for side, uids in (("new", seen[b] - seen[a]), ("removed", seen[a] - seen[b]), ("both", seen[a] & seen[b])):
            want |= {(b, side, u) for u in uids}
    got = [tuple(r) for r in QUERIES["hotkey_changes"](spark, SF).collect()]
    assert len(rounds) > 2 and len(got) == len(want) and set(got) == want


def plain_log(rewards, alpha=0.1):
    """Round records of (uid, round, reward), written one after the other."""
    ema, prev, out = defaultdict(float), "0" * 64, []
    for index, at in enumerate(sorted({r for _, r, _ in rewards})):
        scores = []
        for uid, _, reward in sorted(x for x in rewards if x[1] == at):
            ema[uid] = alpha * reward + (1 - alpha) * ema[uid]
            scores.append({"ema_score": ema[uid], "hotkey": f"hk{uid}", "raw_reward": reward, "uid": uid})
        record = {"ema_alpha": alpha, "prev_hash": prev, "round_index": index, "scores": scores}
        digest = hashlib.sha256(json.dumps(record, separators=(",", ":")).encode()).hexdigest()
        out.append((index, len(scores), prev, digest))
        prev = digest
    return out


@pytest.mark.parametrize("piece", [1, 1 << 16])
def test_chain_equals_plain_log(spark, monkeypatch, piece):
    monkeypatch.setattr(C, "PIECE_CHARS", piece)
    rewards = [tuple(r) for r in NQ._rewards(spark, SF).select("uid", "round", "reward").collect()]
    log = QUERIES["chain_replay"](spark, SF)
    want = plain_log(rewards)
    assert sorted(tuple(r) for r in log.select("round_index", "n_scores", "prev_hash", "hash").collect()) == want
    rows = C.entries(NQ._rewards(spark, SF), "round")
    assert C.verified(log, rows).where("not ok").count() == 0
    wrong = rows.withColumn("body", F.when(F.col("round_index") == 1, F.lit("{}")).otherwise(F.col("body")))
    assert {(r.round_index, r.reason) for r in C.verified(log, wrong).where("not ok").collect()} == {(1, "hash_mismatch"), (2, "broken_link")}
    lost = rows.where("round_index <> 1")
    assert (1, "hash_mismatch") in {(r.round_index, r.reason) for r in C.verified(log, lost).where("not ok").collect()}


def test_collusion_groups_equal_greedy_cliques(spark):
    by_uid = defaultdict(dict)
    for r in NQ._by_uid(spark, SF).collect():
        by_uid[r.uid][r.sid] = r.score
    edges, uids = [], sorted(by_uid)
    for i, a in enumerate(uids):
        for b in uids[i + 1:]:
            both = sorted(set(by_uid[a]) & set(by_uid[b]))
            x, y = (np.array([by_uid[u][s] for s in both]) for u in (a, b))
            if len(both) >= 3 and round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 9) >= 0.9:
                edges.append((a, b))
    want = {(g[0], u) for g in N.greedy_cliques(edges) for u in g}
    assert edges and {tuple(r) for r in QUERIES["collusion_groups"](spark, SF).collect()} == want


def test_similar_pairs_with_a_sample_all_answered(spark):
    rng = np.random.default_rng(4)
    rows = [(u, s, float(rng.random())) for u in range(40) for s in [0, 1, *range(2 + u % 9, 9 + u % 9)]]
    got = {(r.a, r.b): (r.shared, r.cosine) for r in N.similar_pairs(spark.createDataFrame(rows, "uid long, sid long, score double"), 0.8, 4).collect()}
    of = defaultdict(dict)
    for u, s, x in rows:
        of[u][s] = x
    want = {}
    for a in range(40):
        for b in range(a + 1, 40):
            both = sorted(set(of[a]) & set(of[b]))
            x, y = (np.array([of[u][s] for s in both]) for u in (a, b))
            c = float(x @ y / np.sqrt((x @ x) * (y @ y)))
            if len(both) >= 4 and c >= 0.8:
                want[a, b] = (len(both), pytest.approx(c))
    assert want and got == want


def test_rate_limit_equals_plain_fold(spark):
    calls = defaultdict(list)
    for r in read(spark, SF, "events").select("user_id", F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01', ts)").alias("t")).collect():
        calls[r.user_id].append(r.t)
    want = set()
    for u, ts in calls.items():
        live, passed = [], 0
        for t in sorted(ts):
            live = [x for x in live if x > t - 86400]
            if len(live) < 3:
                live.append(t)
                passed += 1
        want.add((u, passed, len(ts) - passed))
    assert {tuple(r) for r in QUERIES["rate_limit"](spark, SF).collect()} == want


def test_folds_on_odd_keys(spark):
    rows = [(None, 1, 1.0), (None, 2, None), (3, 1, float("nan")), (3, 2, 2.0)]
    df = spark.createDataFrame(rows, "uid long, round long, reward double")
    got = {(r.uid, r.round): r.ema for r in H.ema(df, "round", "reward", "uid").collect()}
    assert got == {(None, 1): pytest.approx(0.1), (None, 2): pytest.approx(0.09), (3, 1): 0.0, (3, 2): pytest.approx(0.2)}
    assert H.ema(df.limit(0), "round", "reward", "uid").count() == 0
    steps = spark.createDataFrame([(None, 5), (None, 5), (None, 30), (1, 7), (1, None)], "uid long, step long")
    assert sorted(map(str, (tuple(r) for r in H.cooled_alerts(steps, 10, "uid").collect()))) == ["(1, 7)", "(None, 30)", "(None, 5)"]
    lines = spark.createDataFrame([(None, "b"), (None, "a"), (2, "c")], "k long, line string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {tuple(r) for r in H.digests(lines, "k", "line").collect()} == {(None, sha("a,b"), 2), (2, sha("c"), 1)}
    assert sorted((r.x, r.at) for r in H.numbered(spark.range(0, 5000, 7).withColumnRenamed("id", "x"), "x", "at").collect()) == [(x, i) for i, x in enumerate(range(0, 5000, 7))]


def test_spread_keeps_rows(spark):
    rows = spark.createDataFrame([(None, "x"), (1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    few, many = rows.coalesce(1), rows.repartition(64)
    assert sorted(map(str, spread(few, "doc_id").collect())) == sorted(map(str, rows.collect()))
    assert spread(few, "doc_id").rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert spread(many, "doc_id") is many and spread(few.limit(0), "doc_id").count() == 0


def test_weights_and_their_quantile_are_computed_once(spark, tmp_path):
    """A sum made twice may differ in its last bit; then the weights at the quantile were under it."""
    rows = [(i, i // 2 % 900 if i % 7 else None, "O", float(100 + i // 120 % 30) + 0.1 * (i % 3), None if i == 5 else f"1995-0{1 + i % 2}-03", "x") for i in range(1800)]
    names = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, day string, o_orderpriority string"
    orders = spark.createDataFrame(rows, names).where("o_custkey is not null").withColumn("o_orderdate", F.col("day").cast("timestamp_ntz"))
    orders.drop("day").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["processed_weights"](spark, str(tmp_path))
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    assert rows_of(got) == rows_of_sql(SQL["processed_weights"], str(tmp_path))


@pytest.mark.parametrize("most", [0, 3, 200_000])
def test_term_weights_of_repeated_and_missing_ids(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(scalars, "FREQUENT_WORDS", most)
    monkeypatch.setattr(scalars, "PART_CHARS", 40)
    rows = [(1, "a b b  c"), (1, "b d A"), (None, "a rare one"), (None, "c c"), (2, None), (3, ""), (4, "b c d e f g")]
    docs = [(i, t, "en", "x", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(QUERIES["tfidf_terms"](spark, str(tmp_path)))
    words = [(r.id, r.word) for r in QUERIES["tfidf_terms"](spark, str(tmp_path)).where("id is null").collect()]
    assert sorted(w for _, w in words) == ["a", "c", "one", "rare"] and len(got[1]) > 20
    assert got == rows_of_sql(SQL["tfidf_terms"], str(tmp_path))
