"""Rules over settings documents, over samples and their manifest, and diversity under the rules of history."""

import json
import math
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from veracel.operators import network as N
from veracel.operators import settings_rules as S
from veracel.operators.sample_rules import sample_issues


def _at(path, value):
    """A document with one setting."""
    for name in reversed(path.split(".")):
        value = {name: value}
    return value


def _issues(spark, docs):
    table = spark.createDataFrame([(str(i), d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "artifact string, json string")
    got = [[] for _ in docs]
    for r in S.issues(table).collect():
        got[int(r.artifact)].append((r.level, f"{r.section}.{r.key}", r.message))
    return got


@pytest.mark.parametrize("known,before", [(S.KNOWN, ""), (S.OF_DOMAIN, "miner.orchestrator.domains.bio.")])
def test_every_bound_of_every_setting(spark, known, before):
    docs, want = [], []
    for key, kind, bounds in S._lines(known):
        good, bad = [], []
        if kind in ("int", "number"):
            bad += ["x", True, {"a": 1}]
            low, high = bounds[1:-1].split(",")
            (good if bounds[0] == "[" else bad).append(int(low))
            bad.append(int(low) - 1)
            (bad if kind == "int" else good).append(0.5)
            if high:
                (good if bounds[-1] == "]" else bad).append(int(high))
                bad.append(int(high) + 1)
            else:
                good.append(10**6)
        elif kind == "bool":
            good, bad = [True, False], ["true", 1]
        elif kind == "text":
            good, bad = ([*bounds.split("|")], ["other", 1]) if bounds else (["/a/b"], [1, True])
        else:
            good = [1, "x", True]
        docs += [_at(before + key, v) for v in good + bad]
        want += [(before + key, False)] * len(good) + [(before + key, True)] * len(bad)
    for doc, found, (key, wrong) in zip(docs, _issues(spark, docs), want):
        assert [(lv, k) for lv, k, _ in found if lv == "error"] == ([("error", key)] if wrong else []), doc


def test_unknown_keys_conflicts_and_texts_that_are_no_documents(spark):
    bad, low, high = _issues(spark, [
        {"extra": 1, "neuron": {"any": 1}, "api": {"x": 2}, "miner": {"new": 1, "detectors": {"y": 1}, "orchestrator": {"nk": {"zz": 1}, "domains": {"bio": {"q": 1}, "flat": 3}}}, "validator": {"policy": 5}},
        {"validator": {"policy": {"low_threshold": 0.5, "high_threshold": 0.5}}}, {"validator": {"policy": {"low_threshold": 0.6, "high_threshold": 0.5}}},
    ])
    assert sorted(bad) == [("warning", k, "unknown key") for k in ("miner.new", "miner.orchestrator.domains.bio.q", "miner.orchestrator.nk.zz", "root.extra")]
    assert low == [] and high == [("error", "validator.policy.low_threshold", "must be at most high_threshold")]
    danger = lambda **k: {"miner": {"orchestrator": {"danger": k}}}
    got = _issues(spark, [danger(enabled=False, alpha=0.3), danger(enabled=False, alpha=0), danger(enabled=True, alpha=0.3), danger(alpha=0.3), {}, "", None, "[1]", "{torn", "7"])
    assert [len(g) for g in got] == [1, 0, 0, 0, 0, 1, 1, 1, 1, 1]
    assert got[0][0][0] == "warning" and {g[0][:2] for g in got[5:]} == {("error", "file.")}
    assert S.issues(spark.createDataFrame([], "artifact string, json string")).count() == 0


def test_settings_files(spark, tmp_path):
    (tmp_path / "good.toml").write_text("[miner.orchestrator.bcell]\nk = 3\n[validator.scoring]\nmode = 'exact'\nwhen = 2024-01-01\n")
    (tmp_path / "bad.toml").write_text("[validator.rotation]\nwindow = 0\n")
    (tmp_path / "torn.toml").write_text("[validator\n")
    paths = {n: str(tmp_path / n) for n in ("good.toml", "bad.toml", "torn.toml", "none.toml")}
    got = {(r.artifact, r.level, r.section, r.key) for r in S.issues(S.documents(spark, list(paths.values()))).collect()}
    assert got == {(paths["good.toml"], "warning", "validator.scoring", "when"), (paths["bad.toml"], "error", "validator.rotation", "window"), (paths["torn.toml"], "error", "file", ""), (paths["none.toml"], "error", "file", "")}


def _plain_sample_issues(samples, manifest):
    entries, out = {m["id"]: m for m in manifest}, []
    for s in samples:
        i = s["id"]
        out += [(i, f"missing {c}") for c in ("id", "prompt", "output", "domain", "metadata") if s[c] is None]
        if s["domain"] == "code_security" and s["code"] is None:
            out.append((i, "missing code"))
        if i is None:
            continue
        if i not in entries:
            out.append((i, "not in manifest"))
        else:
            e = entries[i]
            out += [(i, f"missing {c}") for c in ("truth", "type", "is_honeypot") if e[c] is None]
            out += [(i, "invalid truth")] * (e["truth"] is not None and e["truth"] not in ("normal", "anomalous"))
            out += [(i, "is_honeypot is no boolean")] * (e["is_honeypot"] is not None and e["is_honeypot"] not in ("true", "false"))
        for c, among in (("difficulty", ("easy", "medium", "hard")), ("source", ("synthetic", "template", "llm"))):
            v = (s["metadata"] or {}).get(c)
            out += [(i, f"missing {c}")] if v is None else [(i, f"invalid {c}")] * (v not in among)
    ids = {s["id"] for s in samples}
    return out + [(m["id"], "orphan") for m in manifest if m["id"] not in ids]


def test_samples_and_manifest(spark):
    base = {"prompt": "p", "output": "", "domain": "bio", "code": None, "metadata": {"difficulty": "easy", "source": "llm"}}
    changes = [
        {}, {"prompt": None}, {"output": None, "domain": None}, {"metadata": None}, {"domain": "code_security"}, {"domain": "code_security", "code": "x"},
        {"metadata": {"difficulty": "extreme", "source": None}}, {"metadata": {"difficulty": None, "source": "web"}},
    ]
    samples = [{"id": f"s{i}", **base, **c} for i, c in enumerate(changes)] + [{"id": None, **base, "metadata": None}, {"id": "s0", **base, "prompt": None}]
    entry = {"truth": "normal", "type": "t", "is_honeypot": "false"}
    manifest = [{"id": f"s{i}", **entry, **c} for i, c in enumerate([{}, {"truth": "odd"}, {"truth": None, "is_honeypot": None}, {"type": None}, {"is_honeypot": "1"}])] + [{"id": "lone", **entry, "truth": None}]
    s = spark.createDataFrame(samples, "id string, prompt string, output string, domain string, code string, metadata struct<difficulty:string,source:string>")
    m = spark.createDataFrame(manifest, "id string, truth string, type string, is_honeypot string")
    got = [(r.id, r.issue) for r in sample_issues(s.withColumn("truth", F.lit(1)), m.withColumn("prompt", F.lit(1))).collect()]
    assert sorted(got, key=str) == sorted(_plain_sample_issues(samples, manifest), key=str)
    assert sample_issues(s.limit(0), m.limit(0)).count() == 0 and {r.issue for r in sample_issues(s.limit(0), m).collect()} == {"orphan"}
    typed = m.where("id = 's0'").withColumn("is_honeypot", F.lit(False))
    assert sample_issues(s.where("id = 's0' and prompt is not null"), typed).count() == 0


def test_diversity_under_the_rules_of_history(spark):
    values = {u: [((u + 1) * (i + 1) * 7 % 13) / 13 for i in range(12)] for u in range(8)} | {8: [0.5] * 9, 9: [0.0] * 12}
    rows = [(u, i, v) for u, vs in values.items() for i, v in enumerate(vs)]
    table = spark.createDataFrame(rows, "uid int, pos int, value double")

    def plain(uid, kept, least, peers):
        own = kept[uid]
        if len(kept) < peers or len(own) < least or not any(own):
            return 0.5
        cos = [sum(a * b for a, b in zip(own, o)) / math.hypot(*own) / math.hypot(*o) for u, o in kept.items() if u != uid and len(o) >= least and any(o)]
        return min(1.0, max(0.0, 1 - max(0.0, *cos))) if cos else 0.5

    for least, peers in ((10, 8), (10, 11), (12, 1), (13, 1)):
        got = {r.uid: r.diversity for r in N.diversity(table, min_history=least, min_uids=peers).collect()}
        assert got == pytest.approx({u: plain(u, values, least, peers) for u in values})
    keyed = table.withColumn("k", F.lit("a")).unionByName(table.where("uid < 3").withColumn("k", F.lit("b")))
    got = {(r.k, r.uid): r.diversity for r in N.diversity(keyed, "k", min_history=10, min_uids=8).collect()}
    assert got == pytest.approx({("a", u): plain(u, values, 10, 8) for u in values} | {("b", u): 0.5 for u in range(3)})


def test_check_settings_entry_point(tmp_path):
    from pathlib import Path

    (tmp_path / "a.toml").write_text("[validator.rotation]\nwindow = 0\n")
    done = subprocess.run([sys.executable, "-m", "veracel", "check-settings", str(tmp_path / "a.toml")], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=120)
    assert done.returncode == 1 and json.loads(done.stdout.strip().splitlines()[-1])["key"] == "window"


def test_trust_answers(spark):
    r = spark.createDataFrame([(0, 1, 0.2, None, "b"), (0, 2, 0.8, 1.0, "a"), (0, 3, None, 1.0, "c"), (0, 4, 0.4, 0.0, "b"), (0, 5, 0.9, 0.9, "z"), (1, 3, None, None, "a"), (2, 6, 0.2, 0.5, None), (2, 7, 0.4, 0.7, "q")], "q long, uid long, score double, confidence double, type string")
    w = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 9.0), (4, 4.0), (5, 0.5), (6, 0.0), (7, 0.0)], "uid long, weight double")
    got = {x.q: x for x in N.trust_answers(r, w, 4, "q").collect()}
    assert (got[0].n, got[0].types, [a.uid for a in got[0].answers]) == (3, ["a", "b"], [4, 1, 2])
    assert got[0].score == pytest.approx((4 * 0.4 + 3 * 0.2 + 0.8) / 8) and got[0].confidence == pytest.approx((0 + 1.5 + 1) / 8)
    assert (got[1].score, got[1].confidence, got[1].n, got[1].types, got[1].answers) == (0.5, 0.0, 0, [], [])
    assert (got[2].score, got[2].confidence, got[2].types) == (pytest.approx(0.3), pytest.approx(0.6), ["q"])
    assert {x.q: (x.score, x.n) for x in N.trust_score(r, w, 4, "q").collect()} == {q: (x.score, x.n) for q, x in got.items()}


def test_call_statuses(spark):
    calls = [("a", t) for t in (0.0, 1.0, 2.0, 3.0, 10.0, 10.5)] + [(None, 1.0)] * 2 + [("x", 1.0)] * 5 + [("b", 7.0)]
    table = spark.createDataFrame(calls, "caller string, t double")
    known = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("idle",)], "caller string")
    got = {tuple(r) for r in N.call_statuses(table, known, 2, 10.0).select("caller", "status", "calls").collect()}
    assert got == {("a", "admitted", 3), ("a", "limited", 3), (None, "missing_caller", 2), ("x", "unregistered", 5), ("b", "admitted", 1)}
    assert N.call_statuses(table.limit(0), known).count() == 0


ROUND = "round_index long, uids array<long>, rewards array<double>, hotkeys array<string>, ema_scores array<double>"


def test_rounds_given_as_lists_are_recorded(spark, tmp_path):
    from veracel.operators import chain
    from veracel.streaming import linked_log as L

    rounds = [(0, [2, 1], [0.5, 0.25], ["b", "a"], None), (1, [1, 2], [0.0, 1.0], ["a", "b"], [0.1, 0.9])]
    log = L.LinkedLog(spark, str(tmp_path / "log"))
    for r in rounds:  # two appends
        log.append(L.linked_scores(L.recorded_scores(spark.createDataFrame([r], ROUND)), log.head()))
    prev = chain.GENESIS
    for i, uids, raw, keys, ema in rounds:
        scores = sorted(({"uid": u, "raw_reward": x, "ema_score": e, "hotkey": k} for u, x, k, e in zip(uids, raw, keys, ema or raw)), key=lambda s: s["uid"])
        prev = chain.record_hash({"round_index": i, "ema_alpha": 0.1, "prev_hash": prev, "scores": scores})
    assert log.head().hash == prev and log.verify(chain.RECORD).where("not ok").count() == 0


@pytest.mark.parametrize("change,reason", [
    ({"round_index": None}, "no_round"), ({"uids": None}, "missing_list"), ({"hotkeys": None}, "missing_list"), ({"rewards": [0.5]}, "lengths_differ"), ({"hotkeys": ["a"]}, "lengths_differ"),
    ({"ema_scores": [0.1, 0.2, 0.3]}, "lengths_differ"), ({"uids": [1, None]}, "missing_key"), ({"hotkeys": ["a", None]}, "missing_key"), ({"rewards": [0.5, math.nan]}, "reward_not_finite"),
    ({"rewards": [0.5, None]}, "reward_not_finite"), ({"rewards": [-math.inf, 1.0]}, "reward_not_finite"), ({"ema_scores": [0.1, math.inf]}, "ema_not_finite"), ({}, None), ({"ema_scores": None}, None),
])
def test_rounds_that_cannot_be_recorded(spark, change, reason):
    from veracel.streaming import linked_log as L

    good = {"round_index": 3, "uids": [1, 2], "rewards": [0.5, 1.0], "hotkeys": ["a", "b"], "ema_scores": [0.1, 0.2]}
    table = spark.createDataFrame([tuple({**good, **change}.values())], ROUND)
    assert L.checked_rounds(table).first().reason == reason
    if reason:
        with pytest.raises(L.IntegrityError, match=reason):
            L.recorded_scores(table)
    else:
        assert L.recorded_scores(table).count() == 2
