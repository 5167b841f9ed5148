"""Rules over report files, sections under one envelope, text exposition, policies and the batch entry points."""

import json
import statistics as st
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from veracel.operators import artifacts as A
from veracel.operators.metrics import resolved_policy
from veracel.plans import artifact_queries as Q

REPO = Path(__file__).resolve().parent.parent


def test_rules(spark):
    rules = [
        A.Rule("version", "$.version", "equals", "2"), A.Rule("owner", "$.meta.owner", "required"), A.Rule("kind", "$.kind", "one_of", ("a", "b")), A.Rule("low", "$.n", "at_least", 1),
        A.Rule("high", "$.n", "at_most", 5), A.Rule("agree", "$.n", "same_as", "$.meta.n"), A.Rule("terms", "$", "without", "Secret"), A.Rule("title", "$.title", "without", "draft"),
    ]
    docs = {
        "good": {"version": 2, "kind": "a", "n": 3, "meta": {"owner": "x", "n": 3}}, "none": {}, "far": {"version": "2", "kind": "c", "n": 9, "meta": {"owner": None, "n": 8}, "note": "a SECRET", "title": "Draft 1"},
    }
    rows = [(k, json.dumps(v)) for k, v in docs.items()] + [("list", "[1]"), ("torn", '{"version": 2'), ("null", None)]
    table = spark.createDataFrame(rows, "artifact string, json string")
    got = {}
    for r in A.violations(table, rules).collect():
        got.setdefault(r.artifact, []).append((r.place, r.rule))
    names = {k: [n for _, n in sorted(v)] for k, v in got.items()}
    assert names == {
        "none": ["version", "owner", "kind", "low", "high", "agree"], "far": ["owner", "kind", "high", "agree", "terms", "title"], "list": ["not_json"], "torn": ["not_json"], "null": ["not_json"],
    }
    assert {r.artifact: r.rule for r in A.first_violations(table, rules).collect()} == {k: v[0] for k, v in names.items()}
    with pytest.raises(ValueError):
        A.violations(table, [A.Rule("x", "$.a", "like")])


def test_sections_under_one_envelope(spark, tmp_path):
    (tmp_path / "detectors.json").write_text(json.dumps([{"name": "a"}, {"name": "b"}], indent=1))
    (tmp_path / "runs-bio.json").write_text(json.dumps({"f1": 0.5}))
    (tmp_path / "runs-code.json").write_text(json.dumps({"f1": 0.7, "n": 3}))
    rows = A.combined(spark, {"detectors": f"{tmp_path}/detectors.json", "pipeline": f"{tmp_path}/pipeline.json", "runs": f"{tmp_path}/runs-*.json"}, r"([^/-]+)\.json$")
    assert sorted((r.section, r.part, r.entries) for r in rows.collect()) == [("detectors", "detectors", 2), ("runs", "bio", 1), ("runs", "code", 2)]
    got = json.loads(A.envelope(rows, "9").first().value)
    assert got["version"] == "9" and got["immutable"] and set(got["sections"]) == {"detectors", "runs"}
    assert json.loads(got["sections"]["runs"]["code"]["data"]) == {"f1": 0.7, "n": 3}
    assert A.combined(spark, {"x": f"{tmp_path}/no-*.json"}).count() == 0


def test_exposition_round_trip(spark):
    text = ["# HELP up is it up", "# TYPE up gauge", "", 'up{host="a",path="C:\\\\x",say="\\"hi\\"\\n"} 1', "up 0.5 1700000000", "odd{} +Inf", "nan NaN", "not a sample at all }", 'esc{v="a,b=\\"c\\"} 2"} 3e2']
    got = {(r.metric, tuple(sorted((r.labels or {}).items()))): (r.value, r["at"]) for r in A.exposed(spark.createDataFrame([(t,) for t in text], "value string")).collect()}
    assert got["up", (("host", "a"), ("path", "C:\\x"), ("say", '"hi"\n'))] == (1.0, None)
    assert got["up", ()] == (0.5, 1700000000) and got["odd", ()][0] == float("inf") and got["nan", ()][0] != got["nan", ()][0]
    assert got["esc", (("v", 'a,b="c"} 2'),)] == (300.0, None) and (None, ()) in got
    rows = [("m", {"b": 'x"\\\n', "a": "1"}, 2.0), ("n", {}, float("-inf")), ("o", None, 0.25)]
    table = spark.createDataFrame(rows, "metric string, labels map<string,string>, value double")
    lines = [r.value for r in A.exposition(table).collect()]
    assert lines == ['m{a="1",b="x\\"\\\\\\n"} 2.0', "n -Inf", "o 0.25"]
    back = {r.metric: (r.labels, r.value) for r in A.exposed(A.exposition(table)).collect()}
    assert back == {"m": (rows[0][1], 2.0), "n": ({}, float("-inf")), "o": ({}, 0.25)}


def test_policies():
    assert resolved_policy({}) == {"mode": "operator_multiband", "high": 0.5, "low": 0.493536, "min_confidence": 0.6}
    assert resolved_policy({"reward.decision_threshold": 0.7}) == {"mode": "global_threshold", "high": 0.7, "low": 0.7, "min_confidence": 0.0}
    assert resolved_policy({"reward.decision_threshold": 0.7, "policy.mode": "GLOBAL_THRESHOLD"}) == {"mode": "global_threshold", "high": 0.5, "low": 0.5, "min_confidence": 0.0}
    assert resolved_policy({"policy.high_threshold": 0.9, "validator.policy.high_threshold": 0.8, "validator.policy.low_threshold": 0.1, "policy.mode": "odd"}) == {"mode": "operator_multiband", "high": 0.9, "low": 0.1, "min_confidence": 0.6}


def test_spike_against_a_plain_version(spark):
    rows = [(d, (i * 7 % 10) / 10, (i * 3 % 10) / 10, (i * 9 % 11) / 10, i % 3 == 0) for d in ("x", "y") for i in range(40 if d == "x" else 15)]
    got = {(r.domain, r.aggregator): r for r in Q.spike(spark.createDataFrame(rows, "domain string, a double, b double, c double, actual boolean")).collect()}
    for d in ("x", "y"):
        f1s = {}
        for name, of in (("control", lambda a, b, c: (a + b) / 2), ("mean3", lambda a, b, c: (a + b + c) / 3), ("median3", lambda a, b, c: st.median((a, b, c)))):
            mine = [r for r in rows if r[0] == d]
            said = [round(of(*r[1:4]), 9) >= 0.5 for r in mine]
            then = [round(of(r[1], r[2], r[3] if name == "control" else 1.0), 9) >= 0.5 for r in mine]
            tp, fp, fn = (sum(1 for s, r in zip(said, mine) if (s, r[4]) == k) for k in ((True, True), (True, False), (False, True)))
            f1s[name] = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
            r = got[d, name]
            assert (r.n, r.flips) == (len(mine), sum(a != b for a, b in zip(said, then))) and r.f1 == pytest.approx(f1s[name], abs=1e-4)
            assert r.f1_delta == pytest.approx(f1s[name] - f1s["control"], abs=2e-4)


def test_batch_entry_points(tmp_path):
    (tmp_path / "s.toml").write_text('[policy]\nmode = "global_threshold"\nhigh_threshold = 0.8\n')
    call = lambda *args: subprocess.run([sys.executable, "-m", "veracel", *args], cwd=REPO, capture_output=True, text=True, timeout=300)
    assert "nearest_vectors" in call("list").stdout.split()
    assert json.loads(call("settings", str(tmp_path / "s.toml")).stdout)["policy"] == {"mode": "global_threshold", "high": 0.8, "low": 0.8, "min_confidence": 0.0}
    assert call("run", "no_such", "--input", "x", "--output", "y").returncode == 2
    done = call("run", "event_slopes", "--input", "/root/testdata/sf0.001", "--output", str(tmp_path / "out"))
    assert done.returncode == 0 and list((tmp_path / "out" / "event_slopes").glob("part-*.parquet")), done.stderr[-500:]
