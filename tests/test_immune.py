"""Queries without SQL against plain versions over all of their rows."""

import math
from collections import Counter

import numpy as np
from veracel.functions import text
from veracel.operators import detect
from veracel.plans import immune_queries as I
from veracel.plans.registry import QUERIES
from veracel.sources.tables import manifest, samples

SF = "/root/testdata/sf0.001"


def plain_higuchi(signal, longest=10):
    n, points = len(signal), []
    if n < longest:
        return 1.5
    for k in range(1, longest + 1):
        lengths = []
        for m in range(1, k + 1):
            steps = (n - m) // k
            if steps >= 1:
                total = sum(abs(signal[m - 1 + i * k] - signal[m - 1 + (i - 1) * k]) for i in range(1, steps + 1))
                lengths.append(total * (n - 1) / (steps * k) / k)
        if lengths and sum(lengths) > 0:
            points.append((math.log(1 / k), math.log(sum(lengths) / len(lengths))))
    if len(points) < 2:
        return 1.5
    mx, my = (sum(p[i] for p in points) / len(points) for i in (0, 1))
    slope = sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points)
    return min(2.0, max(1.0, slope))


def plain_entropy(values):
    counts = Counter(values)
    n = sum(counts.values())
    return -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0


def test_fractal_vector_equals_its_definition(spark):
    got = {r.id: r for r in QUERIES["fractal_features"](spark, SF).collect()}
    for s in samples(spark, SF).select("id", "output").collect():
        words = s.output.split()
        if not words:
            want = (1.5, 1.5, 0.5, 0.5, 0, 0, 0, 0)
        else:
            by_words = plain_higuchi([len(w) for w in words])
            want = (plain_higuchi([s.output.count(c) for c in sorted(set(s.output))]), by_words, 0.5, 0.5, plain_entropy(s.output), plain_entropy(words), plain_entropy(list(zip(words, words[1:]))), by_words - 1)
        assert np.allclose([got[s.id][c] for c in text.FRACTAL], want, atol=1e-6), s.id


def test_forest_scores_equal_a_walk_down_each_tree():
    rng = np.random.default_rng(1)
    x = rng.random((500, 4)).round(2)
    x[:, 3] = 1
    forest = detect.Forest(x, 20, 64, 3)

    def depth(tree, row):
        feature, cut, low, high, leaf = tree
        at = 0
        while feature[at] >= 0:
            at = low[at] if row[feature[at]] < cut[at] else high[at]
        return leaf[at]

    want = [2 ** (-np.mean([depth(t, row) for t in forest.trees]) / detect._usual(64)) for row in x]
    assert np.allclose(forest.score(x), want)
    outlier = np.vstack([x, [[9, 9, 9, 1]]])
    assert detect.Forest(outlier, 100, 256, 3).score(outlier).argmax() == 500
    assert all(not (t[0] == 3).any() for t in forest.trees)  # a constant column never cuts


def place(raw, base):
    """Score of a raw value among sorted baseline values."""
    n, idx = len(base), sum(b <= raw for b in base)
    if 0 < idx < n:
        return 1 - idx / n
    spread = base[-1] - base[0]
    return 0.5 if spread < 1e-10 else min(1.0, abs(raw - base[n // 2]) / spread)


def test_pack_scores_place_each_sample_among_normal_ones(spark):
    s, normal = samples(spark, SF), {r.sid for r in manifest(spark, SF).where("truth = 'normal'").collect()}
    got = {r.id: r for r in QUERIES["pack_scores"](spark, SF).collect()}
    assert set(got) == {r.id for r in s.collect()}
    for domain, columns in I.PACKS.items():
        f = I.pack_features(s, domain).cache()
        own = f.where(f.id.isin(*normal))
        forest = detect.fit_forest(own, columns)
        rows = f.collect()
        raw = np.round(-forest.score(np.array([[float(r[c]) for c in columns] for r in rows])), 9)
        base = sorted(v for r, v in zip(rows, raw) if r.id in normal)
        for r, v in zip(rows, raw):
            score = place(v, base)
            assert abs(got[r.id].score - score) < 1e-6 and got[r.id].domain == domain
            assert abs(got[r.id].confidence - min(1.0, abs(score - 0.5) * 2)) < 2e-6 and got[r.id].flagged == (score >= 0.5)


def plain_setting(r, z, pamp_at, alpha):
    """gated, state and score of one sample's features and detector scores."""
    clip = lambda v: min(1.0, max(0.0, v))
    pamp, danger = clip(r.pamp_score), clip((r.exaggeration + r.controversy + r.claim_density) / 3)
    safe = clip(0.2 * (r.citation_count + r.hedging_ratio + r.numeric_density + r.certainty + r.specificity))
    state = "mature" if pamp >= pamp_at else "immature" if safe > pamp + danger else "semi-mature"
    flat = (r.iforest + r.negsel + r.pack) / 3 if state == "mature" else r.negsel
    return any(x.z > z for x in r.z), state, clip(flat + (1 - flat) * max(r.pamp_score, r.danger_signal) * alpha)


def test_pipeline_and_sweep_equal_plain_versions(spark):
    rows = I.scored_features(spark, SF).collect()
    truth = {r.sid: r.truth == "anomalous" for r in manifest(spark, SF).collect()}
    settings = {r.domain: r for r in QUERIES["domain_settings"](spark, SF).collect()}
    assert settings["code_security"].z_threshold == 5.0 and settings["bio"].z_threshold == 3.0 and settings["bio"].danger_alpha == 0.0
    made = {}
    for r in rows:
        c = settings[r.domain]
        made[r.id] = (r.domain, *plain_setting(r, c.z_threshold, c.pamp_threshold, c.danger_alpha))
    seen = {}
    for i, (domain, _, state, _) in made.items():
        if i in truth:
            seen.setdefault((domain, state), []).append(truth[i])
    got = {r.id: r for r in QUERIES["tiered_pipeline"](spark, SF).collect()}
    assert set(got) == set(made)
    for i, (domain, gated, state, score) in made.items():
        if gated:
            want = 1.0
        elif (domain, state) in seen:
            want = 0.8 * score + 0.2 * np.mean(seen[domain, state])
        else:
            want = score
        assert got[i].state == state and got[i].gated == gated and abs(got[i].score - want) < 2e-6
        assert got[i].tier == ("iforest,negsel,pack" if state == "mature" else "negsel")

    sweep = {(r.z, r.pamp, r.alpha): (r.tp, r.fp, r.fn, r.tn) for r in QUERIES["tuning_sweep"](spark, SF).collect()}
    assert len(sweep) == 80
    for (z, pamp, alpha), counts in sweep.items():
        want = Counter()
        for r in rows:
            if r.id in truth:
                gated, _, score = plain_setting(r, z, pamp, alpha)
                want[gated or round(score, 9) >= 0.5, truth[r.id]] += 1
        assert counts == (want[True, True], want[True, False], want[False, True], want[False, False])


def test_gates_equal_plain_metrics(spark):
    truth = {r.sid: r.truth == "anomalous" for r in manifest(spark, SF).collect()}
    rows = [r for r in QUERIES["tiered_pipeline"](spark, SF).collect() if r.id in truth]
    got = {(r.domain, r.gate.split(" ", 1)[1]): (r.actual, r.passed) for r in QUERIES["regression_gates"](spark, SF).collect()}
    assert len(got) == 24
    for domain in {r.domain for r in rows}:
        own = [r for r in rows if r.domain == domain]
        y = [truth[r.id] for r in own]
        scores = {"flat": [r.ensemble for r in own], "v8": [1.0 if r.gated else r.modulated for r in own], "v9": [r.score for r in own]}

        def f1(v):
            tp, fp, fn = (sum(1 for s, t in zip(scores[v], y) if (s >= 0.5, t) == k) for k in ((True, True), (True, False), (False, True)))  # noqa: B023
            return round(2 * tp / (2 * tp + fp + fn), 4) if tp else 0.0

        mean = lambda v, kind: round(float(np.mean([s for s, t in zip(scores[v], y) if t == kind] or [0.0])), 4)  # noqa: B023, E731
        a, b = (np.bincount([min(int(s * 20), 19) for s in scores[v]], minlength=20) / len(own) + 1e-10 for v in ("flat", "v8"))
        both = [k for k in range(20) if a[k] > 1e-9 or b[k] > 1e-9]
        kl = sum(a[k] * math.log(a[k] / b[k]) for k in both)
        want = {
            "F1 against the flat ensemble": (f1("v8") - f1("flat"), round(f1("flat") - f1("v8"), 4) <= 0.02), "KL divergence": (kl, round(kl, 4) < 0.5),
            "mean of normal samples": (mean("v8", False), 0 <= mean("v8", False) <= 0.3),
            "mean of anomalous samples against the flat ensemble": (mean("v8", True) - mean("flat", True), round(mean("flat", True) - mean("v8", True), 4) <= 0.02),
            "F1 with memory against without": (f1("v9") - f1("v8"), round(f1("v8") - f1("v9"), 4) <= 0.02), "mean of normal samples with memory": (mean("v9", False), 0 <= mean("v9", False) <= 0.3),
        }
        for gate, (actual, passed) in want.items():
            assert abs(got[domain, gate][0] - actual) < 2e-4 and got[domain, gate][1] == passed, (domain, gate)
