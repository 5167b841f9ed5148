"""Text vectors, the detectors over them, the vector index and statistics against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from veracel.functions import statistics
from veracel.functions import vectors as V
from veracel.operators import detect as D
from veracel.operators import models, one_class
from veracel.operators import vector_index as X
from veracel.plans import vector_queries as Q

SF = "/root/testdata/sf0.001"


def plain_vectors(texts: dict, most: int):
    """id to {term: weight} by the plain definition, and the terms in order."""
    grams = {}
    for i, t in texts.items():
        ws = [w for w in re.findall(r"[^\W]{2,}", t.lower()) if w not in V.STOP_WORDS]
        grams[i] = Counter(ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])])
    tf, df = Counter(), Counter()
    for g in grams.values():
        tf.update(g)
        df.update(g.keys())
    terms = sorted(sorted(tf, key=lambda t: (-tf[t], t))[:most])
    out = {}
    for i, g in grams.items():
        w = {t: (1 + math.log(g[t])) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t in g if t in set(terms)}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out[i] = {t: v / norm for t, v in w.items()}
    return out, terms


TEXTS = {
    1: "The quick brown fox jumps over the lazy dog. The fox!", 2: "", 3: "the of and", 4: "Quick quick quick foxes; x y brown fox", 5: "dog_days été ÉTÉ naïve 12 123 dog",
}


@pytest.mark.parametrize("most", [4, 100])
def test_vectors_equal_the_plain_definition(spark, most):
    docs = spark.createDataFrame(list(TEXTS.items()), "id long, text string")
    want, terms = plain_vectors(TEXTS, most)
    voc = V.vocabulary(docs, most)
    names = {r["index"]: r.term for r in voc.collect()}
    assert [names[i] for i in range(len(names))] == terms
    got = {r.id: dict(zip((names[i] for i in r.v["indices"]), r.v["weights"])) for r in V.vectors(docs, voc).collect()}
    assert set(got) == set(TEXTS)
    for i in TEXTS:
        assert got[i] == pytest.approx(want[i])
    v = V.vectors(docs, voc)
    pair = v.alias("a").join(v.alias("b"), F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), V.cosine(F.col("a.v"), F.col("b.v")).alias("c"))
    for r in pair.collect():
        assert r.c == pytest.approx(sum(w * want[r.y].get(t, 0) for t, w in want[r.x].items()), abs=1e-9)


def plain_forest_scores(forest, x):
    out = []
    for row in x:
        depths = []
        for feature, cut, low, high, depth in forest.trees:
            at = 0
            while feature[at] >= 0:
                at = low[at] if row[feature[at]] < cut[at] else high[at]
            depths.append(depth[at])
        out.append(2 ** (-sum(depths) / len(depths) / forest.norm))
    return np.array(out)


def test_text_pack_scores_equal_a_plain_version(spark):
    """The vector and seven features of one domain, its forest, and the place of every score among the normal ones."""
    s = Q._texts(spark, SF).where("domain = 'hallucination'")
    own = Q._normal_ids(s, spark, SF)
    from veracel.plans.immune_queries import PACKS, pack_features
    from veracel.sources.tables import samples

    extra = pack_features(samples(spark, SF), "hallucination").select("id", *PACKS["hallucination"])
    v, width = Q.fitted_vectors(s, own, extra)
    normal = {r.id for r in own.collect()}
    texts = {r.id: r.text for r in s.collect()}
    want, terms = plain_vectors({i: t for i, t in texts.items() if i in normal}, V.MAX_TERMS)
    assert width == len(terms) + 7
    rows = {r.id: Q.matrix([r.v], [r.x], width)[0] for r in v.collect()}
    features = {r.id: [float(r[c]) for c in PACKS["hallucination"]] for r in extra.collect()}
    for i in normal:
        assert {terms[k]: rows[i][k] for k in np.flatnonzero(rows[i][: len(terms)])} == pytest.approx(want[i])
        assert rows[i][len(terms) :].tolist() == pytest.approx(features[i])
    forest = D.Forest(Q._sample(v, own, width, Q.FOREST_ROWS), 100, 256, 5)
    raw = dict(zip(rows, np.round(-plain_forest_scores(forest, np.stack(list(rows.values()))), 9)))
    base = np.sort([raw[i] for i in normal])
    got = {r.id: r.score for r in Q.ranked_forest(v, own, width).collect()}
    for i, r in raw.items():
        k, n = int(np.searchsorted(base, r, "right")), len(base)
        assert got[i] == pytest.approx(1 - k / n if 0 < k < n else min(1, abs(r - base[n // 2]) / (base[-1] - base[0])))
    registered = {r.id: r.score for r in Q.text_pack_scores(spark, SF).where("domain = 'hallucination'").collect()}
    assert registered == {i: round(x, 6) for i, x in got.items()}


def test_one_class_machine_meets_its_conditions():
    rng = np.random.default_rng(1)
    for n, nu in ((40, 0.1), (75, 0.3), (10, 0.05), (1, 0.1)):
        x = rng.normal(size=(n, 5))
        gamma = 1 / (5 * x.var())
        k = one_class.OneClassSvm.kernel(x, x, gamma)
        a, rho = one_class.OneClassSvm.solve(k, nu, 1e-7)
        g = k @ a
        assert a.sum() == pytest.approx(nu * n) and (a >= -1e-12).all() and (a <= 1 + 1e-12).all()
        assert (g[a < 1e-9] >= rho - 1e-5).all() and (g[a > 1 - 1e-9] <= rho + 1e-5).all()
        free = (a > 1e-9) & (a < 1 - 1e-9)
        assert np.abs(g[free] - rho).max(initial=0) < 1e-5
        for _ in range(200):  # no feasible direction lowers the aim
            b = np.clip(rng.random(n), 0, None)
            b = b / b.sum() * nu * n
            if b.max() <= 1:
                assert b @ k @ b >= a @ k @ a - 1e-6
        m = one_class.OneClassSvm.fit(x, nu, gamma)
        plain = [sum(w * math.exp(-m.gamma * sum((p - q) ** 2 for p, q in zip(s, row))) for s, w in zip(m.support, m.weights)) - m.rho for row in x]
        assert m.decision(x) == pytest.approx(plain)
    far = one_class.OneClassSvm.fit(rng.normal(size=(100, 3)))
    assert far.score(np.full((1, 3), 9.0))[0] > 0.9 > far.score(np.zeros((1, 3)))[0]


def test_autoencoder_gradients_and_learning():
    rng = np.random.default_rng(2)
    x, net = rng.random((7, 6)), one_class.Autoencoder.start(6, 5, 4, seed=3)
    for b in net.biases[:3]:
        b += 0.3  # off the kinks
    gw, gb = net.gradients(x)
    loss = lambda: ((net.forward(x)[4] - x) ** 2).mean()
    for params, grads in ((net.weights, gw), (net.biases, gb)):
        for p, g in zip(params, grads):
            for at in list(np.ndindex(p.shape))[::3]:
                was = p[at]
                p[at] = was + 1e-6
                up = loss()
                p[at] = was - 1e-6
                down = loss()
                p[at] = was
                assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-7)
    usual = np.clip(np.outer(rng.random(80), [1, 1, 0, 0, 0, 0]) + 0.02 * rng.random((80, 6)), 0, 1)
    got = one_class.Autoencoder.fit(usual, 16, 4, epochs=300, rate=0.01)
    assert got.error(usual).mean() < one_class.Autoencoder.start(6, 16, 4).error(usual).mean() / 3
    assert got.score(np.array([[0, 0, 0, 1.0, 1.0, 1.0]]))[0] == 1.0


def test_saved_models_score_alike_in_a_second_session(spark, tmp_path):
    rng = np.random.default_rng(4)
    x, cols = rng.random((60, 3)), ("a", "b", "c")
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    forest = D.Forest(x, 20, 32, 1)
    region, base = models.SelfRegion.fit(rows, cols), models.Baseline(x[:, 0])
    svm, net = one_class.OneClassSvm.fit(x), one_class.Autoencoder.fit(x, 8, 3, epochs=5)
    models.save_forest(spark, f"{tmp_path}/forest", forest, cols)
    for name, m in (("region", region), ("base", base), ("svm", svm), ("net", net)):
        m.save(spark, f"{tmp_path}/{name}")
    other, more = spark.newSession(), rng.random((40, 3)) * 2
    again, names = models.load_forest(other, f"{tmp_path}/forest")
    assert names == cols and again.score(more).tolist() == forest.score(more).tolist()
    for name, m in (("region", region), ("svm", svm), ("net", net)):
        assert type(m).load(other, f"{tmp_path}/{name}").score(more).tolist() == m.score(more).tolist()
    assert models.Baseline.load(other, f"{tmp_path}/base").score(more[:, 0]).tolist() == base.score(more[:, 0]).tolist()
    table = other.createDataFrame(rows.collect(), rows.schema)
    assert [r.score for r in models.scored(table, cols, region).orderBy("id").collect()] == region.score(x).tolist()
    with pytest.raises(models.ModelError):
        models.load(other, f"{tmp_path}/svm", "autoencoder")
    other.createDataFrame([(1,)], "x int").write.parquet(f"{tmp_path}/odd")
    with pytest.raises(models.ModelError):
        models.load(other, f"{tmp_path}/odd", "baseline")


def test_self_region_calibration():
    own = np.array([[0.0, 0.0], [0.1, 0.0], [0.0, 0.2], [1.0, 1.0]])
    m = models.SelfRegion(own, ("a", "b"))
    near = [min(math.dist(p, q) for q in own.tolist() if q != p) for p in own.tolist()]
    assert m.radius == pytest.approx(max(0.05, min(2.0, float(np.quantile(near, 0.95)))))
    x = np.array([[0.0, 0.0], [3.0, 0.0], [0.5, 0.5], [9.0, 9.0]])
    plain = [min(1, max(0, min(math.dist(p, q) for q in own.tolist()) - m.radius) / (2 * m.radius)) for p in x.tolist()]
    assert m.score(x) == pytest.approx(plain) and m.score(own).tolist() == [0] * 4
    assert models.SelfRegion(own[:1], ("a", "b")).radius == 0.15 and models.SelfRegion(np.zeros((0, 2)), ("a", "b")).score(x).tolist() == [0] * 4


def plain_nearest(q, memory, k):
    d = sorted((round(math.dist(q[1], m[1]), 6), m[0]) for m in memory if m[0] != q[0])
    return [(q[0], mid, place + 1) for place, (_, mid) in enumerate(d[:k])]


def test_index_covers_all_rows_and_is_exact_where_asked(spark, monkeypatch):
    rng = random.Random(5)
    memory = [(i, [rng.gauss(c * 3, 1) for c in (i % 4, i % 3, 0, 1)]) for i in range(900)]
    memory += [(2000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(300)]  # a third or so at one place
    m = spark.createDataFrame(memory, "mid long, m array<double>")
    q = m.where("mid % 20 = 0").select(F.col("mid").alias("qid"), F.col("m").alias("q"))
    index = X.build(m, block=100)
    assert index.rows.count() == len(memory) and index.rows.groupBy("list", "block").count().agg(F.max("count")).first()[0] < 200
    want = sorted(x for row in memory if row[0] % 20 == 0 for x in plain_nearest(row, memory, 5))
    exact = X.search(q, index, 5, probes=2, exact=True)
    assert sorted((r.qid, r.mid, r.place) for r in exact.collect()) == want
    truth = spark.createDataFrame(want, "qid long, mid long, place long")
    assert X.recall(X.search(q, index, 5), truth) >= 0.9
    none = X.build(m.limit(0))
    assert X.search(q, none, 5).count() == 0 and X.search(q, none, 5, exact=True).count() == 0
    few = X.build(m.where("mid < 3"))
    assert X.search(q, few, 5, exact=True).where("qid = 0").count() == 2


def test_index_recall_on_the_given_vectors(spark):
    """Random directions are the hardest case for lists; probes are measured on a sample and hold for all queries."""
    queries, memory = Q._embeddings(spark, "/root/testdata/sf0.01")
    index = X.build(memory)
    probes = X.probes_for(queries, index, 5, target=0.93, sample=60)
    got = X.recall(X.search(queries, index, 5, probes), X.search(queries, index, 5, exact=True))
    print(f"recall with {probes} of {len(index.centres)} lists: {got:.3f}")
    assert got >= 0.9


def test_memory_draws_scores_towards_neighbours(spark):
    """Against a plain version over all samples; a score without memories is unchanged."""
    from veracel.functions import text
    from veracel.plans.immune_queries import _features
    from veracel.sources.tables import manifest

    place = {r.id: [float(r[c]) for c in text.DENDRITIC] for r in _features(spark, SF).collect()}
    known = {r.sid for r in manifest(spark, SF).collect()}
    rows = {r.id: r for r in Q.memory_pipeline(spark, SF).collect()}
    assert len(rows) == len(place)
    for i, r in rows.items():
        near = sorted((round(math.dist(place[i], place[j]), 6), j) for j in known if j != i and j in rows and rows[j].domain == r.domain)[:5]
        if not near:
            assert r.prior is None and (r.gated or r.score == r.modulated)
            continue
        w = [1 / (d + 1e-8) for d, _ in near]
        prior = sum(a * rows[j].modulated for a, (_, j) in zip(w, near)) / sum(w)
        assert r.prior == pytest.approx(prior, abs=2e-5)
        assert r.score == pytest.approx(1.0 if r.gated else 0.8 * r.modulated + 0.2 * prior, abs=1e-4)


def plain_hurst(x):
    n, pts = len(x), []
    if n < 20:
        return 0.5
    for size in statistics.window_sizes(n):
        ratios = []
        for lo in range(0, n - size + 1, size):
            w = x[lo : lo + size]
            mean = sum(w) / size
            walk, at = [], 0.0
            for v in w:
                at += v - mean
                walk.append(at)
            s = math.sqrt(sum((v - mean) ** 2 for v in w) / (size - 1))
            if s > 0 and max(walk) > min(walk):
                ratios.append((max(walk) - min(walk)) / s)
        if ratios:
            noise = (size - 0.5) / size * math.gamma((size - 1) / 2) / (math.sqrt(math.pi) * math.gamma(size / 2)) * sum(math.sqrt((size - i) / i) for i in range(1, size))
            pts.append((math.log(size), math.log(sum(ratios) / len(ratios)) - math.log(noise)))
    if len(pts) < 2:
        return 0.5
    mx, my = sum(p[0] for p in pts) / len(pts), sum(p[1] for p in pts) / len(pts)
    return min(1.0, max(0.0, 0.5 + sum((a - mx) * (b - my) for a, b in pts) / sum((a - mx) ** 2 for a, _ in pts)))


def test_hurst(spark):
    rng = np.random.default_rng(6)
    noise, walk = rng.normal(size=900), np.cumsum(rng.normal(size=900))
    for x in (noise[:300], walk[:300], noise[:19], np.ones(50), np.arange(40.0), noise[:20]):
        assert statistics.hurst(x) == pytest.approx(plain_hurst(x.tolist()), abs=1e-9)
    assert abs(statistics.hurst(noise) - 0.5) < 0.15 < 0.3 < statistics.hurst(walk) - 0.5 + 0.15
    rows = {r.id: r for r in Q.hurst_exponents(spark, SF).collect()}
    from veracel.sources.tables import samples

    for r in samples(spark, SF).where("length(output) < 800").collect():
        words = [len(w) for w in r.output.split()]
        want = (plain_hurst([ord(c) for c in r.output]), plain_hurst(words)) if words else (0.5, 0.5)
        assert (rows[r.id].hurst_char, rows[r.id].hurst_word) == pytest.approx(want, abs=2e-6)


def test_p_values():
    """Closed forms of Student's t for one to four degrees of freedom, and values of the incomplete beta function."""
    for r in (0.01, 0.3, -0.5, 0.9, 0.999, -0.999999):
        for n in (3, 4, 5, 6):
            df = n - 2
            t = abs(r) * math.sqrt(df / (1 - r * r))
            th = math.atan(t / math.sqrt(df))
            inside = {1: 2 * th / math.pi, 2: math.sin(th), 3: 2 / math.pi * (th + math.sin(th) * math.cos(th)), 4: math.sin(th) * (1 + math.cos(th) ** 2 / 2)}[df]
            assert statistics.rank_p_value([r], [n])[0] == pytest.approx(1 - inside, abs=1e-9)
    for a, b, x in ((2, 3, 0.4), (5, 1, 0.7), (1, 4, 0.2), (7, 2, 0.95)):
        want = sum(math.comb(a + b - 1, j) * x**j * (1 - x) ** (a + b - 1 - j) for j in range(a, a + b))
        assert statistics.incomplete_beta(a, b, x) == pytest.approx(want, abs=1e-12)
    assert statistics.rank_p_value([0.0, 1.0, -1.0, 0.5, float("nan")], [10, 10, 10, 2, 10]).tolist() == [1.0, 0.0, 0.0, 1.0, 1.0]
    big = statistics.rank_p_value([0.05], [100_000])[0]
    assert 0 <= big < 1e-50


def test_fitting_an_index_holds_a_block_of_distances(spark):
    """All distances of the sample to the centres were held at once, several times over."""
    import tracemalloc

    x = np.random.default_rng(2).random((20_000, 4))
    tracemalloc.start()
    X.k_means(x, 300, rounds=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30e6 < 20_000 * 300 * 8
    rows = spark.range(3000).select(F.col("id").alias("mid"), F.array(F.col("id").cast("double")).alias("m"))
    first = [float(r.mid) for r in rows.orderBy(F.xxhash64("mid"), "mid").limit(100).collect()]
    assert X._sample(rows, 3000, 100).ravel().tolist() == first
    assert X._sample(rows.union(rows), 10**9, 100).ravel().tolist() == [v for v in first[:50] for _ in range(2)]  # a share too small at first
