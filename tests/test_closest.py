"""The largest cosine with another uid and the nearest vectors, against plain pairs."""

import math
from collections import defaultdict

import numpy as np
import pytest
from veracel.operators import detect as D
from veracel.operators import network as N



def plain(rows):
    """(uid, pos, value) to the diversity of each uid, every pair by itself."""
    of = defaultdict(lambda: defaultdict(list))
    for u, p, x in rows:
        of[u][p].append(x or 0.0)
    out = {}
    for u in of:
        top = None
        for v in of:
            both = set(of[u]) & set(of[v])
            if u is None or v is None or u == v or not both:
                continue
            met = [(x, y) for p in both for x in of[u][p] for y in of[v][p]]
            norm = math.sqrt(sum(x * x for x, _ in met) * sum(y * y for _, y in met))
            c = 0.0 if norm == 0 else sum(x * y for x, y in met) / norm
            top = c if top is None or math.isnan(c) else top if math.isnan(top) else max(top, c)
        own = sum(x * x for xs in of[u].values() for x in xs)
        out[u] = 0.5 if top is None or own == 0 else 1.0 if math.isnan(top) else max(0.0, min(1.0, 1 - max(0.0, top)))
    return out


def odd_rows(n=60):
    rng = np.random.default_rng(3)
    rows = [(u, int(p), float(rng.choice([0.0, 1.0, -0.5, *rng.random(3)]))) for u in range(n) for p in rng.choice(16, rng.integers(12, 17), replace=False)]
    twin = [(u, 20 + p, x * f) for u, f in ((100, 1.0), (101, 0.25), (102, -3.0)) for p, x in enumerate((0.1, 0.0, 0.7))]
    odd = [(103, 99, 1.0), (104, 98, 0.0), (None, 1, 1.0), (110, 1, 0.0), (105, 30, float("nan")), (106, 30, 0.5), (106, 97, 0.5), (107, 31, 0.2), (107, 31, -0.2), (108, 31, 0.2), (108, 31, -0.2), (109, 31, None), (109, 97, 1.0)]
    return rows + twin + odd


def diversities(spark, rows):
    return {r.uid: r.diversity for r in N.diversity(spark.createDataFrame(rows, "uid long, pos long, value double")).collect()}


@pytest.mark.parametrize("block", [7, 1 << 14])
def test_diversity_equals_plain_pairs_and_makes_none(spark, monkeypatch, block):
    def pairs(*_):
        raise AssertionError("a row a pair of uids")

    monkeypatch.setattr(N, "similar_pairs", pairs)
    monkeypatch.setattr(N, "BLOCK_UIDS", block)
    got, want = diversities(spark, odd_rows()), plain(odd_rows())
    assert len(set(want.values())) > 20 and got == pytest.approx(want, abs=1e-9)
    assert diversities(spark, [(1, 1, 1.0)]) == {1: 0.5} and diversities(spark, []) == {}


@pytest.mark.parametrize("tile", [3, 1024])
def test_tiles_do_not_change_cosines(monkeypatch, tile):
    import pyarrow as pa

    monkeypatch.setattr(N, "TILE", tile)
    rng = np.random.default_rng(5)
    parts = [[(rng.choice(11, 5, replace=False).tolist(), rng.random(5).tolist()) for _ in range(n)] for n in (10, 8)]
    a, b = (pa.table({"at": [at for at, _ in rows], "x": [x for _, x in rows]}) for rows in parts)

    def cosine(p, q):
        p, q = dict(zip(*p)), dict(zip(*q))
        both = [(p[i], q[i]) for i in p if i in q]
        return sum(x * y for x, y in both) / math.sqrt(sum(x * x for x, _ in both) * sum(y * y for _, y in both)) if both else 0.0

    of_a, of_b = N._largest_cosines(a, b, False)
    assert of_a == pytest.approx([max(cosine(p, q) for q in parts[1]) for p in parts[0]])
    assert of_b == pytest.approx([max(cosine(p, q) for p in parts[0]) for q in parts[1]])
    own, _ = N._largest_cosines(a, a, True)
    assert own == pytest.approx([max(cosine(p, q) for q in parts[0] if q is not p) for p in parts[0]])


def test_diversity_of_days_among_uids_of_long_history(spark, monkeypatch):
    monkeypatch.setattr(N, "similar_pairs", None)
    rows = [(u, p, x) for u, p, x in odd_rows() if u is not None and u < 100 and (u % 3 or p < 6)]
    n = {u: sum(v == u for v, _, _ in rows) for u in range(60)}
    far = {u for u in n if n[u] >= 10}
    want = {u: 0.5 for u in n} | plain([r for r in rows if r[0] in far])
    assert 20 < len(far) < 60
    table = spark.createDataFrame(rows, "uid long, pos long, value double")
    assert {r.uid: r.diversity for r in N.diversity(table, min_history=10, min_uids=8).collect()} == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("tiles", [(3, 4), (1024, 4096)])
@pytest.mark.parametrize("scale", [1.0, 1e-4, 1e20])
def test_k_nearest_equals_plain_distances(monkeypatch, tiles, scale):
    monkeypatch.setattr(D, "TILE_QUERIES", tiles[0])
    monkeypatch.setattr(D, "TILE_ROWS", tiles[1])
    rng = np.random.default_rng(8)
    m = np.vstack([rng.integers(0, 3, (40, 5)), rng.random((30, 5)), np.full((6, 5), 0.5), 1000 + rng.random((20, 5))]) * scale  # ties, copies, far ones
    m[3, 1], mids = np.nan, rng.permutation(len(m))
    mids[7] = mids[8]  # an id twice
    q, qids = m[::3], mids[::3]
    d = np.sqrt(((q[:, None] - m[None]) ** 2).sum(2)).round(6)
    want = []
    for i, a in enumerate(qids):
        near = sorted((d[i, j], b) for j, b in enumerate(mids) if a != b and np.isfinite(d[i, j]))[:4]
        want += [(a, b, x) for x, b in near]
    assert list(zip(*D.k_nearest(qids, q, mids, m, 4))) == want
    assert [len(c) for c in D.k_nearest(qids, q, mids[:0], m[:0], 4)] == [0, 0, 0]


def test_nearest_keeps_few_rows_a_query(spark, monkeypatch):
    """Blocks of 1,024 rows each gave k rows a query: as many as all pairs of blocks."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.random(3)]) for i in range(5000)]
    memory = spark.createDataFrame(rows, "mid long, m array<float>").repartition(3)
    seen = []
    pairs = D.block_pairs
    monkeypatch.setattr(D, "block_pairs", lambda *a, **k: seen.append(out := pairs(*a, **k).cache()) or out)
    got = D.nearest(memory.where("mid % 50 = 0").withColumnsRenamed({"mid": "qid", "m": "q"}), memory, 5)
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    for r in got.where("place = 1").collect():
        d = np.sqrt(((x - x[r.qid]) ** 2).sum(1)).round(6)
        d[r.qid] = np.inf
        assert (r.distance, r.mid) == (d.min(), d.argmin())
    assert got.count() == 500 and seen[0].count() == 500
