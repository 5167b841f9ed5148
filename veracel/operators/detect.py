"""One-class detectors and the gated decision pipeline over feature vectors."""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import materialize

# Weights of the signal categories, and detectors of each tier.
PAMP = {"pamp_score": 1.0}
DANGER = {"exaggeration": 1 / 3, "controversy": 1 / 3, "claim_density": 1 / 3}
SAFE = {"citation_count": 0.2, "hedging_ratio": 0.2, "numeric_density": 0.2, "certainty": 0.2, "specificity": 0.2}
TIERS = {"immature": ("ocsvm", "negsel"), "semi-mature": ("ocsvm", "negsel"), "mature": ()}


#: Vectors of a block at most; vectors of a tile of a block: queries and memory.
BLOCK_ROWS, TILE_QUERIES, TILE_ROWS = 32_768, 1024, 4096


def _matrix(ids: pa.ChunkedArray, vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, these as a matrix."""
    lists = vectors.combine_chunks()
    width = len(lists[0]) if len(lists) else 0
    if (lists.value_lengths().to_numpy(zero_copy_only=False) != width).any():
        raise ValueError("vectors of different lengths")
    return ids.combine_chunks().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), width)


def block_pairs(queries: DataFrame, memory: DataFrame, meet, schema: str, block: int | None = None) -> DataFrame:
    """The rows of meet(qids, q, mids, m) over every pair of blocks: a stated query set against all rows.

    Rows are dealt into blocks of a bounded size and each pair of blocks is one group, so what is shuffled is the rows times
    the number of blocks they meet. Rows without an id or a vector are left out. queries: qid, q; memory: mid, m (arrays)."""
    spark = queries.sparkSession
    cores, block = spark.sparkContext.defaultParallelism, block or BLOCK_ROWS
    queries, memory = queries.where("qid is not null and q is not null"), memory.where("mid is not null and m is not null")
    asked = queries.count()
    nm = max(1, math.ceil(memory.count() / block))
    nq = max(1, math.ceil(asked / block), min(math.ceil(4 * cores / nm), math.ceil(asked / TILE_QUERIES)))  # queries are dealt finer for work for all cores
    left = queries.select("qid", "q", F.pmod(F.xxhash64("qid"), F.lit(nq)).alias("x")).join(F.broadcast(spark.range(nm).withColumnRenamed("id", "y")))
    right = memory.select("mid", "m", F.pmod(F.xxhash64("mid"), F.lit(nm)).alias("y")).join(F.broadcast(spark.range(nq).withColumnRenamed("id", "x")))
    parts = min(nq * nm, 4096)
    names = [c.split() for c in schema.split(", ")]
    kinds = pa.schema([(n, {"long": pa.int64(), "double": pa.float64()}[t]) for n, t in names])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return kinds.empty_table()
        found = meet(*_matrix(a["qid"], a["q"]), *_matrix(b["mid"], b["m"]))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(found, kinds)], schema=kinds)

    return left.repartition(parts, "x", "y").groupBy("x", "y").cogroup(right.repartition(parts, "x", "y").groupBy("x", "y")).applyInArrow(run, schema)


def in_blocks(queries: DataFrame, memory: DataFrame, reduce, schema: str, block: int | None = None) -> DataFrame:
    """reduce(qids, mids, distances) over every tile of every pair of blocks (see block_pairs), distances from one matrix product a tile; only the columns that reduce returns leave it."""

    def meet(qids, q, mids, m):
        tiles = [reduce(qids[i : i + TILE_QUERIES], mids[j : j + TILE_ROWS], distances(q[i : i + TILE_QUERIES], m[j : j + TILE_ROWS])) for i in range(0, len(q), TILE_QUERIES) for j in range(0, len(m), TILE_ROWS)]
        return [np.concatenate(c) for c in zip(*tiles)]

    return block_pairs(queries, memory, meet, schema, block)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def _merged(best: list[np.ndarray], at: np.ndarray, found: np.ndarray, d: np.ndarray) -> np.ndarray:
    """best (distances, ids: k a query) with rows found for the queries `at` taken in, ties by id; the queries that changed."""
    k, changed = best[0].shape[1], np.unique(at)
    of = np.concatenate([at, np.repeat(changed, k)])
    d, found = np.concatenate([d, best[0][changed].ravel()]), np.concatenate([found, best[1][changed].ravel()])
    order = np.lexsort((found, d, of))
    of, first = of[order], np.searchsorted(of[order], changed)
    keep = (first[:, None] + np.arange(k)).ravel()
    best[0][changed], best[1][changed] = d[order][keep].reshape(-1, k), found[order][keep].reshape(-1, k)
    return changed


def k_nearest(qids: np.ndarray, q: np.ndarray, mids: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """qids, mids, distances of each query's k nearest rows, itself and vectors that are not finite left out; ties of distances rounded to six places by mid.

    Products in single precision tell which rows can be among the k: those within the k-th distance so far and what such
    a product can be off by. Only their distances are worked out, in double precision."""
    out, kept = [], (np.isfinite(q).all(1), np.isfinite(m).all(1))
    qids, q, mids, m = qids[kept[0]], q[kept[0]], mids[kept[1]], m[kept[1]]
    far = float(np.sqrt((m * m).sum(1).max())) if len(m) else 0.0
    width = q.shape[1]
    kind = np.float32 if max(np.abs(m).max(initial=0), np.abs(q).max(initial=0)) < 1e15 else np.float64
    half = np.column_stack([-m, (m * m).sum(1) / 2]).astype(kind)
    for i in range(0, len(q), TILE_QUERIES):
        ids, x = qids[i : i + TILE_QUERIES], q[i : i + TILE_QUERIES]
        norm = (x * x).sum(1)
        slack = (width + 8) * 2.4e-7 * (np.sqrt(norm) * far + far * far + norm) + 1e-30
        one = np.column_stack([x, np.ones(len(x))]).astype(kind)
        best = [np.full((len(x), k), np.inf), np.full((len(x), k), np.iinfo(np.int64).max)]
        limit = np.full(len(x), np.inf)
        for j in range(0, len(m), TILE_ROWS):
            s = one @ half[j : j + TILE_ROWS].T  # half the squared distance less half the query's norm
            if j == 0 and s.shape[1] > k:
                own = np.where(ids[:, None] == mids[None, j : j + TILE_ROWS], np.inf, s)
                limit = np.partition(own, k - 1, 1)[:, k - 1] + 2 * slack + 1e-6 * (np.sqrt(norm) + far + 1)
            at, row = np.divmod(np.flatnonzero(s <= limit[:, None].astype(kind)), s.shape[1])
            other = ids[at] != mids[row + j]
            at, row = at[other], row[other] + j
            if not len(at):
                continue
            d = np.concatenate([np.sqrt(((x[at[o : o + 65536]] - m[row[o : o + 65536]]) ** 2).sum(1)) for o in range(0, len(at), 65536)]).round(6)
            changed = _merged(best, at, mids[row], d)
            last = best[0][changed, k - 1]
            limit[changed] = np.minimum(limit[changed], ((last + 1e-6) ** 2 - norm[changed]) / 2 + slack[changed])
        hit = np.isfinite(best[0])
        out.append((np.repeat(ids, hit.sum(1)), best[1][hit], best[0][hit]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.array([], int), np.array([], int), np.array([]))


def nearest(queries: DataFrame, memory: DataFrame, k: int) -> DataFrame:
    """The k nearest memory vectors of each query, itself left out; ties by mid. Each pair of blocks keeps its own k, then these meet."""
    d = block_pairs(queries, memory, lambda qids, q, mids, m: k_nearest(qids, q, mids, m, k), "qid long, mid long, distance double")
    w = Window.partitionBy("qid").orderBy("distance", "mid")
    return d.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


def neighbourhoods(queries: DataFrame, memory: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, of those neighbours, and of their neighbours, each among all of memory: what a local outlier factor needs."""
    found = materialize(nearest(queries, memory, k), "neighbours")
    for _ in range(2):
        more = found.select("mid").distinct().join(found.select(F.col("qid").alias("mid")).distinct(), "mid", "left_anti")
        further = memory.join(more, "mid", "left_semi").select(F.col("mid").alias("qid"), F.col("m").alias("q"))
        found = found.unionByName(materialize(nearest(further, memory, k), "neighbours"))
    return found


def kernel_novelty(queries: DataFrame, memory: DataFrame) -> DataFrame:
    """1 - mean Gaussian kernel of each query to all other memory vectors."""

    def sums(qids, mids, d):
        other = qids[:, None] != mids[None, :]
        return qids, (np.exp(-d * d) * other).sum(1), other.sum(1)

    got = in_blocks(queries, memory, sums, "qid long, s double, n long")
    return got.groupBy("qid").agg((1 - F.sum("s") / F.sum("n")).alias("novelty"))


def neighbour_prior(found: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Mean outcome of each query's neighbours, weighted by 1 / (distance + 1e-8); 0.5 without any."""
    met = found.join(outcomes, "mid")
    w = 1 / (F.col("distance") + 1e-8)
    return met.groupBy("qid").agg(F.coalesce(F.sum(w * F.col("outcome")) / F.sum(w), F.lit(0.5)).alias("prior"))


def self_radius(found: DataFrame) -> float:
    """Radius of the self region: the 95th percentile of nearest distances, in [0.05, 2]; 0.15 for fewer than two."""
    r = found.where("place = 1").agg(F.percentile("distance", 0.95).alias("p"), F.count(F.lit(1)).alias("n")).first()
    return 0.15 if r.n < 2 else max(0.05, min(2.0, r.p))


def negative_selection(distance: Column, radius: float) -> Column:
    """How far outside the self region, over twice its radius, in [0, 1]."""
    return text.clip((distance - radius) / (2 * radius))


def local_outlier_factor(found: DataFrame) -> DataFrame:
    """Local outlier factor from each row's k neighbours. found: qid, mid, distance of the rows asked for, their neighbours and the neighbours of those (else of every row)."""
    reach_of = found.groupBy("qid").agg(F.max("distance").alias("k_distance"))
    reach = found.join(reach_of.select(F.col("qid").alias("mid"), "k_distance"), "mid").select("qid", "mid", F.greatest("distance", "k_distance").alias("reach"))
    density = reach.groupBy("qid").agg((1 / (F.avg("reach") + 1e-10)).alias("lrd"))
    near = found.join(density.select(F.col("qid").alias("mid"), F.col("lrd").alias("near_lrd")), "mid").groupBy("qid").agg(F.avg("near_lrd").alias("near_lrd"))
    return density.join(near, "qid").select("qid", (F.col("near_lrd") / F.col("lrd")).alias("lof"))


def percentile_score(values: DataFrame, baseline: DataFrame, value: str) -> DataFrame:
    """Anomaly score of a raw score against a baseline: its rank from above inside it, its deviation from the median outside.

    The rank of a value is the count of baseline values up to it: both columns are range-partitioned by
    value, counted within each range, and each range adds what the ranges before it hold."""
    stats = baseline.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).withColumn("range", F.col("hi") - F.col("lo"))
    marks = baseline.groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    joined = values.select("id", value).unionByName(marks.select(F.lit(None).cast("long").alias("id"), value, "c"), allowMissingColumns=True)
    dealt = materialize(joined.repartitionByRange(value).withColumn("part", F.spark_partition_id()), "by-value")
    before = dealt.groupBy("part").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("held"))  # a row per partition
    before = before.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"))
    upto = Window.partitionBy("part").orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    ranked = dealt.join(F.broadcast(before), "part").withColumn("idx", F.col("before") + F.coalesce(F.sum("c").over(upto), F.lit(0)))
    s = stats.first()
    n, spread = s.n, s.range
    upper = ranked.where(F.col("c").isNotNull() & (F.col("idx") > n // 2)).agg(F.min(value).alias("mid")).first().mid
    scored = ranked.where("id is not null")
    inside = (F.col("idx") > 0) & (F.col("idx") < n)
    off = F.lit(0.5) if not n or spread < 1e-10 else text.clip(F.abs(F.col(value) - upper) / spread)
    return scored.select("id", F.when(inside, 1 - F.col("idx") / n).otherwise(off).alias("score"))


def _usual(n: int) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def _finite(x: np.ndarray) -> np.ndarray:
    """Features without NaN (0) and beyond a million millions."""
    return np.clip(np.nan_to_num(x, nan=0.0, posinf=1e12, neginf=-1e12), -1e12, 1e12)


class Forest:
    """Isolation trees in flat arrays: feature (-1 for a leaf), cut, places of the two sides, depth of a leaf."""

    def __init__(self, data: np.ndarray, trees: int, sample: int, seed: int):
        rng, n, data = np.random.default_rng(seed), min(sample, len(data)), _finite(data)
        limit = math.ceil(math.log2(max(2, n)))
        self.norm, self.trees = _usual(n) or 1.0, []
        for _ in range(trees if len(data) else 0):
            feature, cut, low, high, depth = [], [], [], [], []
            work = [(data[rng.choice(len(data), n, replace=False)], 0, None, None)]
            while work:
                x, d, parent, side = work.pop()
                at = len(feature)
                if parent is not None:
                    side[parent] = at
                wide = np.flatnonzero(x.min(0) < x.max(0))
                if d >= limit or not len(wide):
                    feature.append(-1), cut.append(0.0), low.append(at), high.append(at), depth.append(d + _usual(len(x)))
                    continue
                f = int(rng.choice(wide))
                c = float(rng.uniform(x[:, f].min(), x[:, f].max()))
                feature.append(f), cut.append(c), low.append(0), high.append(0), depth.append(0.0)
                below = x[:, f] < c
                work += [(x[~below], d + 1, at, high), (x[below], d + 1, at, low)] if below.any() and not below.all() else [(x, limit, at, high), (x, limit, at, low)]
            self.trees.append(tuple(np.array(v) for v in (feature, cut, low, high, depth)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean depth / usual depth) of each row, all rows a level at a time."""
        x, total, rows = _finite(x), np.zeros(len(x)), np.arange(len(x))
        for feature, cut, low, high, depth in self.trees:
            at = np.zeros(len(x), int)
            while (going := feature[at] >= 0).any():
                below = x[rows, np.maximum(feature[at], 0)] < cut[at]
                at = np.where(going, np.where(below, low[at], high[at]), at)
            total += depth[at]
        return 2.0 ** (-total / max(1, len(self.trees)) / self.norm)


def fit_forest(features: DataFrame, columns: tuple[str, ...], trees: int = 100, sample: int = 256, seed: int = 5) -> Forest:
    """An isolation forest on a bounded sample, the first 8 * trees rows in hash order. features: id, columns."""
    picked = features.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max(trees * 8, sample))
    return Forest(np.array([[float(r[c]) for c in columns] for r in picked.collect()]), trees, sample, seed)


def forest_scores(features: DataFrame, columns: tuple[str, ...], forest: Forest) -> DataFrame:
    """features with score, by an isolation forest scored where the rows are."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(forest.score(np.stack(rows).astype(float)))

    return features.withColumn("score", score(F.array(*[F.col(c).cast("double") for c in columns])))


def isolation_scores(features: DataFrame, columns: tuple[str, ...], trees: int = 100, sample: int = 256, seed: int = 5) -> DataFrame:
    """Isolation forest fitted on a bounded sample of the features and scored on all of them. features: id, columns."""
    features = materialize(features, "features")  # read by the fit and the scores
    return forest_scores(features, columns, fit_forest(features, columns, trees, sample, seed)).select("id", "score")


def self_distance(features: DataFrame, columns: tuple[str, ...], own: DataFrame, most: int = 1000, seed: int = 7) -> tuple[DataFrame, float]:
    """features with distance to the nearest of a bounded sample of self rows, the first `most` in hash order, and the self radius.

    own: id, columns. A self row's distance to itself does not count towards the radius."""
    picked = own.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most).collect()
    x = np.array([[float(r[c]) for c in columns] for r in picked]).reshape(len(picked), len(columns))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) if len(x) else np.zeros((0, 0))
    np.fill_diagonal(d, np.inf)
    radius = max(0.05, min(2.0, float(np.quantile(d.min(1), 0.95)))) if len(x) > 1 else 0.15

    @F.pandas_udf("double")
    def nearest_self(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            q, best = np.stack(rows).astype(float), np.full(len(rows), np.inf)
            for lo in range(0, len(x), 256):
                best = np.minimum(best, ((q[:, None] - x[None, lo : lo + 256]) ** 2).sum(2).min(1))
            yield pd.Series(np.sqrt(best))

    return features.withColumn("distance", nearest_self(F.array(*[F.col(c).cast("double") for c in columns]))), radius


def reconstruction_error(vectors: DataFrame, k: int = 8) -> DataFrame:
    """Squared error of each vector after projection on k principal axes. vectors: id, v.

    The covariance is summed in Spark, one matrix a task; only it reaches the driver."""
    dim = len(vectors.select("v").first()[0])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = np.stack(b["v"]).astype(float)
            n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        yield pd.DataFrame({"i": [0], "n": [float(n)], "s": [s.tolist()], "ss": [ss.ravel().tolist()]})

    parts = vectors.select("v").mapInPandas(sums, "i int, n double, s array<double>, ss array<double>")
    flat = parts.select("n", F.posexplode(F.concat("s", "ss")).alias("p", "x")).groupBy("p").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    got = sorted(flat.collect())
    n, values = got[0].n, np.array([r.x for r in got])
    mean = values[:dim] / n
    axes = np.linalg.eigh(values[dim:].reshape(dim, dim) / n - np.outer(mean, mean))[1][:, -k:]

    @F.pandas_udf("double")
    def error(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vs in batches:
            x = np.stack(vs).astype(float) - mean
            yield pd.Series((x * x).sum(1) - ((x @ axes) ** 2).sum(1))

    return vectors.select("id", error("v").alias("error"))


def signals(features: dict[str, Column]) -> dict[str, Column]:
    weigh = lambda ws: text.clip(sum((features[n] * w for n, w in ws.items()), F.lit(0.0)))
    return {"pamp": weigh(PAMP), "danger": weigh(DANGER), "safe": weigh(SAFE)}


def maturation(s: dict[str, Column], threshold: float = 0.3) -> Column:
    return F.when(s["pamp"] >= threshold, "mature").when(s["safe"] > s["pamp"] + s["danger"], "immature").otherwise("semi-mature")


def z_gate(features: dict[str, Column], stats: dict[str, tuple[Column, Column]], threshold: float = 3.0) -> Column:
    """(score, confidence) of the first feature whose |z| is over the threshold, null if none; constant ones are skipped."""
    hits = [
        F.when((std > 0) & (F.abs((features[n] - mean) / F.when(std > 0, std)) > threshold),
               F.struct(F.lit(1.0).alias("score"), F.least(F.lit(1.0), F.abs((features[n] - mean) / F.when(std > 0, std)) / (2 * threshold)).alias("confidence"), F.lit(n).alias("feature")))
        for n, (mean, std) in stats.items()
    ]
    return F.coalesce(*hits)


def danger_modulation(score: Column, pamp: Column, danger: Column, alpha: float = 0.3) -> Column:
    return text.clip(score + (1 - score) * F.greatest(pamp, danger) * alpha)


def ensemble(scores: DataFrame, *keys: str) -> DataFrame:
    """Mean score and confidence, the type of the first detector. scores: keys, ord, score, confidence, type."""
    return scores.groupBy(*keys).agg(F.avg("score").alias("score"), F.avg("confidence").alias("confidence"), F.min_by("type", "ord").alias("type"))

