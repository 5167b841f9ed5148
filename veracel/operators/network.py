"""Analytics over many scorers: collusion, agreement, weights, stake snapshots, health."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .history import admitted_calls


def similar_pairs(scores: DataFrame, least: float = 0.99, shared: int = 3, *keys: str) -> DataFrame:
    """a < b with the cosine of their scores over shared samples, at least `shared` of them. scores: keys, uid, sid, score.

    Two uids that share so many samples share one that is not among the `shared` - 1 most frequent of either, so
    pairs are found over those alone: a sample that everyone answered brings no pairs.  What they share among the
    few frequent ones of either is then looked up."""
    mine = scores.select(*keys, F.col("uid").alias("a"), "sid", F.col("score").alias("x"))
    other = scores.select(*keys, F.col("uid").alias("b"), "sid", F.col("score").alias("y"))
    if shared > 1:
        often = scores.groupBy(*keys, "sid").agg(F.count(F.lit(1)).alias("often"))
        rank = F.row_number().over(Window.partitionBy(*keys, "uid").orderBy(F.desc("often"), "sid"))
        ranked = scores.join(often, [*keys, "sid"]).withColumn("rare", rank >= shared).drop("often")
        mine, other = (ranked.select(*keys, F.col("uid").alias(u), "sid", F.col("score").alias(v), "rare") for u, v in (("a", "x"), ("b", "y")))
        rows = [*keys, "a", "b", "x", "y"]
        met = mine.where("rare").drop("rare").join(other.where("rare").drop("rare"), [*keys, "sid"]).where("a < b").select(rows)
        pairs = met.select(*keys, "a", "b").distinct()
        of_a = pairs.join(mine.where("not rare").drop("rare"), [*keys, "a"]).join(other, [*keys, "b", "sid"]).select(rows)
        of_b = pairs.join(other.where("not rare").drop("rare"), [*keys, "b"]).join(mine.where("rare"), [*keys, "a", "sid"]).select(rows)
        met = met.unionByName(of_a).unionByName(of_b)
    else:
        met = mine.join(other, [*keys, "sid"]).where("a < b")
    sums = met.groupBy(*keys, "a", "b").agg(
        F.count(F.lit(1)).alias("shared"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy")
    ).where(F.col("shared") >= shared)
    norm = F.sqrt(F.col("xx") * F.col("yy"))
    out = sums.select(*keys, "a", "b", "shared", F.when(norm > 0, F.col("xy") / norm).otherwise(0.0).alias("cosine"))
    return out.where(F.round("cosine", 9) >= least)


def greedy_cliques(edges: list[tuple[int, int]], least: int = 3) -> list[list[int]]:
    """Seeds in ascending order gather ascending candidates linked to all members; groups of `least` or more are used up."""
    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    used, groups = set(), []
    for seed in sorted(near):
        if seed in used:
            continue
        group = [seed]
        for c in sorted(near[seed] - used):
            if c > seed and all(c in near[m] for m in group):
                group.append(c)
        if len(group) >= least:
            groups.append(group)
            used |= set(group)
    return groups


def components(edges: DataFrame) -> DataFrame:
    """id, class_id: the least id that edges (id, root) connect each id with.

    Each round every id takes the least label around it, then the label's label, so chains shorten by
    halves; labels are written between rounds. Joins on a hub's key are of two tables, so skew is split."""
    edges = edges.select("id", "root").where("root is not null").distinct()
    both = materialize(edges.unionByName(edges.select(F.col("root").alias("id"), F.col("id").alias("root"))).distinct(), "edges")
    labels = materialize(both.groupBy("id").agg(F.least(F.min("root"), F.col("id")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("root"), "label"), "root").groupBy("id").agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("new"))
        far = labels.select(F.col("id").alias("new"), F.col("label").alias("far"))
        best = F.least("new", F.coalesce("far", "new"))
        step = materialize(step.join(far, "new", "left").select("id", best.alias("label"), (best < F.col("label")).alias("moved")), "labels")
        labels = step.select("id", "label")
        if step.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "class_id")


def cliques(pairs: DataFrame) -> DataFrame:
    """seed, uid of the greedy cliques of the graph of similar pairs.

    A seed gathers only uids linked to it, so each connected part of the graph is worked on by itself."""
    parts = components(pairs.select(F.col("a").alias("id"), F.col("b").alias("root")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = greedy_cliques(list(zip(pdf["a"].tolist(), pdf["b"].tolist())))
        return pd.DataFrame([(g[0], u) for g in found for u in g], columns=["seed", "uid"])

    marked = pairs.join(parts.withColumnRenamed("id", "a"), "a")
    return marked.groupBy("class_id").applyInPandas(run, "seed long, uid long")


def penalised(rewards: DataFrame, members: DataFrame, *keys: str) -> DataFrame:
    """Rewards with 0 for members of a collusion group."""
    hit = members.select(*keys).distinct().withColumn("hit", F.lit(True))
    return rewards.join(hit, list(keys), "left").withColumn("reward", F.when(F.col("hit"), 0.0).otherwise(F.col("reward"))).drop("hit")


def rank_agreement(scores: DataFrame) -> DataFrame:
    """Spearman's rho of each pair of judges over the uids both ranked; 0 for fewer than two or constant ranks.

    scores: judge, uid, score."""
    other = scores.select("uid", F.col("judge").alias("b"), F.col("score").alias("y"))
    met = scores.select("uid", F.col("judge").alias("a"), F.col("score").alias("x")).join(other, "uid").where("a < b")

    def rank(c):
        tied = F.count(F.lit(1)).over(Window.partitionBy("a", "b", c))
        return F.rank().over(Window.partitionBy("a", "b").orderBy(c)) + (tied - 1) / 2

    ranked = met.select("a", "b", rank("x").alias("rx"), rank("y").alias("ry"))
    n = F.count(F.lit(1))
    cov = F.sum(F.col("rx") * F.col("ry")) * n - F.sum("rx") * F.sum("ry")
    vx, vy = F.sum(F.col("rx") * F.col("rx")) * n - F.sum("rx") * F.sum("rx"), F.sum(F.col("ry") * F.col("ry")) * n - F.sum("ry") * F.sum("ry")
    return ranked.groupBy("a", "b").agg(n.alias("n"), F.when((vx > 0) & (vy > 0), cov / F.sqrt(F.when((vx > 0) & (vy > 0), vx * vy))).otherwise(0.0).alias("rho"))


def judge_outliers(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """Mean rho of each judge over the others, and whether it is below `least`."""
    both = pairs.select(F.col("a").alias("judge"), "rho").unionByName(pairs.select(F.col("b").alias("judge"), "rho"))
    return both.groupBy("judge").agg(F.avg("rho").alias("mean_rho")).withColumn("outlier", F.col("mean_rho") < least)


def capped_weights(w: DataFrame, limit: float, *keys: str) -> DataFrame:
    """Weights of each key that sum to 1 with none over the limit. w: keys, uid, weight.

    Uniform for a zero sum or n * limit <= 1; else values above a cutoff found from running sums are cut."""
    eps = 1e-7
    every, up = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("weight", "uid").rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy(*keys).orderBy("weight", "uid")
    base = w.withColumns({"n": F.count(F.lit(1)).over(every), "sum": F.sum("weight").over(every), "i": F.row_number().over(order), "cum": F.sum("weight").over(up)})
    share, cum = F.col("weight") / F.nullif(F.col("sum"), F.lit(0)), F.col("cum") / F.nullif(F.col("sum"), F.lit(0))
    below = share / ((F.col("n") - F.col("i")) * share + cum + eps) < limit
    marked = base.withColumns({"share": share, "cums": cum}).withColumn("k", F.count_if(below).over(every))
    at = F.max(F.when(F.col("i") == F.col("k"), F.col("cums"))).over(every)
    cutoff = (limit * at - eps) / (1 - limit * (F.col("n") - F.col("k"))) * F.col("sum")
    cut = marked.withColumn("cut", F.when(F.max("share").over(every) <= limit, F.col("weight")).otherwise(F.least("weight", cutoff)))
    total = F.sum("cut").over(every)
    even = (F.col("sum") == 0) | (F.col("n") * limit <= 1)
    return cut.select(*keys, "uid", F.when(even, F.lit(1.0) / F.col("n")).otherwise(F.col("cut") / F.when(even, 1.0).otherwise(total)).alias("weight"))


def emitted_weights(w: DataFrame, *keys: str) -> DataFrame:
    """Weights scaled so the largest is 65535, rounded half to even; zeros go."""
    top = F.max("weight").over(Window.partitionBy(*keys))
    scaled = w.withColumn("u16", F.when(top > 0, F.bround(F.col("weight") / F.when(top > 0, top) * 65535, 0)).otherwise(0).cast("long"))
    return scaled.where("u16 > 0").select(*keys, "uid", "u16")


def weight_audit(w: DataFrame, *keys: str) -> DataFrame:
    """One row per key and warning: weights too even (deviation of non-zeros under .001), or one over .5."""
    g = w.groupBy(*keys).agg(F.stddev_pop(F.when(F.col("weight") > 0, F.col("weight"))).alias("std"), F.count_if(F.col("weight") > 0).alias("n"), F.max("weight").alias("top"))
    told = F.filter(F.array(F.when((F.col("n") >= 2) & (F.col("std") < 0.001), "low_variance"), F.when(F.col("top") > 0.5, "dominant_weight")), lambda x: x.isNotNull())
    return g.select(*keys, F.explode(told).alias("warning"))


def snapshot_changes(stakes: DataFrame, shift: float = 0.1, mass: int = 3) -> DataFrame:
    """Per step against the step before: uids that came and went, stake shift, and which alarms these raise.

    stakes: step, uid, stake.  Each uid meets its own next step, so no step is compared as a set."""
    here = stakes.select("step", "uid", "stake")
    last = stakes.select((F.col("step") + 1).alias("step"), "uid", F.col("stake").alias("was"))
    steps = stakes.select("step").distinct()
    both = here.join(last, ["step", "uid"], "full").join(F.broadcast(steps), "step").join(F.broadcast(steps.select((F.col("step") + 1).alias("step"))), "step")
    g = both.groupBy("step").agg(
        F.count_if(F.col("was").isNull()).alias("came"), F.count_if(F.col("stake").isNull()).alias("went"), F.sum(F.coalesce("stake", F.lit(0.0))).alias("total"), F.sum(F.coalesce("was", F.lit(0.0))).alias("before")
    )
    moved = F.abs(F.col("total") - F.col("before")) / F.greatest("before", F.lit(1e-6))
    return g.select("step", "came", "went", moved.alias("shift"), (F.col("came") > mass).alias("mass_registration"), (F.col("went") > mass).alias("mass_deregistration"), (moved > shift).alias("stake_shift"), (F.col("came") >= mass).alias("surge"))


def coordinated_drops(rewards: DataFrame, share: float = 0.3, drop: float = 0.5) -> DataFrame:
    """Per round: how many uids fell by more than `drop` of their last reward, and whether they are over `share` of all."""
    w = Window.partitionBy("uid").orderBy("round")
    was = F.lag("reward").over(w)
    fell = rewards.withColumn("was", was).withColumn("fell", (F.col("was") > 1e-6) & ((F.col("was") - F.col("reward")) / F.when(F.col("was") > 1e-6, F.col("was")) > drop))
    g = fell.groupBy("round").agg(F.count_if("fell").alias("fell"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("attack", F.col("fell") > share * F.col("n"))


#: Uids and values of a block of profiles at most, and rows and places of a tile at most.
BLOCK_UIDS, BLOCK_VALUES, TILE = 16_384, 1 << 19, 1024


def _profiles(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and how many each list has."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)


def _tiles(table: pa.Table, places: np.ndarray) -> list[list[tuple]]:
    """By tiles of rows, by tiles of places: sums, squares and counts of each row's values there, as matrices."""
    at, n = _profiles(table["at"])
    x, row = _profiles(table["x"])[0], np.repeat(np.arange(len(n)), n)
    i = np.searchsorted(places, at)
    met = (i < len(places)) & (places[np.minimum(i, len(places) - 1)] == at)
    i, x, row, out = i[met], x[met], row[met], []
    for lo in range(0, len(n), TILE):
        height, mine = min(TILE, len(n) - lo), slice(*np.searchsorted(row, [lo, lo + TILE]))
        out.append([])
        for left in range(0, len(places), TILE):
            width, here = min(TILE, len(places) - left), (i[mine] >= left) & (i[mine] < left + TILE)
            cell = (row[mine][here] - lo) * width + i[mine][here] - left
            v = x[mine][here]
            out[-1].append(tuple(np.bincount(cell, w, height * width).reshape(height, width) for w in (v, v * v, np.ones(len(v)))))
    return out


def _largest_cosines(a: pa.Table, b: pa.Table, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a its largest cosine with a row of b over the places of both, 0 at least, and the other way round; same: a is b."""
    top_a, top_b = np.zeros(len(a)), np.zeros(len(b))
    places = np.intersect1d(_profiles(a["at"])[0], _profiles(b["at"])[0])
    if not len(places):
        return top_a, top_b
    left = _tiles(a, places)
    right = left if same else _tiles(b, places)
    for r, of_a in enumerate(left):
        for c, of_b in enumerate(right):
            if same and c < r:
                continue
            xy, xx, yy = (sum(p[i] @ q[j].T for p, q in zip(of_a, of_b)) for i, j in ((0, 0), (1, 2), (2, 1)))
            norm = np.sqrt(np.multiply(xx, yy, out=xx), out=xx)
            cosine = np.divide(xy, norm, out=np.zeros_like(xy), where=norm > 0)
            if same and c == r:
                np.fill_diagonal(cosine, 0)
            for top, k, most in ((top_a, r, cosine.max(1)), (top_b, c, cosine.max(0))):
                here = top[k * TILE : k * TILE + len(most)]
                np.maximum(here, most, out=here)
    return (np.maximum(top_a, top_b),) * 2 if same else (top_a, top_b)


def closest(vectors: DataFrame, *keys: str) -> DataFrame:
    """keys, uid, top: the largest cosine of a uid's values with those of another uid over what both have, 0 at least; only uids that share a place.

    vectors: keys, uid, pos (a whole number), value.  Values of one uid and place count by every pair of them.  Uids whose values at the same
    places are multiples of each other (to twelve digits) are one profile, whose top is 1.  The other profiles meet each other
    and these in pairs of blocks of bounded size, as matrix products: the work is quadratic in different profiles, what is
    shuffled is their number times that of blocks, and no pair is a row.  A place that two uids have and one of them without
    a finite value there makes the top NaN."""
    v = vectors.where(F.col("uid").isNotNull() & F.col("pos").isNotNull()).select(*keys, "uid", F.col("pos").cast("long").alias("at"), F.col("value").cast("double").alias("x"))
    finite = F.coalesce(F.abs("x") < float("inf"), F.lit(True))
    facts = v.groupBy(*keys, "at").agg((F.min("uid") != F.max("uid")).alias("met"), F.bool_or(~finite).alias("odd"))
    one = F.struct("at", F.when(finite, F.coalesce("x", F.lit(0.0))).otherwise(0.0).alias("x"))
    own = v.join(facts, [*keys, "at"]).groupBy(*keys, "uid").agg(F.array_sort(F.collect_list(one)).alias("p"), F.bool_or("met").alias("met"), F.bool_or(F.col("met") & F.col("odd")).alias("odd"))
    most = F.array_max(F.transform("p", lambda e: F.abs(e["x"])))
    own = own.where("met").withColumn("p", F.when(most > 0, F.transform("p", lambda e: F.struct(e["at"].alias("at"), (e["x"] / most).alias("x")))))
    near = F.to_json(F.struct(F.transform("p", lambda e: F.struct(e["at"].alias("a"), (F.round(e["x"], 12) + 0.0).alias("x")))))  # no -0.0
    twice = F.size("p") > F.size(F.array_distinct("p.at"))  # such values are no multiples of themselves
    own = materialize(own.withColumn("profile", F.when(F.col("p").isNotNull(), F.md5(F.concat(near, F.when(twice, F.col("uid").cast("string")).otherwise(""))))), "profiles")
    kinds = own.where("profile is not null").groupBy(*keys, "profile").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("uid"))
    kinds = materialize(kinds.join(own.select(*keys, "uid", "p"), [*keys, "uid"]).select(*keys, "profile", F.col("n").alias("same"), "p.at", "p.x"), "profiles")
    found = kinds.select(*keys, "profile", F.when(F.col("same") > 1, 1.0).otherwise(0.0).alias("top")).unionByName(_among(kinds, *keys))
    tops = found.groupBy(*keys, "profile").agg(F.max("top").alias("top"))
    top = F.when(F.col("odd"), float("nan")).otherwise(F.coalesce("top", F.lit(0.0)))
    return own.join(tops, [*keys, "profile"], "left").select(*keys, "uid", top.alias("top"))


def _among(kinds: DataFrame, *keys: str) -> DataFrame:
    """keys, profile, top: the largest cosines of the profiles that one uid has, from each pair of blocks. kinds: keys, profile, same, at, x."""
    cores = kinds.sparkSession.sparkContext.defaultParallelism
    alone = F.col("same") == 1
    n = F.count(F.lit(1))
    full = F.ceil(F.greatest(n / BLOCK_UIDS, F.sum(F.size("at")) / BLOCK_VALUES))
    sizes = materialize(kinds.groupBy(*keys, alone.alias("alone")).agg(F.greatest(full, F.least(F.lit(math.isqrt(8 * cores) + 1), F.ceil(n / 256))).cast("int").alias("blocks")), "sizes")
    dealt = kinds.withColumn("alone", alone).join(F.broadcast(sizes), [*keys, "alone"]).withColumn("block", F.pmod(F.xxhash64("profile"), "blocks").cast("int")).drop("blocks", "same")
    each = sizes.select(*keys, "alone", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    a = each.where("alone").select(*keys, F.col("block").alias("a"))
    b = each.select(*keys, "alone", F.col("block").alias("b"))
    pairs = (a.join(b, list(keys)) if keys else a.crossJoin(b)).where("not alone or a <= b")
    pairs = materialize(pairs, "pairs")  # a row a pair of blocks
    parts = max(1, min(pairs.count(), 4096))
    on = [*keys, "alone", "a", "b"]
    left = dealt.where("alone").withColumnRenamed("block", "a").drop("alone").join(F.broadcast(pairs), [*keys, "a"]).repartition(parts, *on)
    right = dealt.withColumnRenamed("block", "b").join(F.broadcast(pairs), [*keys, "alone", "b"]).where("not alone or a <> b")
    right = right.toDF(*right.columns).repartition(parts, *on)  # columns of its own

    def tops(xs: pa.Table, ys: pa.Table) -> pa.Table:
        same = bool(len(xs)) and xs["alone"][0].as_py() and xs["a"][0].as_py() == xs["b"][0].as_py()
        ys = xs if same else ys
        of_x, of_y = _largest_cosines(xs, ys, same) if len(xs) and len(ys) else (np.zeros(len(xs)), np.zeros(len(ys)))
        out = xs.select([*keys, "profile"]).append_column("top", pa.array(of_x))
        back = not same and len(ys) and ys["alone"][0].as_py()
        return pa.concat_tables([out, ys.select([*keys, "profile"]).append_column("top", pa.array(of_y))]) if back else out

    names = {f.name: f.dataType.simpleString() for f in kinds.schema}
    schema = ", ".join([*(f"{k} {names[k]}" for k in keys), "profile string", "top double"])
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(tops, schema)


def diversity(vectors: DataFrame, *keys: str, min_history: int = 0, min_uids: int = 0) -> DataFrame:
    """1 - the largest cosine with any other uid over what both have; 0.5 without a peer or norm. vectors: keys, uid, pos, value.

    Uids with fewer than min_history values are no peers and get 0.5; where there are fewer than min_uids of them in all, everyone does."""
    uids = vectors.groupBy(*keys, "uid").agg(F.sum(F.col("value") * F.col("value")).alias("norm"), F.count(F.lit(1)).alias("history"))
    if min_history:
        vectors = vectors.join(uids.where(F.col("history") >= min_history).select(*keys, "uid"), [*keys, "uid"], "left_semi")
    best = closest(vectors, *keys)
    neutral = F.col("top").isNull() | (F.col("norm") == 0)
    if min_uids:
        population = uids.groupBy(*keys).agg(F.count(F.lit(1)).alias("population"))
        uids = uids.join(population, list(keys)) if keys else uids.crossJoin(F.broadcast(population))  # one row without keys
        neutral = neutral | (F.col("population") < min_uids)
    bonus = F.when(neutral, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.greatest(F.lit(0.0), "top"))))
    return uids.join(best, [*keys, "uid"], "left").select(*keys, "uid", bonus.alias("diversity"))


def _asked(responses: DataFrame, weights: DataFrame, k: int, *keys: str) -> DataFrame:
    """The answers of the k heaviest uids of each request."""
    top = Window.partitionBy(*keys).orderBy(F.desc("weight"), "uid")
    return responses.join(weights, "uid").withColumn("place", F.row_number().over(top)).where(F.col("place") <= k)


def _trusted() -> list[Column]:
    """score, confidence, n of a request's answers by weight."""
    ok = F.col("score").isNotNull()
    w, c = F.when(ok, F.col("weight")), F.coalesce("confidence", F.lit(0.5))
    mean = lambda x: F.when(F.sum(w) > 0, F.sum(w * x) / F.when(F.sum(w) > 0, F.sum(w))).otherwise(F.avg(F.when(ok, x)))
    return [F.coalesce(mean(F.col("score")), F.lit(0.5)).alias("score"), F.when(F.count_if(ok) > 0, mean(c)).otherwise(0.0).alias("confidence"), F.count_if(ok).alias("n")]


def trust_score(responses: DataFrame, weights: DataFrame, k: int, *keys: str) -> DataFrame:
    """Weighted mean of the answers of the k heaviest uids; equal weights if theirs sum to 0; (0.5, 0, 0) without answers.

    responses: keys, uid, score, confidence; weights: uid, weight."""
    return _asked(responses, weights, k, *keys).groupBy(*keys).agg(*_trusted())


def trust_answers(responses: DataFrame, weights: DataFrame, k: int, *keys: str) -> DataFrame:
    """trust_score with the types of anomaly that were told (distinct, sorted) and the answers themselves, the heaviest uid's first.

    responses: keys, uid, score, confidence, type.  Both lists hold k entries at most; an answer without score is in neither."""
    ok = F.col("score").isNotNull()
    types = F.array_sort(F.collect_set(F.when(ok, F.col("type"))))
    told = F.array_sort(F.collect_list(F.when(ok, F.struct("place", "uid", "weight", "score", "confidence", "type"))))
    return _asked(responses, weights, k, *keys).groupBy(*keys).agg(*_trusted(), types.alias("types"), told.alias("answers"))


def call_statuses(calls: DataFrame, registered: DataFrame, most: int = 60, seconds: float = 60.0) -> DataFrame:
    """caller, status, calls: how the calls of each caller are met.  calls: caller, t (seconds); registered: caller.

    A call without caller is `missing_caller`; one of a caller that is not registered is `unregistered` and counts for
    no limit; of the others, at most `most` within any `seconds` are `admitted`, the rest `limited`."""
    known = calls.join(registered.select("caller").distinct().withColumn("known", F.lit(True)), "caller", "left")
    met = admitted_calls(known.where("known").select("caller", "t"), most, seconds, "caller").toDF("caller", "admitted", "limited")
    passed = met.unpivot(["caller"], ["admitted", "limited"], "status", "calls").where("calls > 0")
    why = F.when(F.col("caller").isNull(), "missing_caller").otherwise("unregistered")
    return passed.unionByName(known.where("known is null").groupBy("caller", why.alias("status")).agg(F.count(F.lit(1)).alias("calls")))
