"""Rolling history: EMA, trajectories and their monitors, rotation, alert cooldown, health."""

import hashlib
from collections import deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize


def in_order(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], fold, schema: str) -> DataFrame:
    """The rows of each key pass through `fold`, an iterator of Arrow batches, sorted by keys and order.

    Only what fold carries is held, so a key of any size costs one task time but no memory."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(fold, schema)


def _keyed(batch: pa.RecordBatch, keys: tuple[str, ...], value: str):
    return zip(zip(*[batch.column(k).to_pylist() for k in keys]), batch.column(value).to_pylist())


def ema(df: DataFrame, order: str, value: str, *keys: str, alpha: float = 0.1) -> DataFrame:
    """keys, order, value, ema after each step from 0; null and NaN count as 0."""

    def fold(batches):
        last, now = None, 0.0
        for b in batches:
            out = []
            for key, v in _keyed(b, keys, value):
                if key != last:
                    last, now = key, 0.0
                now = alpha * (0.0 if v is None or v != v else v) + (1 - alpha) * now
                out.append(now)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, "ema"])

    rows = df.select(*keys, order, F.col(value).cast("double").alias(value))
    return in_order(rows, keys, (order, value), fold, ", ".join(f"`{c}` {t}" for c, t in [*rows.dtypes, ("ema", "double")]))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with each row's place from 0 by `order` (no ties): ranges of it are numbered by themselves, then shifted by the rows before them."""
    dealt = materialize(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "numbered")
    held = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row per partition
    before = held.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    here = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return dealt.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + here).drop("__part", "__before")


def last_n(df: DataFrame, n: int, order: str, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def sign_changes(df: DataFrame, order: str, value: str, *keys: str) -> DataFrame:
    """Changes of direction, steps without a difference left out."""
    w = Window.partitionBy(*keys).orderBy(order)
    diff = df.withColumn("__d", F.signum(F.col(value) - F.lag(value).over(w))).where("__d <> 0")
    turn = diff.withColumn("__t", F.col("__d") != F.lag("__d").over(w))
    return turn.groupBy(*keys).agg(F.count_if("__t").alias("sign_changes"))


def oscillations(trajectories: DataFrame, order: str, value: str, *keys: str, least: int = 4) -> DataFrame:
    return sign_changes(trajectories, order, value, *keys).where(F.col("sign_changes") >= least)


def metastable(trajectories: DataFrame, value: str, *keys: str, n: int = 10, variance: float = 1e-4, median: float = 0.5) -> DataFrame:
    g = trajectories.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.var_pop(value).alias("variance"), F.median(value).alias("median"))
    return g.where((F.col("n") >= n) & (F.col("variance") < variance) & (F.col("median") < median))


def replica_divergence(a: DataFrame, b: DataFrame, order: str, value: str, key: str, most: float = 0.05) -> DataFrame:
    """Largest difference of two replicas over the steps that both have, where it is over `most`."""
    met = a.select(key, order, F.col(value).alias("x")).join(b.select(key, order, F.col(value).alias("y")), [key, order])
    return met.groupBy(key).agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("gap")).where(F.col("gap") > most)


def stale(df: DataFrame, order: str, value: str, *keys: str, n: int = 5, eps: float = 1e-6) -> DataFrame:
    """Rows at which the last n values are within eps of the first of them."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - n, 0)
    seen = df.withColumns({"__n": F.count(value).over(w), "__first": F.first(value).over(w), "__hi": F.max(value).over(w), "__lo": F.min(value).over(w)})
    near = (F.col("__n") == n) & (F.col("__hi") - F.col("__first") < eps) & (F.col("__first") - F.col("__lo") < eps)
    return seen.withColumn("stale", near).drop("__n", "__first", "__hi", "__lo")


def failure_runs(df: DataFrame, order: str, failed: Column, *keys: str) -> DataFrame:
    """Consecutive failures up to each row: rows since the last success."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    island = df.withColumn("__i", F.sum(F.when(failed, 0).otherwise(1)).over(w))
    run = Window.partitionBy(*keys, "__i").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("consecutive_failures", F.sum(F.when(failed, 1).otherwise(0)).over(run)).drop("__i")


def excluded_ids(history: DataFrame, key: str, order: str, item: str, window: int = 10) -> DataFrame:
    """Items that a key saw in its last `window` recorded rounds."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return history.withColumn("__r", F.dense_rank().over(w)).where(F.col("__r") <= window).select(key, item).distinct()


def cooled_alerts(alerts: DataFrame, cooldown: int, *keys: str) -> DataFrame:
    """Alerts of each key more than `cooldown` steps after the last one let through; repeats count once. alerts: keys, step."""

    def fold(batches):
        now, last = None, None
        for b in batches:
            passed = []
            for key, s in _keyed(b, keys, "step"):
                if key != now:
                    now, last = key, None
                passed.append(last is None or s - last > cooldown)
                last = s if passed[-1] else last
            yield b.filter(pa.array(passed, pa.bool_()))

    rows = alerts.where(F.col("step").isNotNull()).select(*keys, F.col("step").cast("long").alias("step"))
    return in_order(rows, keys, ("step",), fold, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes))


def digests(lines: DataFrame, key: str, line: str) -> DataFrame:
    """key, SHA-256 of its lines in order joined by commas, and how many. The hash takes lines as they come; none are gathered."""

    def fold(batches):
        now, h, n, kind = None, None, 0, None
        done = []
        for b in batches:
            kind = b.schema.field(key).type
            for k, x in zip(b.column(key).to_pylist(), b.column(line).to_pylist()):
                if h is None or k != now:
                    if h is not None:
                        done.append((now, h.hexdigest(), n))
                    now, h, n = k, hashlib.sha256(), 0
                h.update(f",{x}".encode() if n else x.encode())
                n += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (kind, pa.string(), pa.int64()))], names=[key, "digest", "n"])
                done = []
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([h.hexdigest()]), pa.array([n], pa.int64())], names=[key, "digest", "n"])

    rows = lines.where(F.col(line).isNotNull()).select(key, line)
    return in_order(rows, (key,), (line,), fold, f"`{key}` {dict(lines.dtypes)[key]}, digest string, n long")


def admitted_calls(calls: DataFrame, limit: int, window: float, key: str) -> DataFrame:
    """Sliding-window rate limit: a call passes if under `limit` calls passed in the last `window`; refused calls do not count.

    calls: key, t.  Rows come sorted by key and time, and the state holds the calls still in the window,
    `limit` at most, so a busy key costs time but no memory."""
    kind = dict(calls.dtypes)[key]

    def fold(batches):
        now, live, passed, refused = None, deque(), 0, 0
        for b in batches:
            rows = []
            for k, t in zip(b[key].tolist(), b["t"].tolist()):
                if k != now:
                    if now is not None:
                        rows.append((now, passed, refused))
                    now, live, passed, refused = k, deque(), 0, 0
                while live and live[0] <= t - window:
                    live.popleft()
                if len(live) < limit:
                    live.append(t)
                    passed += 1
                else:
                    refused += 1
            yield pd.DataFrame(rows, columns=[key, "passed", "refused"])
        if now is not None:
            yield pd.DataFrame([(now, passed, refused)], columns=[key, "passed", "refused"])

    n = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = calls.where(F.col(key).isNotNull()).select(key, F.col("t").cast("double").alias("t"))
    return rows.repartition(n, key).sortWithinPartitions(key, "t").mapInPandas(fold, f"{key} {kind}, passed long, refused long")


def feedback_signal(weights: DataFrame, order: str, value: str, *keys: str) -> DataFrame:
    """10 times the relative change of a weight, cut to [-1, 1]; 0 for the first row or after a 0."""
    was = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    s = F.when(was.isNull() | (was == 0), 0.0).otherwise((F.col(value) - was) / F.abs(F.when(was != 0, was)) * 10)
    return weights.withColumn("signal", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)))
