"""Structured Streaming: rolling scores, health and alerts as keyed state.

Each query takes a stream with the columns named and a state store keeps one small
row per key.  The batch forms of the same logic are in operators.history; tests
compare the two."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EMA_OUT = "uid long, round long, reward double, ema double"


def ema_stream(rewards: DataFrame, alpha: float = 0.1) -> DataFrame:
    """EMA of each uid's rewards in order of round; rounds must not come back later. rewards: uid, round, reward.

    A batch holds a row per uid and round, of which two numbers are kept to put them in order."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else 0.0
        parts = [(f["round"].to_numpy(), f["reward"].to_numpy(float)) for f in frames]
        rounds, rewards = (np.concatenate(p) for p in zip(*parts))
        order = np.argsort(rounds, kind="stable")
        smooth = []
        for r in np.nan_to_num(rewards[order], nan=0.0, posinf=np.inf, neginf=-np.inf).tolist():
            now = alpha * r + (1 - alpha) * now
            smooth.append(now)
        state.update((now,))
        yield pd.DataFrame({"uid": key[0], "round": rounds[order], "reward": rewards[order], "ema": smooth})

    return rewards.groupBy("uid").applyInPandasWithState(step, EMA_OUT, "ema double", "append", GroupStateTimeout.NoTimeout)


HEALTH = "last_response long, responses long, consecutive_failures long, mean_latency double"


def health_stream(answers: DataFrame) -> DataFrame:
    """Each uid's health after a batch. answers: uid, step, ok, latency.

    Frames are folded one by one in whatever order they come: of a batch only the steps of failures after its last
    success so far are kept."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, failed, mean = state.get if state.exists else (0, 0, 0, 0.0)
        newest, open_steps = None, np.empty(0, np.int64)
        for f in frames:
            ok, steps = f["ok"].to_numpy(bool), f["step"].to_numpy(np.int64)
            if ok.any():
                newest = int(steps[ok].max()) if newest is None else max(newest, int(steps[ok].max()))
                n += int(ok.sum())
                mean += float((f["latency"].to_numpy(float)[ok] - mean).sum()) / n
            open_steps = np.concatenate([open_steps, steps[~ok]])
            if newest is not None:
                open_steps = open_steps[open_steps > newest]
        if newest is not None:
            last, failed = newest, 0
        failed += len(open_steps)
        state.update((last, n, failed, mean))
        yield pd.DataFrame([(key[0], last, n, failed, mean)], columns=["uid", "last_response", "responses", "consecutive_failures", "mean_latency"])

    return answers.groupBy("uid").applyInPandasWithState(step, f"uid long, {HEALTH}", HEALTH, "update", GroupStateTimeout.NoTimeout)


def alert_stream(alerts: DataFrame, cooldown: int = 10) -> DataFrame:
    """Alerts let through: over `cooldown` steps after the key's last one. alerts: kind, uid, step. Of a batch the different steps are kept."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, rows = (state.get[0] if state.exists else None), []
        steps = np.empty(0, np.int64)
        for f in frames:
            steps = np.union1d(steps, f["step"].to_numpy(np.int64))
        for s in steps.tolist():
            if last is None or s - last > cooldown:
                last = s
                rows.append((key[0], key[1], s))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(rows, columns=["kind", "uid", "step"])

    return alerts.groupBy("kind", "uid").applyInPandasWithState(step, "kind string, uid long, step long", "last long", "append", GroupStateTimeout.NoTimeout)


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event-time window and type; rows later than the watermark are dropped."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, closed once the watermark is past their end; events later than the watermark are dropped and
    counted (late_rows). events: user_id, ts, value."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("ts").alias("last"))


def late_rows(query) -> int:
    """Rows that a query's state operators dropped as too late, over its batches so far."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
