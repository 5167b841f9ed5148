"""Feedback per scorer as state of a stream: smoothed score, the last scores, and weights that adapt to outcomes.

State is kept for each (uid, hotkey), in a value (smoothed score, count, weights) and a
list (the last RING scores); a uid with a new hotkey begins anew.  batch_feedback is the
same fold over a table, for comparison."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import chain
from ..operators.history import in_order

VALUE = T.StructType([T.StructField("ema", T.DoubleType()), T.StructField("n", T.LongType()), *[T.StructField(f"w{i}", T.DoubleType()) for i in range(3)]])
ITEM = T.StructType([T.StructField("score", T.DoubleType())])

RING = 50
START = (1 / 3, 1 / 3, 1 / 3)
OUT = "uid long, hotkey string, step long, ema double, recent double, n long, w0 double, w1 double, w2 double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold:
    """One key's state and what a row does to it."""

    def __init__(self, ema: float = 0.0, n: int = 0, weights=START, ring=()):
        self.ema, self.n, self.weights, self.ring = ema, n, list(weights), list(ring)

    def step(self, score: float, x: list[float], outcome: float | None, alpha: float) -> tuple:
        score = 0.0 if score is None or score != score else score
        self.ema = alpha * score + (1 - alpha) * self.ema
        self.n += 1
        self.ring = [*self.ring, score][-RING:]
        if outcome is not None and outcome == outcome:
            self.weights = chain.adapt(self.weights, x, outcome, alpha)
        return self.ema, sum(self.ring) / len(self.ring), self.n, *self.weights


class Feedback(StatefulProcessor):
    def __init__(self, alpha: float = 0.1):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", VALUE)
        self.ring = handle.getListState("ring", ITEM)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """A batch's rows of the key, in order of step."""
        frame = pd.concat(list(rows)).sort_values("step", kind="stable")
        ema, n, *weights = self.value.get() if self.value.exists() else (0.0, 0, *START)
        fold = Fold(ema, n, weights, [r[0] for r in self.ring.get()] if self.ring.exists() else ())
        out = [
            (key[0], key[1], s, *fold.step(score, list(x), o, self.alpha)) for s, score, x, o in zip(frame["step"].tolist(), frame["score"].tolist(), frame["x"], frame["outcome"].tolist())
        ]
        self.value.update((fold.ema, fold.n, *fold.weights))
        self.ring.put([(float(s),) for s in fold.ring])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def feedback_stream(rows: DataFrame, alpha: float = 0.1) -> DataFrame:
    """uid, hotkey, step and the state after it, of a stream (uid, hotkey, step, score, x, outcome) whose steps do not come back later."""
    return rows.groupBy("uid", "hotkey").transformWithStateInPandas(Feedback(alpha), T._parse_datatype_string(OUT), "append", "none")


def batch_feedback(rows: DataFrame, alpha: float = 0.1) -> DataFrame:
    """The same of a table: each key's rows pass in order, and only its state is held."""
    import pyarrow as pa

    names = [c.split()[0] for c in OUT.split(", ")]

    def run(batches):
        at, fold = None, Fold()
        for b in batches:
            out = []
            for uid, hotkey, step, score, x, outcome in zip(*(b.column(c).to_pylist() for c in ("uid", "hotkey", "step", "score", "x", "outcome"))):
                if (uid, hotkey) != at:
                    at, fold = (uid, hotkey), Fold()
                out.append((uid, hotkey, step, *fold.step(score, x, outcome, alpha)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(names), kinds)], names=names)

    return in_order(rows.select("uid", "hotkey", "step", "score", "x", "outcome"), ("uid", "hotkey"), ("step",), run, OUT)


def with_provider(spark):
    """A context in which new streams keep their state in RocksDB, as this state needs; the session's setting comes back after it."""
    from contextlib import contextmanager

    @contextmanager
    def inside():
        key = "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(key, None)
        spark.conf.set(key, PROVIDER)
        try:
            yield
        finally:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)

    return inside()
