"""Detectors as parameter tables: fit gives a model, score reads it, and a saved one scores alike in any session.

A saved model is a Parquet table of named arrays (model, version, name, kind, shape,
values) in a folder that is written whole and never changed.  Loading checks the schema,
the kind of model and the version of its format."""

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import detect as D

VERSION = 1
SCHEMA = "model string, version int, name string, kind string, shape array<int>, values array<double>, said string"


class ModelError(ValueError):
    """A folder that does not hold the model asked for."""


def save(spark: SparkSession, path: str, model: str, arrays: dict[str, np.ndarray], facts: dict | None = None) -> None:
    """Write a model's arrays and facts (plain JSON) to a new folder; one that is there already is an error."""
    rows = [(model, VERSION, k, str(np.asarray(a).dtype), list(np.shape(a)), np.asarray(a, float).ravel().tolist(), None) for k, a in arrays.items()]
    rows.append((model, VERSION, "", "facts", [], [], json.dumps(facts or {})))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("error").parquet(path)


def load(spark: SparkSession, path: str, model: str) -> tuple[dict[str, np.ndarray], dict]:
    found = spark.read.parquet(path)
    have, want = {(f.name, f.dataType.simpleString()) for f in found.schema}, {tuple(c.split(" ", 1)) for c in SCHEMA.split(", ")}
    if have != want:
        raise ModelError(f"{path}: columns differ: {sorted(have ^ want)}")
    arrays, facts = {}, None
    for r in found.collect():  # a bounded table, by how its model was fitted
        if (r.model, r.version) != (model, VERSION):
            raise ModelError(f"{path}: holds {r.model} of version {r.version}, not {model} of version {VERSION}")
        if r.kind == "facts":
            facts = json.loads(r.said)
        else:
            arrays[r.name] = np.array(r["values"]).astype(r.kind).reshape(r["shape"])
    if facts is None:
        raise ModelError(f"{path}: no facts, so it was not written whole")
    return arrays, facts


def save_forest(spark: SparkSession, path: str, forest: D.Forest, columns: tuple[str, ...]) -> None:
    """All trees end to end, and where each begins."""
    parts = [np.concatenate([t[k] for t in forest.trees]) if forest.trees else np.zeros(0) for k in range(5)]
    begins = np.cumsum([0, *[len(t[0]) for t in forest.trees]])
    save(spark, path, "isolation forest", dict(zip(("feature", "cut", "low", "high", "depth"), parts)) | {"begins": begins}, {"norm": forest.norm, "columns": list(columns)})


def load_forest(spark: SparkSession, path: str) -> tuple[D.Forest, tuple[str, ...]]:
    a, facts = load(spark, path, "isolation forest")
    forest = D.Forest.__new__(D.Forest)
    forest.norm = facts["norm"]
    names = ("feature", "cut", "low", "high", "depth")
    forest.trees = [tuple(a[k][lo:hi] for k in names) for lo, hi in zip(a["begins"][:-1], a["begins"][1:])]
    return forest, tuple(facts["columns"])


class SelfRegion:
    """Negative selection: distance to the nearest of a bounded sample of self rows, beyond the self radius.

    Scores are calibrated so that the highest of a self row maps to 0.3; a self row is at distance 0 from itself,
    so in effect the radius over 0.5 is the range."""

    def __init__(self, own: np.ndarray, columns: tuple[str, ...], radius: float | None = None):
        self.own, self.columns = own, columns
        d = np.sqrt(((own[:, None] - own[None]) ** 2).sum(2)) if len(own) else np.zeros((0, 0))
        np.fill_diagonal(d, np.inf)
        fitted = max(0.05, min(2.0, float(np.quantile(d.min(1), 0.95)))) if len(own) > 1 else 0.15
        self.radius = fitted if radius is None else radius
        top = float(self.raw(own).max()) if len(own) else 0.0
        self.range = top / 0.3 if top > 0 else self.radius / 0.5 if len(own) and self.radius > 0 else 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        best = np.full(len(x), np.inf if len(self.own) else 0.0)
        for lo in range(0, len(self.own), 256):
            best = np.minimum(best, np.sqrt(((x[:, None] - self.own[None, lo : lo + 256]) ** 2).sum(2).min(1)))
        return np.maximum(0.0, best - self.radius)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.raw(x) / self.range, 0.0, 1.0)

    @classmethod
    def fit(cls, own: DataFrame, columns: tuple[str, ...], most: int = 1000, seed: int = 7) -> "SelfRegion":
        """On the first `most` rows in hash order.  own: id, columns."""
        picked = own.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most).collect()
        return cls(np.array([[float(r[c]) for c in columns] for r in picked]).reshape(len(picked), len(columns)), columns)

    def save(self, spark: SparkSession, path: str) -> None:
        save(spark, path, "self region", {"own": self.own}, {"columns": list(self.columns), "radius": self.radius})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SelfRegion":
        a, facts = load(spark, path, "self region")
        return cls(a["own"], tuple(facts["columns"]), facts["radius"])


class Baseline:
    """Scores of normal rows, sorted; at most so many, evenly spaced by rank where there are more."""

    MOST = 10_000

    def __init__(self, values: np.ndarray):
        self.values = np.sort(values)

    @classmethod
    def fit(cls, scores: DataFrame, value: str) -> "Baseline":
        n = scores.count()
        if n <= cls.MOST:
            return cls(np.array([r[0] for r in scores.select(value).collect()], float))
        marks = scores.agg(F.percentile(value, F.array(*[F.lit(k / (cls.MOST - 1)) for k in range(cls.MOST)]))).first()[0]
        return cls(np.array(marks))

    def score(self, v: np.ndarray) -> np.ndarray:
        """Rank from above inside the baseline, deviation from its median over its range outside."""
        n = len(self.values)
        if not n:
            return np.full(len(v), 0.5)
        idx = np.searchsorted(self.values, v, "right")
        spread = self.values[-1] - self.values[0]
        off = np.full(len(v), 0.5) if spread < 1e-10 else np.clip(np.abs(v - self.values[n // 2]) / spread, 0, 1)
        return np.where((idx > 0) & (idx < n), 1 - idx / n, off)

    def deviation(self, v: np.ndarray) -> np.ndarray:
        """Two-sided: distance from the median over the range."""
        n = len(self.values)
        spread = self.values[-1] - self.values[0] if n else 0.0
        return np.full(len(v), 0.5) if spread < 1e-10 else np.clip(np.abs(v - self.values[n // 2]) / spread, 0, 1)

    def save(self, spark: SparkSession, path: str) -> None:
        save(spark, path, "baseline", {"values": self.values})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Baseline":
        return cls(load(spark, path, "baseline")[0]["values"])


def scored(rows: DataFrame, columns: tuple[str, ...], model, name: str = "score") -> DataFrame:
    """rows with what model.score says of their columns, where the rows are."""

    @F.pandas_udf("double")
    def score(vs: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(vs).astype(float)))

    return rows.withColumn(name, score(F.array(*[F.col(c).cast("double") for c in columns])))


def confidence(score: Column) -> Column:
    return text.clip(F.abs(score - 0.5) * 2)
