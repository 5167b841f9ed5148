"""Quality classifier: supervised subword embeddings.

A document is the mean of the learned vectors of its words, of their character
n-grams, and of its word pairs of one word twice (one mark for all of them), hashed
into a fixed number of buckets; a linear layer and a softmax give
the class.  Vectors and layer are trained together by numpy stochastic gradient
descent on a bounded sample of labelled rows (MAX_TRAIN rows, the first in the
order of a hash of doc_id).  Texts are hashed where they are; the driver gets the
buckets of each row and their shares, BUCKETS of eight bytes at most however long the text.  The layer is linear in the mean, so after training
each word adds one number to a document's score, and a whole text costs one
table lookup a word.

Null and empty texts have no words and score what the layer's bias says.  Without
labelled rows of both classes every score is 0.5.  Repeated rows each get their
own row; labels of one doc_id that differ are dropped from training.  Only doc_id
and text of the documents are read, so other columns cannot clash.
"""


import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches

#: Bound of the labelled sample that the model is fitted on.
MAX_TRAIN = 4000
BUCKETS = 1 << 17
DIM = 16
NGRAMS = (3, 4)
EPOCHS = 12
RATE = 0.5
THRESHOLD = 0.3
CACHE_WORDS = 150_000
SLICE = 128  # texts scored at a time


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of the character n-grams of <word>, and which word each belongs to."""
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    start = np.cumsum(size) - size
    # a word's own hash: its code points times powers of an odd number by their places
    powers = np.cumprod(np.full(int(size.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64))
    whole = np.add.reduceat(_mix(codes) * powers[np.arange(len(codes)) - np.repeat(start, size)], start) if len(words) else codes
    buckets, owners = [_mix(whole)], [np.arange(len(words))]
    for n in NGRAMS:
        if len(codes) < n:
            continue
        inside = owner[: len(codes) - n + 1] == owner[n - 1 :]
        h = np.full(len(inside), n, np.uint64)
        for k in range(n):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - n + 1 + k])
        buckets.append(h[inside]), owners.append(owner[: len(inside)][inside])
    return (np.concatenate(buckets) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owners)


#: Bucket of a word that repeats the one before it.
REPEAT = crc32(b"\1repeat") % BUCKETS


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares of all its features."""
    words = (text or "").split()
    counts = Counter(words)
    repeats = sum(map(eq, words, words[1:]))
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    ids, owner = word_features(list(counts))
    weights = np.fromiter(counts.values(), np.float64, len(counts))[owner]
    if repeats:
        ids, weights = np.append(ids, REPEAT), np.append(weights, repeats)
    buckets, at = np.unique(ids, return_inverse=True)
    share = np.bincount(at, weights=weights).astype(np.float32)
    return buckets, share / share.sum()


@dataclass
class Model:
    """weight: what a bucket adds to the log odds of label 1; bias: the rest."""

    weight: np.ndarray
    bias: float

    def scorer(self):
        """A function from texts to scores; it keeps what each word adds, for up to CACHE_WORDS words."""
        sums: dict[str, float] = {}
        sizes: dict[str, int] = {}
        repeat = float(self.weight[REPEAT])

        def score(texts: list[str | None]) -> list[float]:
            parts = [(t or "").split() for t in texts]
            if len(sums) > CACHE_WORDS:
                sums.clear(), sizes.clear()
            new = list({w for p in parts for w in p if w not in sums})
            ids, owner = word_features(new)
            sums.update(zip(new, np.bincount(owner, self.weight[ids], len(new)).tolist()))
            sizes.update(zip(new, np.bincount(owner, minlength=len(new)).tolist()))
            out = []
            for p in parts:
                again = sum(map(eq, p, p[1:]))
                n = sum(map(sizes.__getitem__, p)) + again
                z = self.bias + ((sum(map(sums.__getitem__, p)) + again * repeat) / n if n else 0.0)
                out.append(1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z)))
            return out

        return score


def train(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model:
    return train_rows([text_features(t) for t in texts], labels, epochs, seed)


def train_rows(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Embeddings and a two-class softmax layer by stochastic gradient descent over rows of buckets and shares."""
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, DIM), dtype=np.float32) - 0.5) / DIM)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    counts = np.bincount(labels, minlength=2)
    cost = (len(labels) / (2 * np.maximum(counts, 1))).astype(np.float32)  # both classes weigh the same
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, share = rows[i]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = share @ vectors[ids] if len(ids) else np.zeros(DIM, np.float32)
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            g = p.copy()
            g[labels[i]] -= 1
            g *= rate * cost[labels[i]]
            back = layer.T @ g
            layer -= np.outer(g, hidden)
            bias -= g
            if len(ids):
                # unique buckets, so this adds up right; scaled by document length as in a mean over features
                vectors[ids] -= np.outer(share * len(ids) ** 0.5, back)
    toward = layer[1] - layer[0]
    prior = math.log(max(counts[1], 1) / max(counts[0], 1))  # back from equal weights
    return Model((vectors @ toward).astype(np.float32), float(bias[1] - bias[0]) + prior)


def remainder(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, all_folds: bool = False) -> Model:
    """Model from at most max_train labelled rows outside the held-out fifth."""
    marked = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    if not all_folds:
        marked = marked.where(remainder(F.col("doc_id")) != 0)
    picked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).drop("other")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    @F.pandas_udf("struct<buckets:binary,shares:binary>")
    def features(texts: pd.Series) -> pd.DataFrame:
        got = map(text_features, texts)
        return pd.DataFrame([(b.astype(np.int32).tobytes(), s.tobytes()) for b, s in got], columns=["buckets", "shares"])

    hashed = small_batches(rows).select("doc_id", "quality", features("text").alias("f"))
    got = sorted(((r.doc_id, int(r.quality), np.frombuffer(r.f.buckets, np.int32), np.frombuffer(r.f.shares, np.float32)) for r in hashed.toLocalIterator()), key=lambda r: r[0])
    return train_rows([r[2:] for r in got], [r[1] for r in got])


def _scorer(docs: DataFrame, model: Model):
    spark = small_batches(docs).sparkSession
    shipped = spark.sparkContext.broadcast((model.weight, model.bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Model(*shipped.value).scorer()
        for texts in batches:
            rows = texts.tolist()
            yield pd.Series([x for i in range(0, len(rows), SLICE) for x in of(rows[i : i + SLICE])], dtype="float64")
        del of
        release()

    return score


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    held = remainder(F.col("doc_id")) == 0
    return docs.select("doc_id", held.alias("held_out"), _scorer(docs, model)("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns of any names, without the rows that score below the threshold."""
    scored = docs.select(F.struct("*").alias("doc"), _scorer(docs, model)("text").alias("score"))
    return scored.where(F.col("score") >= threshold).select("doc.*")
