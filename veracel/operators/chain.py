"""Hash-linked audit log, syndromes, and order-dependent folds."""

import hashlib
import json
import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .history import ema, in_order

GENESIS = "0" * 64

# Classes of signatures.
SYNDROMES = {
    "-1,-1,-1,-1,-1,-1,-1,-1": "total_collapse", "0,0,0,0,0,0,0,0": "self",
    "1,0,1,0,1,0,1,0": "alternating_spike", "1,1,1,1,1,1,1,1": "saturation_storm",
}


class IntegrityError(ValueError):
    """A log whose records do not link."""


def canonical(value) -> str:
    """JSON with sorted keys, no blanks, shortest floats; NaN and infinities are errors."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def record_hash(record: dict) -> str:
    return hashlib.sha256(canonical(record).encode()).hexdigest()


RECORD = "round_index long, ema_alpha double, scores array<struct<uid:bigint,raw_reward:double,ema_score:double,hotkey:string>>, prev_hash string, hash string, n_scores long"
ENTRY = "round_index long, ema_alpha double, pos long, n long, body string"
HEAD = "round_index long, n_scores long, prev_hash string, hash string"
PIECE_CHARS = 1 << 16


def entries(rewards: DataFrame, order: str, alpha: float = 0.1) -> DataFrame:
    """round_index, ema_alpha, pos, n, body: the scores of each round as canonical JSON, sorted by uid, in pieces.

    rewards: order, uid, reward.  EMA runs per uid; rows are then sorted by round and uid over all tasks, each of
    which writes its own rows as pieces of about `PIECE_CHARS`.  A reward that is not finite is an error."""
    return _pieces(_scores(rewards, order, alpha), alpha)


def _scores(rewards: DataFrame, order: str, alpha: float) -> DataFrame:
    smooth = ema(rewards.select("uid", order, "reward"), order, "reward", "uid", alpha=alpha)
    places = rewards.select(order).distinct().select(order, (F.row_number().over(Window.orderBy(order)) - 1).cast("long").alias("round_index"))  # a row per round
    named = smooth.join(places, order)
    return named.select("round_index", F.col("uid").alias("pos"), "uid", F.col("reward").alias("raw_reward"), F.col("ema").alias("ema_score"), F.concat(F.lit("hk"), F.col("uid").cast("string")).alias("hotkey"))


def _pieces(scores: DataFrame, alpha: float | None = None) -> DataFrame:
    """Pieces of the rounds' scores; without alpha it is a column, and a piece with a score that is not finite has no body."""
    fields = ("uid", "raw_reward", "ema_score", "hotkey")

    def write(batches):
        at, first, n, body, size = None, 0, 0, [], 0
        for b in batches:
            out = []
            for r in b.to_pylist():
                here = (r["round_index"], alpha if alpha is not None else r["ema_alpha"])
                if n and (here != at or size >= PIECE_CHARS):
                    out.append((*at, first, n, None if None in body else ",".join(body)))
                    n, body, size = 0, [], 0
                if not n:
                    at, first = here, r["pos"]
                finite = all(math.isfinite(v) for v in r.values() if isinstance(v, float))
                text = canonical({k: r[k] for k in fields}) if finite or alpha is not None else None
                body.append(text)
                n, size = n + 1, size + len(text or "")
            yield _batch(out, ENTRY)
        if n:
            yield _batch([(*at, first, n, None if None in body else ",".join(body))], ENTRY)

    return scores.repartitionByRange("round_index", "pos").sortWithinPartitions("round_index", "pos").mapInArrow(write, ENTRY)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names=list(names))


def _open(index: int, alpha: float, prev: str):
    """A record's hash up to its scores: keys come in order, so all but the scores stand before them."""
    return hashlib.sha256(canonical({"ema_alpha": alpha, "prev_hash": prev, "round_index": index})[:-1].encode() + b',"scores":[')


def linked(rows: DataFrame, prev_hash: str = GENESIS) -> DataFrame:
    """round_index, n_scores, prev_hash, hash of rounds linked by hash, the first one to prev_hash. rows: entries.

    A record's hash covers the hash before it ahead of its scores, so by the log's format rounds are hashed one after
    the other: one ordered pass feeds finished pieces to the hash and holds one of them at a time."""

    def link(batches):
        prev, at, h, n = prev_hash, None, None, 0
        for b in batches:
            out = []
            for index, alpha, count, body in zip(*(b.column(c).to_pylist() for c in ("round_index", "ema_alpha", "n", "body"))):
                if index != at:
                    if h is not None:
                        h.update(b"]}")
                        out.append((at, n, prev, h.hexdigest()))
                        prev = h.hexdigest()
                    at, h, n = index, _open(index, alpha, prev), 0
                h.update((("," if n else "") + body).encode())
                n += count
            yield _batch(out, HEAD)
        if h is not None:
            h.update(b"]}")
            yield _batch([(at, n, prev, h.hexdigest())], HEAD)

    return rows.repartition(1).sortWithinPartitions("round_index", "pos").mapInArrow(link, HEAD)


def verified(heads: DataFrame, rows: DataFrame, first: int = 0, prev_hash: str = GENESIS) -> DataFrame:
    """round_index, ok and why not, of rounds from `first` on that go on from prev_hash. Each round is hashed by itself from its pieces and the stored hash before it; then
    links are compared, one small row per round. heads: round_index, prev_hash, hash; rows: entries."""

    def own(batches):
        at, h, n, bad = None, None, 0, False
        for b in batches:
            out = []
            for index, alpha, prev, body in zip(*(b.column(c).to_pylist() for c in ("round_index", "ema_alpha", "prev_hash", "body"))):
                if h is None or index != at:
                    if h is not None:
                        h.update(b"]}")
                        out.append((at, "" if bad else h.hexdigest()))
                    at, h, n, bad = index, _open(index, alpha, prev), 0, False
                bad = bad or body is None
                h.update((("," if n else "") + (body or "")).encode())
                n += 1
            yield _batch(out, "round_index long, own string")
        if h is not None:
            h.update(b"]}")
            yield _batch([(at, "" if bad else h.hexdigest())], "round_index long, own string")

    stored = heads.select("round_index", "prev_hash", "hash")
    pieces = rows.join(stored.select("round_index", "prev_hash"), "round_index").select("round_index", "ema_alpha", "prev_hash", "pos", "body")
    seen = stored.join(in_order(pieces, ("round_index",), ("pos",), own, "round_index long, own string"), "round_index", "left")
    w = Window.orderBy("round_index")
    seen = seen.withColumns({"place": F.row_number().over(w) - 1 + first, "before": F.coalesce(F.lag("own").over(w), F.lit(prev_hash))})
    why = F.when(F.col("round_index") != F.col("place"), "index_gap").when(~F.col("own").eqNullSafe(F.col("hash")), "hash_mismatch").when(F.col("prev_hash") != F.col("before"), "broken_link")
    return seen.select("round_index", why.isNull().alias("ok"), why.alias("reason"))


def replay(rewards: DataFrame, order: str, alpha: float = 0.1) -> DataFrame:
    """Whole round records for a log file, which holds a round in a line, so its scores must fit one row; `entries` and `linked` have no such bound."""
    scores = _scores(rewards, order, alpha)
    heads = linked(_pieces(scores, alpha))
    bodies = scores.groupBy("round_index").agg(F.array_sort(F.collect_list(F.struct("uid", "raw_reward", "ema_score", "hotkey"))).alias("scores"))
    return heads.join(bodies, "round_index").select("round_index", F.lit(alpha).alias("ema_alpha"), "scores", "prev_hash", "hash", "n_scores")


def verify(log: DataFrame, first: int = 0, prev_hash: str = GENESIS) -> DataFrame:
    """round_index, ok and why not, of whole round records; a record without scores counts as one with a wrong hash."""
    each = log.select("round_index", "ema_alpha", F.posexplode("scores").alias("pos", "s")).select("round_index", "ema_alpha", F.col("pos").cast("long").alias("pos"), "s.uid", "s.raw_reward", "s.ema_score", "s.hotkey")
    return verified(log, _pieces(each), first, prev_hash)


def assert_intact(log: DataFrame) -> None:
    bad = verify(log).where("not ok").orderBy("round_index").first()
    if bad:
        raise IntegrityError(f"round {bad.round_index}: {bad.reason}")


def classified(signatures: DataFrame, key: str, domain: str = "generic") -> DataFrame:
    """key, signature, class and digest of ternary signatures."""
    lookup = F.create_map(*[F.lit(x) for kv in SYNDROMES.items() for x in kv])
    payload = F.concat(F.lit('{"bucket_signature":['), F.col("signature"), F.lit(f'],"domain":"{domain}","schema_version":1}}'))
    return signatures.select(key, "signature", F.coalesce(F.try_element_at(lookup, F.col("signature")), F.lit("unclassified")).alias("class"), F.sha2(payload, 256).alias("digest"))


def adapt(weights: list[float], features: list[float], outcome: float, alpha: float = 0.1, low: float = 0.05, high: float = 0.5) -> list[float]:
    """Weights after one outcome: EMA towards importance, then bounds and a constant sum, in five passes at most."""
    total = sum(weights)
    new = [alpha * abs(f * outcome) + (1 - alpha) * w for w, f in zip(weights, features)]
    if len(new) == 1:
        return [total]
    for _ in range(5):
        new = [min(high, max(low, w)) for w in new]
        new = [w * total / sum(new) for w in new]
        if all(low - 1e-9 <= w <= high + 1e-9 for w in new):
            return new
    return [total / len(new)] * len(new)


def adapted(outcomes: DataFrame, start: tuple[float, ...] = (1 / 3, 1 / 3, 1 / 3)) -> DataFrame:
    """Final weights of each domain after its outcomes in order of event_id.

    The fold carries only the weights; rows reach it sorted, batch by batch, one domain after another."""
    def run(batches):
        state: dict[str, list[float]] = {}
        for b in batches:
            for domain, x, outcome in zip(b["domain"], b["x"], b["outcome"]):
                state[domain] = adapt(state.get(domain, list(start)), list(x), outcome)
        yield pd.DataFrame([(d, *map(lambda v: round(v, 9), w)) for d, w in state.items()], columns=["domain", "w0", "w1", "w2"])

    n = int(outcomes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return outcomes.repartition(n, "domain").sortWithinPartitions("domain", "event_id").mapInPandas(run, "domain string, w0 double, w1 double, w2 double")
