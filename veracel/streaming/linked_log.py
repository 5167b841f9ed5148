"""Checked append to a hash-linked log, in batches or from a stream.

A log is a folder: records/first=<round> holds the records of one append as JSON lines,
and heads an empty file for each append, whose name is the last round, the batch and the
last hash.  An append reads the newest head only, never the records before it.  It
refuses rounds that do not go on from the head, or whose previous hash or own hash is
wrong.  Records are written before the head; a batch that is tried again writes the same
folder anew, and one whose head is there is done.  Readers see rounds up to the head.
"""

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chain
from ..operators.chain import GENESIS, IntegrityError
from ..sources import marks

NO_BATCH = -1


class Head(NamedTuple):
    round_index: int
    batch: int
    hash: str


START = Head(-1, NO_BATCH, GENESIS)


def score_links(records: DataFrame, head: Head) -> DataFrame:
    """round_index, ok, reason of round records with scores that go on from the head."""
    return chain.verify(records, head.round_index + 1, head.hash)


SYNDROME_FIELDS = ("anomaly_class", "bucket_signature", "codeword_digest", "domain", "prev_hash", "record_type", "round_index", "schema_version", "syndrome_digest")


def syndrome_hash(records: DataFrame) -> DataFrame:
    """records with hash: SHA-256 of each record's canonical JSON."""

    @F.pandas_udf("string")
    def of(rows: pd.DataFrame) -> pd.Series:
        out = []
        for r in rows.to_dict("records"):
            r["bucket_signature"] = [int(v) for v in r["bucket_signature"]]
            out.append(chain.record_hash({k: int(v) if k in ("round_index", "schema_version") else v for k, v in r.items()}))
        return pd.Series(out)

    return records.withColumn("hash", of(F.struct(*SYNDROME_FIELDS)))


def syndrome_links(records: DataFrame, head: Head) -> DataFrame:
    """round_index, ok, reason of syndrome records that go on from the head."""
    own = syndrome_hash(records.drop("hash")).select("round_index", F.col("hash").alias("own"))
    w = Window.orderBy("round_index")  # a row a round
    seen = records.join(own, "round_index").withColumns({"place": F.row_number().over(w) + head.round_index, "before": F.coalesce(F.lag("own").over(w), F.lit(head.hash))})
    why = F.when(F.col("round_index") != F.col("place"), "index_gap").when(F.col("own") != F.col("hash"), "hash_mismatch").when(F.col("prev_hash") != F.col("before"), "broken_link")
    return seen.select("round_index", why.isNull().alias("ok"), why.alias("reason"))


class LinkedLog:
    """A log at a path; links(records, head) says of each new record whether it goes on from the head."""

    def __init__(self, spark: SparkSession, path: str, links: Callable[[DataFrame, Head], DataFrame] = score_links):
        self.spark, self.path, self.links = spark, path, links

    def _heads(self) -> list[Head]:
        return [Head(int(r), int(b), h) for r, b, h in (n.split(".") for n in marks.names(self.spark, f"{self.path}/heads"))]

    def head(self) -> Head:
        return max(self._heads(), default=START)

    def append(self, records: DataFrame, batch: int = NO_BATCH) -> Head:
        """Append whole records, in any order of rows.  A batch whose number is not above the newest one's is done already."""
        head = self.head()
        if batch != NO_BATCH and batch <= head.batch:
            return head
        ends = records.agg(F.min("round_index").alias("first"), F.max_by("hash", "round_index").alias("hash"), F.max("round_index").alias("last")).first()
        if ends.last is None:
            return head
        bad = self.links(records, head).where("not ok").orderBy("round_index").first()
        if bad:
            raise IntegrityError(f"round {bad.round_index}: {bad.reason}; the log ends with round {head.round_index}")
        records.write.mode("overwrite").json(f"{self.path}/records/first={ends.first:020d}")
        new = Head(ends.last, max(batch, head.batch), ends.hash)
        if not marks.mark(self.spark, f"{self.path}/heads/{new.round_index:020d}.{new.batch}.{new.hash}"):
            raise IntegrityError(f"round {ends.last} was appended by another writer")
        for old in self._heads():
            if old.round_index < head.round_index:  # the newest two stay
                marks.remove(self.spark, f"{self.path}/heads/{old.round_index:020d}.{old.batch}.{old.hash}")
        return new

    def read(self, schema: str) -> DataFrame:
        """Records up to the head."""
        head = self.head()
        if head == START:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.path}/records/*").where(F.col("round_index") <= head.round_index)

    def verify(self, schema: str) -> DataFrame:
        """round_index, ok, reason of every record, and of the head if the last record is not the one it names."""
        head, rows = self.head(), self.read(schema)
        found = self.links(rows, START)
        last = rows.where(F.col("round_index") == head.round_index).select("hash").first()
        if head != START and (last is None or last.hash != head.hash):
            found = found.where(F.col("round_index") != head.round_index).unionByName(self.spark.createDataFrame([(head.round_index, False, "not_the_head")], found.schema))
        return found


def linked_scores(scores: DataFrame, head: Head, alpha: float = 0.1) -> DataFrame:
    """Round records of new rounds, linked from the head.  scores: round_index, uid, raw_reward, ema_score, hotkey."""
    rows = scores.withColumn("pos", F.col("uid")).select("round_index", "pos", "uid", "raw_reward", "ema_score", "hotkey")
    heads = chain.linked(chain._pieces(rows, alpha), head.hash)
    bodies = scores.groupBy("round_index").agg(F.array_sort(F.collect_list(F.struct("uid", "raw_reward", "ema_score", "hotkey"))).alias("scores"))
    return heads.join(bodies, "round_index").select("round_index", F.lit(alpha).alias("ema_alpha"), "scores", "prev_hash", "hash", "n_scores")


def checked_rounds(rounds: DataFrame) -> DataFrame:
    """rounds with reason: why a round cannot be recorded, else null.

    rounds: round_index, uids, rewards, hotkeys, ema_scores (lists of one length; ema_scores may be null as a whole)."""
    lengths = [F.size(c) != F.size("uids") for c in ("rewards", "hotkeys")] + [F.col("ema_scores").isNotNull() & (F.size("ema_scores") != F.size("uids"))]
    odd = lambda c: F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    missing = lambda c: F.exists(c, lambda v: v.isNull())
    why = F.when(F.col("round_index").isNull(), "no_round").when(F.col("uids").isNull() | F.col("rewards").isNull() | F.col("hotkeys").isNull(), "missing_list")
    why = why.when(lengths[0] | lengths[1] | lengths[2], "lengths_differ").when(missing("uids") | missing("hotkeys"), "missing_key")
    return rounds.withColumn("reason", why.when(odd("rewards"), "reward_not_finite").when(F.coalesce(odd("ema_scores"), F.lit(False)), "ema_not_finite"))


def recorded_scores(rounds: DataFrame) -> DataFrame:
    """round_index, uid, raw_reward, ema_score, hotkey of rounds given as lists, ready for linked_scores; without ema_scores the EMA is the raw reward.

    A round that cannot be recorded raises, before anything is written."""
    bad = checked_rounds(rounds).where("reason is not null").orderBy("round_index").first()
    if bad:
        raise IntegrityError(f"round {bad.round_index}: {bad.reason}")
    each = F.arrays_zip(F.col("uids").alias("uid"), F.col("rewards").alias("raw_reward"), F.coalesce("ema_scores", "rewards").alias("ema_score"), F.col("hotkeys").alias("hotkey"))
    return rounds.select("round_index", F.inline(each))


def append_scores(stream: DataFrame, log: LinkedLog, checkpoint: str, alpha: float = 0.1):
    """Append the whole rounds of each micro-batch of a stream of scores; returns the query, run until the input is drained."""

    def batch(df: DataFrame, epoch: int) -> None:
        if epoch > log.head().batch:
            log.append(linked_scores(df, log.head(), alpha), epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def linked_syndromes(rows: DataFrame, head: Head) -> DataFrame:
    """Syndrome records linked from the head, one a round.  rows: the fields but prev_hash, small rows linked in order of round."""
    fields = [c for c in SYNDROME_FIELDS if c != "prev_hash"]
    kinds = dict(rows.select(*fields).dtypes)
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in (*SYNDROME_FIELDS, "hash"))

    def link(batches):
        prev = head.hash
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                r["bucket_signature"] = [int(v) for v in r["bucket_signature"]]
                r = {k: int(v) if k in ("round_index", "schema_version") else v for k, v in r.items()} | {"prev_hash": prev}
                prev = chain.record_hash(r)
                out.append(r | {"hash": prev})
            yield pd.DataFrame(out, columns=[*SYNDROME_FIELDS, "hash"])

    return rows.select(*fields).repartition(1).sortWithinPartitions("round_index").mapInPandas(link, schema)


def preflight(spark: SparkSession, path: str, enabled: bool = True, schema: str = chain.RECORD, links=score_links) -> Head | None:
    """Before a start: None where auditing is off; else the folder is made and the log checked (raises where it was tampered with).
    A log that is not there or empty begins anew."""
    if not enabled:
        return None
    marks.make_folder(spark, path)
    log = LinkedLog(spark, path, links)
    bad = log.verify(schema).where("not ok").orderBy("round_index").first()
    if bad:
        raise IntegrityError(f"round {bad.round_index}: {bad.reason}")
    return log.head()
