"""Checked append, snapshots, state of streams and sessions."""

import os
import shutil
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from veracel.operators import chain
from veracel.operators.chain import GENESIS, IntegrityError
from veracel.sources import snapshots
from veracel.streaming import feedback, linked_log
from veracel.streaming.linked_log import LinkedLog, linked_scores, linked_syndromes, preflight, syndrome_links
from veracel.streaming.state import late_rows, session_stream

SCORES = [(r, u, (u * 7 + r) % 11 / 10, (u + r) % 5 / 10, f"hk{u}") for r in range(7) for u in range(4)]
KINDS = "round_index long, uid long, raw_reward double, ema_score double, hotkey string"


def table(spark, rounds):
    return spark.createDataFrame([s for s in SCORES if s[0] in rounds], KINDS)


def plain_log():
    """Records and hashes as plain Python makes them."""
    out, prev = [], GENESIS
    for r in sorted({s[0] for s in SCORES}):
        scores = [dict(zip(("uid", "raw_reward", "ema_score", "hotkey"), s[1:])) for s in SCORES if s[0] == r]
        record = {"round_index": r, "ema_alpha": 0.1, "scores": scores, "prev_hash": prev}
        prev_was, prev = prev, chain.record_hash(record)
        out.append((r, prev_was, prev))
    return out


def rows_of(log):
    return sorted((r.round_index, r.prev_hash, r.hash) for r in log.read(chain.RECORD).collect())


def test_appends_equal_one_build_and_refuse_what_does_not_link(spark, tmp_path):
    log = LinkedLog(spark, f"{tmp_path}/log")
    assert log.read(chain.RECORD).count() == 0 and log.head().hash == GENESIS
    for rounds in ((0, 1, 2), (3,), (4, 5, 6)):
        log.append(linked_scores(table(spark, rounds), log.head()))
    assert rows_of(log) == plain_log()
    assert log.verify(chain.RECORD).where("not ok").count() == 0
    more = spark.createDataFrame([(7, 1, 0.5, 0.5, "hk1")], KINDS)
    good = linked_scores(more, log.head())
    wrong = {
        "index_gap": good.withColumn("round_index", F.lit(9).cast("long")), "broken_link": linked_scores(more, log.head()._replace(hash="1" * 64)),
        "hash_mismatch": good.withColumn("ema_alpha", F.lit(0.2)),
    }
    for reason, records in wrong.items():
        with pytest.raises(IntegrityError, match=reason if reason != "index_gap" else "index_gap|hash_mismatch"):
            log.append(records)
    with pytest.raises(IntegrityError):
        log.append(linked_scores(table(spark, (6,)), log.head()._replace(round_index=5)))
    assert rows_of(log) == plain_log()
    log.append(good, batch=3)
    assert log.append(linked_scores(spark.createDataFrame([(8, 1, 0.5, 0.5, "hk1")], KINDS), log.head()), batch=3).round_index == 7  # done already


def test_an_append_reads_no_earlier_record(spark, tmp_path):
    log = LinkedLog(spark, f"{tmp_path}/log")
    log.append(linked_scores(table(spark, (0, 1, 2)), log.head()))
    shutil.rmtree(f"{tmp_path}/log/records")
    assert log.append(linked_scores(table(spark, (3,)), log.head())).round_index == 3


def test_a_torn_append_is_not_seen_and_is_made_good(spark, tmp_path):
    log = LinkedLog(spark, f"{tmp_path}/log")
    log.append(linked_scores(table(spark, (0, 1)), log.head()), batch=0)
    records = linked_scores(table(spark, (2, 3)), log.head())
    records.write.json(f"{tmp_path}/log/records/first={2:020d}")  # written, but no head: the executor was lost
    assert len(rows_of(log)) == 2
    log.append(records, batch=1)
    log.append(records, batch=1)
    assert rows_of(log) == plain_log()[:4]


def test_tampering_is_told_by_round(spark, tmp_path):
    log = LinkedLog(spark, f"{tmp_path}/log")
    for rounds in ((0, 1, 2), (3, 4), (5, 6)):
        log.append(linked_scores(table(spark, rounds), log.head()))
    folder = f"{tmp_path}/log/records/first={3:020d}"
    for f in os.listdir(folder):
        if f.endswith(".json"):
            text = open(f"{folder}/{f}").read()
            open(f"{folder}/{f}", "w").write(text.replace('"hotkey":"hk2"', '"hotkey":"hk9"', 1))
            crc = f"{folder}/.{f}.crc"
            if os.path.exists(crc):
                os.remove(crc)
    bad = {r.round_index: r.reason for r in log.verify(chain.RECORD).where("not ok").collect()}
    assert "hash_mismatch" in bad.values() and min(bad) in (3, 4)
    with pytest.raises(IntegrityError):
        preflight(spark, f"{tmp_path}/log")
    shutil.rmtree(f"{tmp_path}/log/records/first={5:020d}")
    assert log.verify(chain.RECORD).where("reason = 'not_the_head'").count() == 1


def test_preflight(spark, tmp_path):
    assert preflight(spark, f"{tmp_path}/off", enabled=False) is None and not os.path.exists(f"{tmp_path}/off")
    assert preflight(spark, f"{tmp_path}/new") == linked_log.START and os.path.isdir(f"{tmp_path}/new")
    log = LinkedLog(spark, f"{tmp_path}/new")
    log.append(linked_scores(table(spark, (0, 1)), log.head()))
    assert preflight(spark, f"{tmp_path}/new") == log.head()


def test_appends_from_a_stream(spark, tmp_path):
    log = LinkedLog(spark, f"{tmp_path}/log")
    for rounds in ((0, 1), (2, 3, 4), (5, 6)):
        table(spark, rounds).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(KINDS).parquet(f"{tmp_path}/in")
        linked_log.append_scores(stream, log, f"{tmp_path}/state").awaitTermination()
    assert rows_of(log) == plain_log()


def test_syndrome_records_link(spark, tmp_path):
    rows = [(r, "syndrome", 1, f"c{r}", f"s{r}", [1, 0, -1], "self", "bio") for r in range(5)]
    kinds = "round_index long, record_type string, schema_version int, codeword_digest string, syndrome_digest string, bucket_signature array<int>, anomaly_class string, domain string"
    log = LinkedLog(spark, f"{tmp_path}/log", syndrome_links)
    for part in (rows[:2], rows[2:]):
        log.append(linked_syndromes(spark.createDataFrame(part[::-1], kinds), log.head()))
    schema = f"{kinds}, prev_hash string, hash string"
    got, prev = sorted(log.read(schema).collect(), key=lambda r: r.round_index), GENESIS
    for r, row in zip(got, rows):
        want = dict(zip((k.split()[0] for k in kinds.split(", ")), row)) | {"prev_hash": prev}
        prev_was, prev = prev, chain.record_hash(want)
        assert (r.prev_hash, r.hash) == (prev_was, prev)
    assert log.verify(schema).where("not ok").count() == 0
    with pytest.raises(IntegrityError, match="broken_link"):
        log.append(linked_syndromes(spark.createDataFrame([(5, *rows[0][1:])], kinds), log.head()._replace(hash=GENESIS)))


def test_snapshots(spark, tmp_path):
    base, need = f"{tmp_path}/state", {"scores": "uid long, score double", "hotkeys": "uid long, hotkey string"}
    tables = lambda k: {"scores": spark.createDataFrame([(i, i / k) for i in range(20)], need["scores"]), "hotkeys": spark.createDataFrame([(1, f"h{k}")], need["hotkeys"])}
    default = {"scores": spark.createDataFrame([(0, 0.0)], need["scores"])}
    got, facts, why = snapshots.restore(spark, base, need, default)
    assert got["scores"].count() == 1 and got["hotkeys"].count() == 0 and facts == {} and "no snapshot" in why
    for k in (1, 2, 3):
        snapshots.save(spark, base, tables(k), {"step": k})
    got, facts, why = snapshots.restore(spark, base, need)
    assert why is None and facts == {"step": 3} and got["hotkeys"].first().hotkey == "h3" and got["scores"].count() == 20
    assert len(os.listdir(f"{base}/snapshots")) == 2
    tables(4)["scores"].write.parquet(f"{base}/snapshots/torn/scores")  # lost before its pointer
    assert snapshots.restore(spark, base, need)[1] == {"step": 3}
    assert "KeyError" in snapshots.restore(spark, base, need | {"peers": "uid long"})[2] or "peers" in snapshots.restore(spark, base, need | {"peers": "uid long"})[2] or snapshots.restore(spark, base, need | {"peers": "uid long"})[2]
    assert "columns differ" in snapshots.restore(spark, base, {"scores": "uid string"})[2]
    newest = sorted(f for f in os.listdir(f"{base}/pointers") if not f.startswith("."))[-1].split(".")[1]
    part = next(f for f in os.listdir(f"{base}/snapshots/{newest}/scores") if f.startswith("part"))
    shutil.rmtree(f"{base}/snapshots/{newest}/hotkeys")
    got, facts, why = snapshots.restore(spark, base, need, default)
    assert why and got["scores"].count() == 1 and facts == {} and part
    with pytest.raises(snapshots.SnapshotError):
        snapshots.load(spark, base, need)


def plain_feedback(rows, alpha=0.1):
    state, out = defaultdict(lambda: [0.0, [], [1 / 3] * 3]), {}
    for uid, hotkey, step, score, x, outcome in sorted(rows, key=lambda r: r[2]):
        s = state[uid, hotkey]
        s[0] = alpha * score + (1 - alpha) * s[0]
        s[1] = [*s[1], score][-50:]
        s[2] = chain.adapt(s[2], x, outcome, alpha)
        out[uid, hotkey, step] = (s[0], sum(s[1]) / len(s[1]), *s[2])
    return out


def test_feedback_as_state_of_a_stream(spark, tmp_path):
    """Three micro-batches, a busy key, keys that change: the stream, the table and the plain fold agree."""
    rows = [(u, f"h{u}-{s // 90}", s * 10 + u, (s * 37 + u) % 100 / 100, [s % 3 / 3, u / 5, 0.5], 1.0 if (s + u) % 3 else -1.0) for u in range(3) for s in range(150 if u else 260)]
    kinds = "uid long, hotkey string, step long, score double, x array<double>, outcome double"
    want = plain_feedback(rows)
    batch = {(r.uid, r.hotkey, r.step): (r.ema, r.recent, r.w0, r.w1, r.w2) for r in feedback.batch_feedback(spark.createDataFrame(rows, kinds).repartition(5)).collect()}
    out, got = f"{tmp_path}/out", {}
    with feedback.with_provider(spark):
        for low, high in ((0, 600), (600, 1300), (1300, 10_000)):
            spark.createDataFrame([r for r in rows if low <= r[2] < high], kinds).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
            stream = feedback.feedback_stream(spark.readStream.schema(kinds).parquet(f"{tmp_path}/in"))
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {(r.uid, r.hotkey, r.step): (r.ema, r.recent, r.w0, r.w1, r.w2) for r in spark.read.parquet(out).collect()}
    assert set(got) == set(want) == set(batch) == {r[:3] for r in rows}
    for k, w in want.items():
        assert got[k] == pytest.approx(w) and batch[k] == pytest.approx(w)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != feedback.PROVIDER


def test_sessions_of_a_stream_and_late_rows(spark, tmp_path):
    kinds = "user_id long, ts timestamp, value double"
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    batches = [[(1, 0), (1, 20), (2, 5)], [(1, 45), (2, 200), (1, 210)], [(2, 205)], [(1, 50)], [(3, 500)]]  # minute 50 is late after minute 210
    for k, rows in enumerate(batches):
        spark.createDataFrame([(u, at(m), 1.0) for u, m in rows], "user_id long, ts string, value double").selectExpr("user_id", "cast(ts as timestamp) ts", "value").coalesce(1).write.parquet(f"{tmp_path}/in/b={k}")
    stream = session_stream(spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"))
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.user_id, r.w.start.strftime("%H:%M"), r.last.strftime("%H:%M"), r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "00:00", "00:45", 3), (1, "03:30", "03:30", 1), (2, "00:05", "00:05", 1), (2, "03:20", "03:25", 2)]
    assert late_rows(query) == 1
