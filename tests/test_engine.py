"""Set-based forms against the fold, durable tables, sessions, jobs, snapshots and the stream."""

import random
import time
import warnings
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keyloom.functions import codec
from keyloom.jobs import Scheduler
from keyloom.model import COMMAND, KeyspaceConfig, KvError
from keyloom.operators import batch, fold
from keyloom.plans import admin, planner
from keyloom.session import KeyspaceSession
from keyloom.streaming import pipeline

START = datetime(2024, 1, 1)


def log(spark, *commands):
    rows = [(i, START + timedelta(seconds=i), None, op, key, *(list(rest) + [None] * 3)[:3]) for i, (op, key, *rest) in enumerate(commands)]
    return spark.createDataFrame(rows, COMMAND)


def replies(df, column="reply"):
    return {r.seq: r[column] for r in df.collect()}


def random_log(spark, ops, n=300, seed=1):
    r = random.Random(seed)
    return log(spark, *[(r.choice(ops), f"k{r.randint(0, 6)}", f"f{r.randint(0, 2)}", str(i)) for i in range(n)])


def folded(df, op, column):
    return {r.seq: r[column] for r in fold.replies(fold.fold(df)).where(F.col("op").isin(op)).collect()}


def test_set_based_forms_equal_the_fold(spark):
    df = random_log(spark, ["SET", "DEL", "GET"])
    got = replies(batch.get_replies(df))
    assert {s: got[s] for s in folded(df, ["GET"], "reply_text")} == folded(df, ["GET"], "reply_text")
    assert planner.choose(df) == "register"
    df = random_log(spark, ["RPUSH", "LPOP", "LPOP"])
    assert replies(batch.queue_pops(df)) == folded(df, ["LPOP"], "reply_text")
    assert planner.choose(df) == "queue"
    df = random_log(spark, ["LPUSH", "LPOP"], seed=2)
    assert replies(batch.stack_pops(df)) == folded(df, ["LPOP"], "reply_text")
    assert replies(batch.lengths(df).where("op = 'LPUSH'"), "len") == folded(df, ["LPUSH"], "reply_int")
    df = random_log(spark, ["HSET", "HDEL"], seed=3)
    assert replies(batch.hset_replies(df), "is_new") == folded(df, ["HSET"], "reply_bool")
    state = {(r.key, f): v for r in fold.states(fold.fold(df)).collect() for f, v in r.fields.items()}
    assert {(r.key, r.field): r.value for r in batch.fields(df).collect()} == state
    df = random_log(spark, ["LPUSH", "RPUSH"], seed=4)
    items = {(r.key, x.ord): x.value for r in fold.states(fold.fold(df)).collect() for x in r["items"]}
    assert {(r.key, r.ord): r.value for r in batch.pushed(df).collect()} == items
    df = random_log(spark, ["INCR", "DECR"], seed=5)
    assert replies(batch.counter_replies(df)) == folded(df, ["INCR", "DECR"], "reply_int")
    assert planner.choose(random_log(spark, ["LPUSH", "RPOP", "SET"])) == "fold"


def test_fold_reports_errors_and_goes_on(spark):
    df = log(spark, ("SET", "k", None, "x"), ("INCR", "k"), ("LPUSH", "k", None, "v"), ("GET", "k"), ("SET", None, None, "v"))
    rows = {r.seq: r for r in fold.replies(fold.fold(df)).collect()}
    assert [rows[i].err_state for i in range(5)] == [None, "22P02", "42804", None, None] and rows[3].reply_text == "x" and rows[4].reply_bool is None
    assert "command expects list" in rows[2].err_detail


def test_codec(spark):
    rows = spark.createDataFrame([("one", 1), ("", -1), ("é😀", 2**63 - 1), (None, None), ("x", -(2**63))], "s string, n long")
    text, number = codec.encode_string(F.col("s")), codec.encode_int(F.col("n"))
    got = rows.select("s", "n", F.hex(text).alias("h"), codec.decode_string(text).alias("s2"), codec.decode_int(number).alias("n2"), codec.decode_int(text).alias("bad")).collect()
    assert got[0].h == "01030000006F6E65" and all(r.s == r.s2 and r.n == r.n2 and r.bad is None for r in got)
    broken = spark.createDataFrame([(bytearray.fromhex(h),) for h in ("", "01", "0103000000", "0302000000", "010100000041ff")], "b binary")
    assert all(r.s is None and r.n is None for r in broken.select(codec.decode_string(F.col("b")).alias("s"), codec.decode_int(F.col("b")).alias("n")).collect())


class Clock:
    now = 1_700_000_000_000_000

    def __call__(self):
        return self.now


@pytest.fixture
def kv(spark):
    return KeyspaceSession(spark, clock=Clock())


def test_commits_are_durable_and_rollbacks_are_not(kv, spark):
    kv.begin()
    kv.set("p:1", "one"), kv.hset("p:h", "name", "Alice"), kv.hset("p:h", "age", "30"), kv.rpush("p:l", "a"), kv.rpush("p:l", "b")
    kv.commit()
    assert kv.store.table("store").where("key = 'p:1'").select(F.hex("value")).first()[0] == "01030000006F6E65"
    assert kv.store.table("store").where("value IS NULL").count() == 2
    assert [(r.ord, bytes(r.value)) for r in kv.store.table("list_items").orderBy("ord").collect()] == [(0, b"a"), (1, b"b")]
    kv.begin()
    kv.set("gone", "x"), kv.delete("p:1")
    point = kv.savepoint()
    kv.delete("p:h")
    kv.rollback_to(point)
    assert kv.hget("p:h", "name") == "Alice"
    kv.rollback()
    assert kv.get("p:1") == "one" and kv.get("gone") is None and kv.store.table("store").count() == 3
    kv.begin()
    kv.delete("p:h"), kv.hset("p:h", "new", "1")
    kv.commit()
    assert [r.field for r in kv.store.table("hash_fields").collect()] == ["new"], "a replaced key's children go"
    again = KeyspaceSession(spark, store=kv.store, clock=kv.clock)
    assert again.get("p:1") == "one" and again.hget("p:h", "new") == "1" and again.lpop("p:l") == "a"
    assert again.entries["p:1"].version == 2


def test_modes(spark):
    none = KeyspaceSession(spark, KeyspaceConfig(persistence_mode="none"))
    none.set("k", "v")
    assert none.get("k") == "v" and none.store.version() is None
    lazy = KeyspaceSession(spark, KeyspaceConfig(persistence_mode="async_table", storage_mode="shared", dirty_ring_size=1024, async_full_action="sync_flush"))
    lazy.begin()
    for i in range(1500):
        lazy.set(f"k{i}", "v")
    lazy.commit()
    ring = lazy.ring_inspect().first()
    assert lazy.store.table("store").count() >= 1000 and ring.write_head - ring.read_head == ring.events_pending and ring.stuck_writing_slots == 0
    lazy.drain()
    assert lazy.store.table("store").count() == 1500 and lazy.ring_inspect().first().events_pending == 0
    full = KeyspaceSession(spark, KeyspaceConfig(persistence_mode="async_table", storage_mode="shared", dirty_ring_size=1024))
    full.queue = ["x"] * 1024
    with pytest.raises(KvError):
        full.set("k", "v")


def test_introspection_snapshots_and_jobs(kv):
    kv.begin()
    kv.set("s", "v"), kv.incr("c"), kv.hset("h", "f", "v"), kv.rpush("l", "a"), kv.set("old", "x"), kv.expire("old", 1)
    kv.commit()
    kv.clock.now += 2_000_000
    assert sorted(r.key for r in kv.keys().collect()) == ["c", "h", "l", "s"]
    assert tuple(kv.stats().first())[:6] == (5, 2, 1, 1, 1, 1) and kv.memory_usage() == 5 * 1088 + 2 + 1057 + 49
    assert "key_count:5\n" in kv.info()
    kv.sql_functions()
    assert [r[0] for r in kv.spark.sql("SELECT kv_get(k) FROM VALUES ('s'), ('c'), ('none') t(k)").collect()] == ["v", "1", None]
    assert kv.save() and kv.snapshots_table().first().key_count == 4
    rows = {r.key: r for r in admin.snapshot_rows(kv.snapshots_table()).collect()}
    assert rows["h"].value == '{"fields":{"f":"v"}}' and rows["l"].value == '{"items":["a"]}' and rows["c"].type == "int"
    ids = [kv.add_ttl_cleanup_policy(60_000_000), kv.add_flush_policy(30_000_000), kv.add_snapshot_policy(3_600_000_000)]
    assert [r.job_type for r in kv.jobs.jobs_table(kv.spark).collect()] == ["ttl_cleanup", "flush_dirty_keys", "snapshot_save"]
    assert kv.run_job(ids[0]) and not kv.run_job(9999)
    stats = kv.jobs.stats_table(kv.spark).first()
    assert (stats.total_runs, stats.successful_runs, stats.failed_runs) == (1, 1, 0) and kv.store.table("store").where("key = 'old'").isEmpty()
    assert kv.delete_job(ids[1]) and not kv.delete_job(ids[1])
    assert kv.bgsave() and kv.jobs.run_due() == 1
    with warnings.catch_warnings(record=True):
        warnings.simplefilter("always")
        assert kv.bgrewriteaof() is False
    assert kv.lwlock_diag().count() == 0 and kv.flushall() and kv.memory_usage() == 0 and kv.keys().count() == 0 and kv.store.table("store").count() == 0


def test_jobs_and_snapshots_outlive_a_session(kv, spark):
    kv.set("k", "v"), kv.save()
    job, other = kv.add_ttl_cleanup_policy(60_000_000), kv.add_snapshot_policy(60_000_000)
    assert kv.run_job(job) and kv.delete_job(other)
    again = KeyspaceSession(spark, store=kv.store, clock=kv.clock)
    assert [r.key_count for r in again.snapshots_table().collect()] == [1] and list(again.jobs.rows) == [job]
    assert again.jobs.stats[job].successful_runs == 1 and again.add_flush_policy(1) == other + 1


def test_a_key_is_read_alone(kv, spark):
    kv.begin()
    for i in range(20):
        kv.hset(f"h{i}", "f", str(i))
    kv.commit()
    again = KeyspaceSession(spark, store=kv.store, clock=kv.clock)
    assert again.hget("h7", "f") == "7" and again.get("none") is None and list(again.entries) == ["h7", "none"]
    again.hset("h7", "g", "x"), again.delete("h8")
    assert {r.key for r in again.keys().collect()} == {f"h{i}" for i in range(20) if i != 8}
    plan = kv.store.state(key="h7")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(key,h7)") == 3


def test_inserts_are_unique(spark):
    from keyloom.sources.store import Store

    store, row = Store(spark), fold.states(fold.fold(log(spark, ("SET", "a", None, "1"))))
    for rows, fails in ((row.union(row), True), (row, False), (row, True)):
        if fails:
            with pytest.raises(KvError) as e:
                store.insert(rows, F.current_timestamp())
            assert e.value.sqlstate == "23505"
        else:
            store.insert(rows, F.current_timestamp())
    assert store.table("store").count() == 1


def test_background_work(spark):
    clock = Clock()
    kv = KeyspaceSession(spark, KeyspaceConfig(persistence_mode="async_table", storage_mode="shared"), clock=clock)
    kv.set("a", "1"), kv.set("old", "1"), kv.expire("old", 10)
    assert kv.tick() == 0 and kv.store.version() is None
    clock.now += 5_000_000
    kv.tick()
    assert kv.store.table("store").count() == 2 and kv.ring_inspect().first().events_pending == 0
    kv.bgsave()
    clock.now += 30_000_000
    assert kv.tick() == 1 and [r.key for r in kv.store.table("store").collect()] == ["a"]
    worker = KeyspaceSession(spark, KeyspaceConfig(persistence_mode="async_table", storage_mode="shared", enable_background_worker=True, flush_interval=1))
    worker.set("k", "v")
    for _ in range(100):
        if worker.store.version() is not None:
            break
        time.sleep(0.3)
    assert worker.store.table("store").count() == 1 and worker.worker.last_error is None
    worker.close()
    assert worker.worker is None


def test_a_failed_job_is_recorded():
    jobs = Scheduler({}, Clock())
    assert jobs.run(jobs.add("aof_rewrite", 1)) and jobs.stats[1].failed_runs == 1 and "not implemented" in jobs.rows[1].last_error


def test_stream_equals_fold(spark):
    df = random_log(spark, ["LPUSH", "RPUSH", "LPOP", "RPOP", "SET", "DEL", "INCR"], n=120, seed=9)
    columns = ["seq", "op", "key", "reply_text", "reply_int", "reply_bool", "err_state"]
    assert sorted(map(tuple, pipeline.streamed_replies(df).select(*columns).collect()), key=str) == sorted(map(tuple, fold.replies(fold.fold(df)).select(*columns).collect()), key=str)
    whole = fold.fold(df)
    kinds = {r.etype for r in pipeline.events(whole).collect()}
    assert kinds <= {"KEY_UPSERT", "KEY_DELETE", "HASH_FIELD_UPSERT", "LIST_ITEM_INSERT"} and "KEY_UPSERT" in kinds
    numbered = pipeline.events(whole).select("*", F.lit(1).alias("pos")).unionByName(pipeline.events(whole).select("*", F.lit(2).alias("pos")))
    assert pipeline.last_writes(numbered).where("pos <> 2").isEmpty()


def test_events_replay_to_the_drained_tables(spark):
    from keyloom.sources.store import Store

    ops = [*["LPUSH", "RPUSH"] * 3, *["LPOP", "RPOP"] * 2, *["HSET", "HDEL"] * 3, "SET", "DEL"]
    df = random_log(spark, ops, n=600, seed=4)
    store = Store(spark)
    _, folder = pipeline.run(df, store=store)
    rows = spark.read.schema(f"{fold.FOLDED}, batch int").parquet(f"{folder}/out")
    events = pipeline.events(rows, F.col("batch").cast("long")).cache()
    assert {r.etype for r in events.select("etype").distinct().collect()} == {"KEY_UPSERT", "KEY_DELETE", "HASH_FIELD_UPSERT", "HASH_FIELD_DELETE", "LIST_ITEM_INSERT", "LIST_ITEM_DELETE"}
    for name, left in pipeline.replayed(events).items():
        there = store.table(name).select(*left.columns)
        assert sorted(map(str, left.collect())) == sorted(map(str, there.collect())), name
    state = {r.key: (r.str, r.fields, r["items"]) for r in fold.states(fold.fold(df)).collect()}
    assert {r.key: (r.str, r.fields, r["items"]) for r in store.state().collect()} == state


def test_timers_remove_expired_entries(spark):
    commands = [("SET", "a", None, "1"), ("EXPIRE", "a", None, None, 5), ("SET", "b", None, "1"), *[("SET", "c", None, str(i)) for i in range(60)], ("DEL", "a"), ("DEL", "b")]
    rows = [(i, START + timedelta(seconds=i), None, op, key, *(list(rest) + [None] * 3)[:3]) for i, (op, key, *rest) in enumerate(commands)]
    df = spark.createDataFrame(rows, COMMAND)
    _, folder = pipeline.run(df, lateness="2 seconds")
    out = spark.read.schema(f"{fold.FOLDED}, batch int").parquet(f"{folder}/out")
    found = {r.key: r.reply_bool for r in out.where("op = 'DEL'").collect()}
    assert found == {"a": False, "b": True}
    assert out.where("kind = 'gone' AND key = 'a'").agg(F.min("batch")).first()[0] < out.agg(F.max("batch")).first()[0]


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_two_commits_from_one_version(spark, tmp_path):
    from keyloom.model import KvError
    from keyloom.sources.store import Store

    a, b = Store(spark, f"{tmp_path}/store"), Store(spark, f"{tmp_path}/store")
    a.clear()
    base, empty = b.version(), {name: a.table(name) for name in ("store", "hash_fields", "list_items")}
    a.clear()
    with pytest.raises(KvError) as e:
        b._write(empty, base)
    assert e.value.sqlstate == "40001" and a.version() == b.version() != base


def test_set_based_forms_agree_with_the_fold(spark):
    from keyloom.operators import batch
    from keyloom.operators.fold import fold, replies, states

    log = [("a", "SET", "1", None), ("a", "SET", None, None), ("a", "SET", "x" * 1_048_577, None), ("b", "SET", str(2**63 - 2), None), ("b", "INCR", None, None), ("b", "INCR", None, None), ("b", "DECR", None, None), ("b", "INCR", None, None), ("c", "SET", str(-(2**63)), None), ("c", "DECR", None, None), ("c", "INCR", None, None), ("d", "HSET", "v", "f"), ("d", "HSET", None, "f"), ("d", "HSET", "w", None)]
    rows = spark.createDataFrame([(i, i, k, op, v, f) for i, (k, op, v, f) in enumerate(log)], "seq long, at long, key string, op string, value string, field string")
    rows = rows.select("seq", F.timestamp_seconds("at").alias("ts"), F.lit(None).cast("long").alias("txn"), "op", "key", "field", "value", F.lit(None).cast("int").alias("seconds"))
    folded = fold(rows).cache()
    assert {r.key: r.value for r in batch.last_values(rows.where("key = 'a'")).collect()} == {r.key: r.str for r in states(folded).where("key = 'a'").collect()} == {"a": "1"}
    expected = {r.seq: (r.reply_int, r.err_state) for r in replies(folded).where("op in ('INCR', 'DECR')").collect()}
    assert {r.seq: (r.reply, r.err_state) for r in batch.counter_replies(rows.where("key in ('b', 'c')")).collect()} == expected and sum(e == "22003" for _, e in expected.values()) == 2
    assert [(r.key, r.field, r.value) for r in batch.fields(rows).collect()] == [("d", "f", "v")]
