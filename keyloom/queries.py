"""The driver's queries over command logs, each with the SQL of the same result where SQL can express it."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions import codec
from keyloom.model import ITEMS, KeyspaceConfig, KvError
from keyloom.operators import batch, fold
from keyloom.operators.reducer import Limits
from keyloom.plans import admin
from keyloom.session import KeyspaceSession
from keyloom.sources import logs
from keyloom.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: All users' commands in order; shared by the SQL below.
E = "(SELECT event_id, ts, user_id, event_type, 'user:' || user_id AS k, 'q:' || user_id AS q FROM events)"
W = "OVER (PARTITION BY k ORDER BY ts, event_id)"
LATE = "epoch_us(ts)"


def query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Strings and keys


@query(f"SELECT k AS key, event_type AS value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) n FROM {E}) WHERE n = 1")
def set_last_value(spark, sf_dir):
    return batch.last_values(logs.sets(spark, sf_dir))


@query(f"SELECT event_id AS seq, k AS key, lag(event_type) {W} AS reply FROM {E}")
def get_running(spark, sf_dir):
    return batch.get_replies(logs.sets(spark, sf_dir))


@query(f"SELECT k AS key, event_type AS value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) n FROM {E}) WHERE n = 1 AND event_type <> 'error'")
def del_tombstone(spark, sf_dir):
    return batch.last_values(logs.sets(spark, sf_dir, deletes=True))


@query(f"SELECT k AS key, event_type <> 'error' AS found FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) n FROM {E}) WHERE n = 1")
def exists_semi(spark, sf_dir):
    log = logs.sets(spark, sf_dir, deletes=True)
    return log.select("key").distinct().join(batch.last_values(log).select("key", F.lit(True).alias("there")), "key", "left").select("key", F.coalesce("there", F.lit(False)).alias("found"))


@query("SELECT 'cnt:' || event_type AS key, CAST(sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) AS BIGINT) AS value FROM events GROUP BY 1")
def incr_counter(spark, sf_dir):
    return batch.counters(logs.counts(spark, sf_dir))


@query("SELECT event_id AS seq, 'cnt:' || event_type AS key, CAST(sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS reply FROM events")
def incr_decr_running(spark, sf_dir):
    return batch.counter_replies(logs.counts(spark, sf_dir)).select("seq", "key", "reply")


def _based(spark: SparkSession, sf_dir: str, value: F.Column, key: F.Column) -> DataFrame:
    """Counts whose keys are SET before the first event."""
    own = logs.events(spark, sf_dir)
    first = own.withColumn("key", key).groupBy("key").agg(F.min("ts").alias("ts"), F.min("event_id").alias("event_id"))
    sets = first.withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 SECOND")).select(*logs.command("SET", F.col("key"), value=value, seq=F.lit(-1)))
    return sets.unionByName(own.select(*logs.command("INCR", key)))


@query("SELECT event_id AS seq, 'b:' || user_id AS key, 100 + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS reply FROM events")
def incr_string_base(spark, sf_dir):
    return batch.counter_replies(_based(spark, sf_dir, F.lit(" +100"), F.concat(F.lit("b:"), "user_id"))).select("seq", "key", "reply")


@query("SELECT event_id AS seq, CASE WHEN user_id % 3 = 0 THEN '22P02' END AS err_state, CASE WHEN user_id % 3 = 1 THEN 7 WHEN user_id % 3 = 2 THEN -12 END + CASE WHEN user_id % 3 > 0 THEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS reply FROM events")
def incr_error_rows(spark, sf_dir):
    base = F.element_at(F.array(F.lit("7 "), F.lit(" 7"), F.lit("-12")), (F.substring_index("key", ":", -1).cast("int") % 3) + 1)
    return batch.counter_replies(_based(spark, sf_dir, base, F.concat(F.lit("e:"), "user_id"))).select("seq", "err_state", "reply")


@query("SELECT event_id AS seq, CASE WHEN n > 2 THEN '22003' END AS err_state, CASE WHEN n <= 2 THEN 9223372036854775805 + n END AS reply FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)")
def incr_overflow_rows(spark, sf_dir):
    return batch.counter_replies(_based(spark, sf_dir, F.lit("9223372036854775805"), F.concat(F.lit("o:"), "user_id"))).select("seq", "err_state", "reply")


# Expiry

GAP = f"{LATE} - lag({LATE}) {W}"


@query(f"SELECT event_id AS seq, k AS key, coalesce({GAP} < 3600000000, false) AS alive FROM {E}")
def expire_alive(spark, sf_dir):
    return batch.refreshed_ttl(logs.sets(spark, sf_dir), 3600).select("seq", "key", "alive")


@query(f"SELECT event_id AS seq, k AS key, CAST(CASE WHEN gap < 3600000000 THEN (3600000000 - gap + 999999) // 1000000 ELSE -2 END AS BIGINT) AS ttl FROM (SELECT *, {GAP} AS gap FROM {E})")
def ttl_ceiling(spark, sf_dir):
    return batch.refreshed_ttl(logs.sets(spark, sf_dir), 3600).select("seq", "key", "ttl")


@query(f"SELECT k AS key, CAST((max({LATE}) + 86400000000 - (SELECT max({LATE}) FROM events) + 999999) // 1000000 AS BIGINT) AS ttl FROM {E} GROUP BY k HAVING max({LATE}) + 86400000000 > (SELECT max({LATE}) FROM events)")
def ttl_sweep(spark, sf_dir):
    log = logs.sets(spark, sf_dir)
    as_of = log.agg(F.max(F.unix_micros("ts"))).first()[0]
    return batch.live_keys(log, 86400, F.lit(as_of))


@query(ORACLE_SQL["del_tombstone"])
def expire_nonpositive(spark, sf_dir):
    op = F.when(F.col("event_type") == "error", "EXPIRE").otherwise("SET")
    log = logs.events(spark, sf_dir).select(*logs.command(op, logs.user(), value=F.col("event_type"), seconds=F.lit(0)))
    return fold.states(fold.fold(log)).select("key", F.col("str").alias("value"))


# Hashes

H = "(SELECT event_id, ts, k, CASE WHEN event_type = 'error' THEN 'view' ELSE event_type END AS f, event_type = 'error' AS gone FROM " + E + ")"
LAST_FIELDS = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, f ORDER BY ts DESC, event_id DESC) n FROM {H}) WHERE n = 1 AND NOT gone)"


@query(f"SELECT k AS key, event_type AS field, CAST(event_id AS VARCHAR) AS value FROM (SELECT *, row_number() OVER (PARTITION BY k, event_type ORDER BY ts DESC, event_id DESC) n FROM {E} WHERE event_type <> 'error') WHERE n = 1")
def hset_profile(spark, sf_dir):
    return batch.fields(logs.hashes(spark, sf_dir).where("op = 'HSET'"))


@query(f"SELECT event_id AS seq, k AS key, f AS field, coalesce(was, true) AS is_new FROM (SELECT *, lag(gone) OVER (PARTITION BY k, f ORDER BY ts, event_id) AS was FROM {H}) WHERE NOT gone")
def hset_is_new(spark, sf_dir):
    return batch.hset_replies(logs.hashes(spark, sf_dir))


@query(f"SELECT u.k AS key, CAST(h.event_id AS VARCHAR) AS value FROM (SELECT DISTINCT k FROM {E}) u LEFT JOIN (SELECT * FROM {LAST_FIELDS} WHERE f = 'purchase') h ON u.k = h.k")
def hget_join(spark, sf_dir):
    log = logs.hashes(spark, sf_dir)
    return log.select("key").distinct().join(batch.fields(log).where("field = 'purchase'").select("key", "value"), "key", "left")


@query(f"SELECT k AS key, f AS field, CAST(event_id AS VARCHAR) AS value FROM {LAST_FIELDS}")
def hdel_fields(spark, sf_dir):
    return batch.fields(logs.hashes(spark, sf_dir))


@query(f"SELECT u.k AS key, h.k IS NOT NULL AS found FROM (SELECT DISTINCT k FROM {E}) u LEFT JOIN (SELECT * FROM {LAST_FIELDS} WHERE f = 'view') h ON u.k = h.k")
def hexists(spark, sf_dir):
    log = logs.hashes(spark, sf_dir)
    return log.select("key").distinct().join(batch.fields(log).where("field = 'view'").select("key", F.lit(True).alias("there")), "key", "left").select("key", F.coalesce("there", F.lit(False)).alias("found"))


# Lists


def _orders(spark: SparkSession, sf_dir: str, op: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    return own.select(*logs.command(op, F.concat(F.lit("c:"), F.col("o_custkey")), value=F.col("o_orderkey"), seq=F.col("o_orderkey")))


RANK = "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query(f"SELECT 'c:' || o_custkey AS key, {RANK} - 1 AS ord, CAST(o_orderkey AS VARCHAR) AS value FROM orders")
def rpush_ords(spark, sf_dir):
    return batch.pushed(_orders(spark, sf_dir, "RPUSH"))


@query(f"SELECT 'c:' || o_custkey AS key, 1 - {RANK} AS ord, CAST(o_orderkey AS VARCHAR) AS value FROM orders")
def lpush_ords(spark, sf_dir):
    return batch.pushed(_orders(spark, sf_dir, "LPUSH"))


@query(f"""SELECT q AS key, CAST(CASE WHEN n = 1 THEN 0 WHEN l THEN first_l - lefts ELSE n - lefts - (1 - first_l) END AS BIGINT) AS ord, CAST(event_id AS VARCHAR) AS value FROM
(SELECT *, row_number() OVER w AS n, sum(CAST(l AS INT)) OVER w AS lefts, first_value(CAST(l AS INT)) OVER w AS first_l FROM (SELECT *, event_id % 2 = 0 AS l FROM {E}) WINDOW w AS (PARTITION BY q ORDER BY ts, event_id))""")
def mixed_ords(spark, sf_dir):
    return batch.pushed(logs.mixed_pushes(spark, sf_dir))


LEVELS = f"""(SELECT *, s - least(0, min(s) OVER (PARTITION BY q ORDER BY ts, event_id)) AS len FROM
(SELECT *, sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) OVER (PARTITION BY q ORDER BY ts, event_id) AS s FROM {E}))"""
WAS = f"(SELECT *, coalesce(lag(len) OVER (PARTITION BY q ORDER BY ts, event_id), 0) AS was FROM {LEVELS})"


@query(f"SELECT event_id AS seq, q AS key, CAST(len AS BIGINT) AS len FROM {LEVELS}")
def llen_running(spark, sf_dir):
    return batch.lengths(logs.pushes_and_pops(spark, sf_dir, "RPUSH", "LPOP")).select("seq", "key", F.col("len").cast("long").alias("len"))


@query(f"""SELECT p.event_id AS seq, p.q AS key, CAST(u.event_id AS VARCHAR) AS reply FROM
(SELECT *, CASE WHEN was > 0 THEN count(*) FILTER (WHERE was > 0) OVER (PARTITION BY q ORDER BY ts, event_id) END AS n FROM {WAS} WHERE event_id % 3 = 0) p
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY q ORDER BY ts, event_id) AS n FROM {E} WHERE event_id % 3 > 0) u ON p.q = u.q AND p.n = u.n""")
def fifo_lpop(spark, sf_dir):
    return batch.queue_pops(logs.pushes_and_pops(spark, sf_dir, "RPUSH", "LPOP"))


STACK = f"""SELECT seq, key, CAST(reply AS VARCHAR) AS reply FROM (SELECT event_id AS seq, q AS key, event_id % 3 = 0 AS pop,
CASE WHEN lev > 0 THEN last_value(CASE WHEN event_id % 3 > 0 THEN event_id END IGNORE NULLS) OVER (PARTITION BY q, lev ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS reply
FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN was ELSE len END AS lev FROM {WAS})) WHERE pop"""


@query(STACK)
def stack_lpop(spark, sf_dir):
    return batch.stack_pops(logs.pushes_and_pops(spark, sf_dir, "LPUSH", "LPOP"))


@query(STACK)
def rpop_tail(spark, sf_dir):
    return batch.stack_pops(logs.pushes_and_pops(spark, sf_dir, "RPUSH", "RPOP"))


#: A queue's commands one after the other, all queues at once.
DEQUE = """WITH RECURSIVE c AS (SELECT event_id AS seq, 'q:' || user_id AS key, ['LPUSH', 'RPUSH', 'LPOP', 'RPOP', 'LLEN'][event_id % 5 + 1] AS op, CAST(event_id AS VARCHAR) AS v,
row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT CAST(0 AS BIGINT) AS n, key, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS op, CAST([] AS VARCHAR[]) AS l, CAST(NULL AS VARCHAR) AS popped FROM (SELECT DISTINCT key FROM c)
UNION ALL SELECT c.n, c.key, CAST(c.seq AS BIGINT), c.op, CASE c.op WHEN 'LPUSH' THEN [c.v] || r.l WHEN 'RPUSH' THEN r.l || [c.v] WHEN 'LPOP' THEN r.l[2:] WHEN 'RPOP' THEN r.l[:greatest(len(r.l) - 1, 0)] ELSE r.l END,
CASE c.op WHEN 'LPOP' THEN r.l[1] WHEN 'RPOP' THEN r.l[len(r.l)] END FROM r JOIN c ON c.key = r.key AND c.n = r.n + 1)
SELECT seq, op, key, popped AS reply_text, CASE WHEN op IN ('LPUSH', 'RPUSH', 'LLEN') THEN CAST(len(l) AS BIGINT) END AS reply_int FROM r WHERE n > 0"""


@query(DEQUE)
def deque_fold(spark, sf_dir):
    return fold.replies(fold.fold(logs.deque(spark, sf_dir))).select("seq", "op", "key", "reply_text", "reply_int")


@query(ORACLE_SQL["fifo_lpop"])
def fifo_fold(spark, sf_dir):
    return fold.replies(fold.fold(logs.pushes_and_pops(spark, sf_dir, "RPUSH", "LPOP"))).where("op = 'LPOP'").select("seq", "key", F.col("reply_text").alias("reply"))


# Introspection: strings s:user:U, counters cnt:T, hashes h:user:U, lists q:U

KEYSPACE = f"""(SELECT 's:' || k AS key, 'string' AS type, strlen(event_type) AS size FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) n FROM {E}) WHERE n = 1
UNION ALL SELECT DISTINCT 'cnt:' || event_type, 'int', 0 FROM events
UNION ALL SELECT 'h:' || k, 'hash', sum(1056 + strlen(CAST(event_id AS VARCHAR))) FROM {LAST_FIELDS} GROUP BY k
UNION ALL SELECT q, 'list', sum(48 + strlen(CAST(event_id AS VARCHAR))) FROM {E} GROUP BY q)"""


@query(f"SELECT key FROM {KEYSPACE}")
def keys(spark, sf_dir):
    return admin.keys(logs.keyspace(spark, sf_dir), F.lit("2100-01-01").cast("timestamp"))


COUNTS = ", ".join(f"count(*) FILTER (WHERE type = '{t}') AS {t}_count" for t in ("string", "int", "hash", "list"))


@query(f"SELECT count(*) AS key_count, {COUNTS}, CAST(0 AS BIGINT) AS expiring_count, CAST(sum(1088 + size) AS BIGINT) AS memory_usage FROM {KEYSPACE}")
def stats(spark, sf_dir):
    return admin.stats(logs.keyspace(spark, sf_dir))


@query(f"SELECT '# keyspace' || chr(10) || 'version:1.0' || chr(10) || 'storage_mode:session' || chr(10) || 'persistence_mode:sync_table' || chr(10) || 'background_worker_enabled:no' || chr(10) || 'key_count:' || count(*) || chr(10) || 'memory_usage:' || CAST(sum(1088 + size) AS BIGINT) || chr(10) AS info FROM {KEYSPACE}")
def info(spark, sf_dir):
    return admin.info(logs.keyspace(spark, sf_dir))


@query(f"SELECT CAST(sum(1088 + size) AS BIGINT) AS memory_usage FROM {KEYSPACE}")
def memory_usage(spark, sf_dir):
    return admin.memory_usage(logs.keyspace(spark, sf_dir))


@query(f"SELECT key, CAST(strlen(key) AS BIGINT) AS key_bytes FROM {KEYSPACE}")
def key_bytes(spark, sf_dir):
    return admin.key_bytes(logs.keyspace(spark, sf_dir))


@query("""SELECT seq, err_state FROM (SELECT event_id AS seq, CASE
WHEN event_type = 'view' AND kind IN ('string', 'list') THEN '42804' WHEN event_type = 'purchase' AND kind IN ('string', 'hash') THEN '42804'
WHEN event_type = 'error' AND kind IN ('hash', 'list') THEN '42804' END AS err_state FROM (SELECT *, CASE WHEN reset = 'click' THEN 'string' WHEN made = 'view' THEN 'hash' WHEN made = 'purchase' THEN 'list' END AS kind FROM
(SELECT *, first_value(CASE WHEN event_type IN ('click', 'signup') THEN event_type ELSE 'none' END) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id) AS reset,
first_value(CASE WHEN event_type IN ('view', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS made FROM
(SELECT *, count(*) FILTER (WHERE event_type IN ('click', 'signup')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM events))))""")
def wrongtype_replies(spark, sf_dir):
    return fold.replies(fold.fold(logs.mixed_types(spark, sf_dir))).select("seq", "err_state")


def _odd_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.repeat(F.lit("é"), (F.col("event_id") % 700).cast("int"))
    return logs.events(spark, sf_dir).select(*logs.command("SET", key, value=F.col("event_type")))


@query("SELECT event_id AS seq, CASE WHEN event_id % 700 = 0 THEN '22023' WHEN 2 * (event_id % 700) > 1024 THEN '54000' END AS err_state, CASE WHEN event_id % 700 = 0 THEN 'key must not be empty' WHEN 2 * (event_id % 700) > 1024 THEN 'key length ' || 2 * (event_id % 700) || ' exceeds maximum 1024' END AS err_msg FROM events")
def key_length_errors(spark, sf_dir):
    return fold.replies(fold.fold(_odd_keys(spark, sf_dir), Limits())).select("seq", "err_state", "err_msg")


@query("SELECT event_id AS seq, CASE WHEN event_type <> 'error' THEN true END AS reply_bool, CAST(NULL AS VARCHAR) AS err_state FROM events")
def null_strict(spark, sf_dir):
    log = logs.events(spark, sf_dir).select(*logs.command("SET", logs.user(), value=F.when(F.col("event_type") != "error", F.col("event_type"))))
    return fold.replies(fold.fold(log)).select("seq", "reply_bool", "err_state")


# Binary values

BYTES = " || ".join(f"printf('%02X', (event_id >> {8 * k}) & 255)" for k in range(8))


@query(f"SELECT event_id AS seq, '01' || printf('%02X', strlen(event_type)) || '000000' || hex(encode(event_type)) AS text_hex, '0208000000' || {BYTES} AS int_hex FROM events")
def tlv_encode(spark, sf_dir):
    return logs.events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.hex(codec.encode_string(F.col("event_type"))).alias("text_hex"), F.hex(codec.encode_int(F.col("event_id"))).alias("int_hex"))


@query("SELECT event_id AS seq, event_type AS text, event_id - 5000 AS number, CAST(NULL AS VARCHAR) AS wrong FROM events")
def tlv_decode(spark, sf_dir):
    text, number = codec.encode_string(F.col("event_type")), codec.encode_int(F.col("event_id") - 5000)
    return logs.events(spark, sf_dir).select(F.col("event_id").alias("seq"), codec.decode_string(text).alias("text"), codec.decode_int(number).alias("number"), codec.decode_string(number).alias("wrong"))


# Transactions and durable rows


@query(f"SELECT txn, k AS key, event_type AS value FROM (SELECT *, CAST(event_id // 10 AS BIGINT) AS txn, row_number() OVER (PARTITION BY event_id // 10, k ORDER BY ts DESC, event_id DESC) n FROM {E}) WHERE n = 1")
def flush_coalesce(spark, sf_dir):
    return batch.coalesced(logs.sets(spark, sf_dir))


@query(f"SELECT k AS key, event_type AS value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) n FROM {E} WHERE (event_id // 10) % 7 <> 0) WHERE n = 1")
def flush_rollback(spark, sf_dir):
    log = logs.sets(spark, sf_dir)
    return batch.last_values(batch.committed(log, log.select("txn").distinct().where("txn % 7 = 0")))


@query(f"SELECT h.k AS key, f AS field, CAST(h.event_id AS VARCHAR) AS value FROM {LAST_FIELDS} h WHERE CAST(substr(h.k, 6) AS BIGINT) % 4 <> 0")
def cascade_delete(spark, sf_dir):
    children = batch.fields(logs.hashes(spark, sf_dir))
    deleted = children.select("key").distinct().where(F.substring_index("key", ":", -1).cast("long") % 4 == 0)
    return children.join(deleted, "key", "left_anti")


@query(f"SELECT k AS key, event_type AS value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) n FROM {E}) WHERE n = 1 AND {LATE} + 86400000000 > (SELECT max({LATE}) FROM events)")
def load_live_rows(spark, sf_dir):
    log = logs.sets(spark, sf_dir)
    as_of = log.agg(F.max("ts")).first()[0]
    store = log.groupBy("key").agg(F.max_by(F.struct("value", "ts"), F.struct("ts", "seq")).alias("l")).select("key", F.lit("string").alias("type"), codec.encode_string(F.col("l.value")).alias("value"), (F.col("l.ts") + F.expr("INTERVAL 1 DAY")).alias("expire_at"))
    return admin.live(store.where(F.col("type").isin("string", "int")), F.lit(as_of)).select("key", codec.decode_string(F.col("value")).alias("value"))


@query("SELECT 'c:' || o_custkey AS key, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS items FROM orders GROUP BY o_custkey")
def load_lists_sorted(spark, sf_dir):
    rows = batch.pushed(_orders(spark, sf_dir, "RPUSH")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("i"))
    return rows.select("key", F.array_join(F.transform("i", lambda x: x["value"]), ",").alias("items"))


@query(f"SELECT k AS key, event_type AS value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) n FROM {E} WHERE (ts, event_id) > (SELECT (ts, event_id) FROM events WHERE event_id % 500 = 250 ORDER BY ts DESC, event_id DESC LIMIT 1)) WHERE n = 1")
def flushall_epoch(spark, sf_dir):
    own = logs.events(spark, sf_dir)
    barriers = own.where("event_id % 500 = 250").select("ts", F.col("event_id").alias("seq"))
    log = batch.epochs(logs.sets(spark, sf_dir).where("seq % 500 <> 250"), barriers)
    return batch.last_values(log.where(F.col("epoch") == barriers.count()).drop("epoch"))


@query(f"SELECT key, type FROM {KEYSPACE}")
def snapshot_payload_rows(spark, sf_dir):
    payload = admin.snapshot(logs.keyspace(spark, sf_dir), F.lit("2100-01-01").cast("timestamp"))
    return admin.snapshot_rows(payload).select("key", "type")


JOB = "(SELECT o_orderkey AS job_id, o_orderpriority AS job_type, o_orderstatus <> 'P' AS enabled, epoch_us(o_orderdate) AS next_run FROM orders)"
NOW = "(SELECT epoch_us(max(o_orderdate)) - 31536000000000 FROM orders)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return own.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("job_type"), (F.col("o_orderstatus") != "P").alias("enabled"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("next_run"))


@query(f"SELECT job_id, job_type FROM {JOB} WHERE enabled AND next_run <= {NOW}")
def jobs_due(spark, sf_dir):
    from keyloom.jobs import due

    jobs = _jobs(spark, sf_dir)
    now = jobs.agg(F.max("next_run")).first()[0] - 31_536_000_000_000
    return due(jobs, F.lit(now)).select("job_id", "job_type")


@query("SELECT o_custkey AS job_id, count(*) AS total_runs, count(*) FILTER (WHERE o_orderstatus <> 'F') AS successful_runs, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed_runs FROM orders GROUP BY 1")
def job_stats_upsert(spark, sf_dir):
    from keyloom.jobs import run_stats

    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("job_id"), (F.col("o_orderstatus") != "F").alias("ok"))
    return run_stats(runs)


# Streams


@query(ORACLE_SQL["set_last_value"])
def async_drain_lww(spark, sf_dir):
    from keyloom.streaming.pipeline import drained

    return drained(logs.sets(spark, sf_dir)).where("type = 'string'").select("key", F.col("str").alias("value"))


@query(ORACLE_SQL["fifo_lpop"])
def async_fifo_stream(spark, sf_dir):
    from keyloom.streaming.pipeline import streamed_replies

    return streamed_replies(logs.pushes_and_pops(spark, sf_dir, "RPUSH", "LPOP")).where("op = 'LPOP'").select("seq", "key", F.col("reply_text").alias("reply"))


@query(ORACLE_SQL["hdel_fields"])
def change_events_replay(spark, sf_dir):
    from keyloom.streaming.pipeline import replayed, streamed_events

    left = replayed(streamed_events(logs.hashes(spark, sf_dir)))["hash_fields"]
    return left.select("key", "field", F.decode("value", "UTF-8").alias("value"))


# Durable tables


def _stored(spark: SparkSession, sf_dir: str, types: tuple[str, ...] = ("string", "int", "hash", "list")) -> Store:
    store = Store(spark)
    store.commit(logs.keyspace(spark, sf_dir).where(F.col("type").isin(*types)), None, F.timestamp_seconds(F.lit(0)))
    return store


@query(f"SELECT 's:' || key AS key, 'string' AS type, NULL AS field, NULL AS value FROM ({ORACLE_SQL['set_last_value']}) UNION ALL SELECT 'h:' || key, 'hash', field, value FROM ({ORACLE_SQL['hdel_fields']})")
def store_fields_join(spark, sf_dir):
    store = _stored(spark, sf_dir, ("string", "hash"))
    rows = store.table("store").join(store.table("hash_fields").withColumnRenamed("value", "v"), "key", "left")
    return rows.select("key", "type", "field", F.decode("v", "UTF-8").alias("value"))


@query(ORACLE_SQL["set_last_value"])
def store_upsert(spark, sf_dir):
    store, log = Store(spark), logs.sets(spark, sf_dir)
    for part in (log.where("seq % 2 = 0"), log):  # the second puts its values in place of the first's
        rows = batch.last_values(part).select("key", F.lit("string").alias("type"), F.col("value").alias("str"), *[F.lit(None).cast(t).alias(n) for n, t in (("int", "long"), ("fields", "map<string,string>"), ("items", ITEMS), ("expire_at", "timestamp"))], F.lit(1).cast("long").alias("version"))
        store.commit(rows, None, F.timestamp_seconds(F.lit(0)))
    return store.state().select("key", F.col("str").alias("value"))


@query("SELECT '23505' AS err_state, count(DISTINCT user_id) AS kept FROM events")
def store_insert_unique(spark, sf_dir):
    store, rows = Store(spark), logs.keyspace(spark, sf_dir).where("type = 'string'")
    store.insert(rows, F.timestamp_seconds(F.lit(0)))
    state = None
    try:
        store.insert(rows.limit(1), F.timestamp_seconds(F.lit(0)))
    except KvError as e:
        state = e.sqlstate
    return store.table("store").agg(F.lit(state).alias("err_state"), F.count("*").alias("kept"))


@query("SELECT * FROM (VALUES ('store', CAST(0 AS BIGINT)), ('hash_fields', 0), ('list_items', 0)) t(name, n)")
def store_truncate(spark, sf_dir):
    store = _stored(spark, sf_dir)
    store.clear()
    counts = [store.table(name).agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name in ("store", "hash_fields", "list_items")]
    return counts[0].union(counts[1]).union(counts[2])


@query(f"SELECT 's:' || key AS key, value FROM ({ORACLE_SQL['set_last_value']}) WHERE key = (SELECT min('user:' || user_id) FROM events)")
def store_keyed_read(spark, sf_dir):
    key = logs.events(spark, sf_dir).agg(F.min(logs.user())).first()[0]
    return _stored(spark, sf_dir, ("string",)).state(key=f"s:{key}").select("key", F.col("str").alias("value"))


# Sessions


def _session(spark: SparkSession, **settings) -> KeyspaceSession:
    """A session whose clock stands still."""
    return KeyspaceSession(spark, KeyspaceConfig(**settings), clock=lambda: 1_700_000_000_000_000)


def _named(spark: SparkSession, sf_dir: str, kv: KeyspaceSession, table: str, key: str, name: str) -> KeyspaceSession:
    """A session with a string for each row of a small table, set in one transaction."""
    kv.begin()
    for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").collect():  # 25 nations, 5 regions
        kv.set(f"{table}:{r[key]}", r[name])
    kv.commit()
    return kv


@query("SELECT 'nation:' || n_nationkey AS key, n_name AS value FROM nation")
def sql_functions(spark, sf_dir):
    _named(spark, sf_dir, _session(spark), "nation", "n_nationkey", "n_name").sql_functions()
    return spark.sql("SELECT key, kv_get(key) AS value FROM kv_keys()")


@query("""SELECT 'queued' AS phase, count(*) AS write_head, CAST(0 AS BIGINT) AS read_head, count(*) AS events_pending, 0 AS stuck_writing_slots, 2 AS load_state, CAST(0 AS BIGINT) AS stored FROM region
UNION ALL SELECT 'drained', count(*), count(*), 0, 0, 2, count(*) FROM region""")
def ring_inspect(spark, sf_dir):
    kv = _session(spark, persistence_mode="async_table", storage_mode="shared")
    _named(spark, sf_dir, kv, "region", "r_regionkey", "r_name")
    rows = []
    for phase in ("queued", "drained"):
        rows.append((phase, *kv.ring_inspect().first(), kv.load_state, kv.store.table("store").count()))
        kv.drain()
    return spark.createDataFrame(rows, "phase string, write_head long, read_head long, events_pending long, stuck_writing_slots int, load_state int, stored long")


@query("SELECT CAST(NULL AS VARCHAR) AS wait_event, CAST(NULL AS BIGINT) AS waiters WHERE false")
def lwlock_diag(spark, sf_dir):
    return _session(spark).lwlock_diag()


@query("SELECT count(*) AS key_count, false AS rewritten, CAST(1 AS BIGINT) AS runs, CAST(1 AS BIGINT) AS ok FROM nation")
def bgsave_snapshot(spark, sf_dir):
    kv = _named(spark, sf_dir, _session(spark), "nation", "n_nationkey", "n_name")
    kv.bgsave()
    kv.tick()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rewritten = kv.bgrewriteaof()
    again = KeyspaceSession(spark, store=kv.store, clock=kv.clock)  # snapshots and jobs outlive a session
    runs = again.jobs.stats_table(spark).select(F.col("total_runs").alias("runs"), F.col("successful_runs").alias("ok"))
    return again.snapshots_table().select("key_count", F.lit(rewritten).alias("rewritten")).crossJoin(runs)  # one row each


@query("""SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'ttl_cleanup', CAST(60000000 AS BIGINT), true, CAST(2 AS BIGINT), CAST(2 AS BIGINT), CAST(0 AS BIGINT), NULL),
(3, 'snapshot_save', 3600000000, true, NULL, NULL, NULL, NULL), (4, 'unknown', 1000000, true, 1, 0, 1, 'job type "unknown" is not implemented'))
t(job_id, job_type, schedule_us, enabled, total_runs, successful_runs, failed_runs, last_error)""")
def jobs_lifecycle(spark, sf_dir):
    kv = _session(spark)
    ids = [kv.add_ttl_cleanup_policy(60_000_000), kv.add_flush_policy(30_000_000), kv.add_snapshot_policy(3_600_000_000), kv.jobs.add("unknown", 1_000_000)]
    kv.delete_job(ids[1])
    for job_id in (ids[0], ids[0], ids[1], ids[3]):
        kv.run_job(job_id)
    stats = kv.jobs.stats_table(spark).select("job_id", "total_runs", "successful_runs", "failed_runs")
    return kv.jobs.jobs_table(spark).join(stats, "job_id", "left").select("job_id", "job_type", "schedule_us", "enabled", "total_runs", "successful_runs", "failed_runs", "last_error")


# A keyspace joined with other tables, as its host's users would


@query("SELECT c_custkey, c_mktsegment, n AS orders, last_order FROM (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last_order FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey")
def host_compose_join(spark, sf_dir):
    lists = batch.pushed(_orders(spark, sf_dir, "RPUSH")).groupBy("key").agg(F.count("*").alias("orders"), F.max(F.col("value").cast("long")).alias("last_order"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    return customers.join(lists.withColumn("c_custkey", F.substring_index("key", ":", -1).cast("long")), "c_custkey").select("c_custkey", "c_mktsegment", "orders", "last_order")


@query(f"SELECT type, substr(key, 1, 2) AS prefix, count(*) AS n FROM {KEYSPACE} GROUP BY ROLLUP (type, substr(key, 1, 2))")
def host_compose_rollup(spark, sf_dir):
    return logs.keyspace(spark, sf_dir).select("type", F.substring("key", 1, 2).alias("prefix")).rollup("type", "prefix").agg(F.count("*").alias("n"))


@query(f"SELECT key, type, row_number() OVER (PARTITION BY type ORDER BY size DESC, key) AS rank FROM {KEYSPACE}")
def host_compose_window(spark, sf_dir):
    rows = logs.keyspace(spark, sf_dir).withColumn("size", admin.entry_bytes())
    return rows.select("key", "type", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("size"), "key")).cast("long").alias("rank"))


@query(f"SELECT k AS key FROM {E} WHERE event_type = 'purchase' INTERSECT SELECT k FROM {E} WHERE event_type = 'view' EXCEPT SELECT k FROM {E} WHERE event_type = 'signup' AND event_id % 25 = 0")
def host_compose_setop(spark, sf_dir):
    own = logs.events(spark, sf_dir).select(logs.user().alias("key"), "event_type", "event_id")
    of = lambda kind: own.where(F.col("event_type") == kind)
    return of("purchase").select("key").intersect(of("view").select("key")).subtract(of("signup").where("event_id % 25 = 0").select("key"))
