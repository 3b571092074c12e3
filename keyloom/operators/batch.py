"""Set-based commands: aggregations and windows over a command log (seq, ts, op, key, field, value, seconds).

Order is (ts, seq) within a key. Aggregations over hot keys combine on the map side; running replies partition by key.
Commands that lack an argument or exceed a limit change nothing here, as in the fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.model import MAX_NAME
from keyloom.operators.reducer import HIGH, LOW, Limits


def _by(*keys: str):
    return Window.partitionBy(*keys).orderBy("ts", "seq")


def _before(*keys: str):
    return _by(*keys).rowsBetween(Window.unboundedPreceding, -1)


def _within(column: str, most: int, least: int = 0) -> Column:
    return F.coalesce(F.octet_length(column).between(least, most), F.lit(False))


def _sets(limits: Limits = Limits()) -> Column:  # noqa: B008
    """Whether a row is a SET or DEL that does something."""
    key = _within("key", limits.key, 1)
    return key & ((F.col("op") == "DEL") | ((F.col("op") == "SET") & _within("value", limits.value)))


def _field_sets(limits: Limits = Limits()) -> Column:  # noqa: B008
    """Whether a row is an HSET or HDEL that may do something."""
    key = _within("key", limits.key, 1) & _within("field", MAX_NAME, 1)
    return key & ((F.col("op") == "HDEL") | ((F.col("op") == "HSET") & _within("value", limits.value)))


def last_values(log: DataFrame) -> DataFrame:
    """Keys and values after SETs and DELs: the last command of a key wins."""
    last = log.where(_sets()).groupBy("key").agg(F.max_by(F.struct("op", "value"), F.struct("ts", "seq")).alias("last"))
    return last.where("last.op = 'SET'").select("key", "last.value")


def get_replies(log: DataFrame) -> DataFrame:
    """Per command the value that a GET just before it would have had."""
    kept = F.struct("op", "value")
    last = F.last(F.when(_sets(), kept), ignorenulls=True).over(_before("key"))
    return log.withColumn("last", last).select("seq", "key", F.when(F.col("last.op") == "SET", F.col("last.value")).alias("reply"))


def counters(log: DataFrame) -> DataFrame:
    """Final values of keys that only INCR and DECR touch."""
    return log.groupBy("key").agg(F.sum(_step()).alias("value"))


def _step() -> Column:
    return F.when(F.col("op") == "INCR", F.lit(1)).when(F.col("op") == "DECR", F.lit(-1)).otherwise(F.lit(0)).cast("long")


def counter_replies(log: DataFrame) -> DataFrame:
    """Replies to INCR and DECR; SET and DEL begin a segment, whose base is the number that was set, or 0.

    A step beyond 64 bits is error 22003 and changes nothing, so the value is the running sum less what went over."""
    from keyloom.functions.codec import parse_int

    cut = log.withColumn("segment", F.count_if(_sets()).over(_by("key")))
    base = F.first(F.when(F.col("op") == "SET", parse_int(F.col("value"))).otherwise(0)).over(_by("key", "segment"))
    cut = cut.withColumn("base", base).withColumn("sum", F.sum(_step()).over(_by("key", "segment")))
    up, down = F.lit(HIGH) - F.greatest("base", F.lit(0)), F.lit(LOW) - F.least("base", F.lit(0))
    most, least = F.max("sum").over(_by("key", "segment")), F.min("sum").over(_by("key", "segment"))
    over = F.when(most > up, most - up).when(least < down, least - down).otherwise(0)  # no log is long enough for both
    cut = cut.withColumn("value_now", F.col("base") + (F.col("sum") - over))
    before = F.coalesce(F.lag("value_now").over(_by("key", "segment")), F.col("base"))
    cut = cut.withColumn("beyond", F.coalesce(before == F.col("value_now"), F.lit(False)) & F.col("op").isin("INCR", "DECR"))
    error = F.when(F.col("base").isNull(), "22P02").when(F.col("beyond"), "22003")
    return cut.where(F.col("op").isin("INCR", "DECR")).select("seq", "key", F.when(~F.col("beyond"), F.col("value_now")).alias("reply"), error.alias("err_state"))


def refreshed_ttl(log: DataFrame, ttl: int) -> DataFrame:
    """Keys that each command sets to expire after ttl seconds: whether they were alive before it, and their TTL then."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    left = F.lag(micros + ttl * 1_000_000).over(_by("key")) - micros
    return log.withColumn("left", left).select("seq", "key", (F.coalesce(F.col("left"), F.lit(0)) > 0).alias("alive"), F.when(F.coalesce(F.col("left"), F.lit(0)) > 0, F.expr("(left + 999999) div 1000000")).otherwise(-2).cast("long").alias("ttl"))


def live_keys(log: DataFrame, ttl: int, as_of: Column) -> DataFrame:
    """Keys with such an expiry that are alive at as_of, with the seconds left."""
    last = log.groupBy("key").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("us"))
    return last.withColumn("left", F.col("us") + ttl * 1_000_000 - as_of).where("left > 0").select("key", F.expr("(left + 999999) div 1000000").cast("long").alias("ttl"))


def fields(log: DataFrame) -> DataFrame:
    """Fields and values after HSETs and HDELs."""
    last = log.where(_field_sets()).groupBy("key", "field").agg(F.max_by(F.struct("op", "value"), F.struct("ts", "seq")).alias("last"))
    return last.where("last.op = 'HSET'").select("key", "field", "last.value")


def hset_replies(log: DataFrame) -> DataFrame:
    """Whether each HSET made a new field."""
    window = _by("key", "field")
    return log.where(_field_sets()).withColumn("was", F.lag("op").over(window)).where("op = 'HSET'").select("seq", "key", "field", (F.col("was").isNull() | (F.col("was") == "HDEL")).alias("is_new"))


def pushed(log: DataFrame) -> DataFrame:
    """Items and their ords after LPUSHes and RPUSHes only: the first gets 0, then each side counts on its own."""
    window = _by("key")
    first = F.row_number().over(window) == 1
    right = F.count_if(F.col("op") == "RPUSH").over(window) - F.when(F.first("op").over(window) == "RPUSH", 1).otherwise(0)
    left = F.count_if(F.col("op") == "LPUSH").over(window) - F.when(F.first("op").over(window) == "LPUSH", 1).otherwise(0)
    return log.select("key", F.when(first, 0).when(F.col("op") == "RPUSH", right).otherwise(-left).cast("long").alias("ord"), "value")


def lengths(log: DataFrame) -> DataFrame:
    """log with len, the list's length after each push or pop: a pop of an empty list changes nothing."""
    step = F.when(F.col("op").isin("LPUSH", "RPUSH"), 1).otherwise(-1).cast("long")
    summed = log.withColumn("sum", F.sum(step).over(_by("key")))
    return summed.withColumn("len", F.col("sum") - F.least(F.lit(0), F.min("sum").over(_by("key")))).drop("sum")


def queue_pops(log: DataFrame) -> DataFrame:
    """Replies to LPOP where items only come by RPUSH: the n-th pop of a non-empty list has the n-th item."""
    was = lengths(log).withColumn("was", F.coalesce(F.lag("len").over(_by("key")), F.lit(0)))
    pops = was.where("op = 'LPOP'").withColumn("n", F.when(F.col("was") > 0, F.count_if(F.col("was") > 0).over(_by("key"))))
    pushes = log.where("op = 'RPUSH'").withColumn("n", F.row_number().over(_by("key")).cast("long")).select("key", "n", F.col("value").alias("reply"))
    return pops.join(pushes, ["key", "n"], "left").select("seq", "key", "reply")


def stack_pops(log: DataFrame) -> DataFrame:
    """Replies to pops on the side where items come: a pop has the latest item that was pushed at its level."""
    leveled = lengths(log).withColumn("was", F.coalesce(F.lag("len").over(_by("key")), F.lit(0)))
    push = F.col("op").isin("LPUSH", "RPUSH")
    leveled = leveled.withColumn("level", F.when(push, F.col("len")).otherwise(F.col("was")))
    reply = F.last(F.when(push, F.col("value")), ignorenulls=True).over(_before("key", "level"))
    return leveled.withColumn("reply", F.when(F.col("level") > 0, reply)).where(~push).select("seq", "key", "reply")


def epochs(log: DataFrame, every: DataFrame) -> DataFrame:
    """log with epoch, the number of FLUSHALLs up to each row; every has their (ts, seq).

    FLUSHALLs are counted by day, and only those of a row's own day are compared with it."""
    day = F.to_date("ts").alias("day")
    per_day = every.groupBy(day).agg(F.sort_array(F.collect_list(F.struct("ts", "seq"))).alias("barriers"))
    days = log.select(day).distinct().join(per_day, "day", "full").withColumn("barriers", F.coalesce("barriers", F.array().cast("array<struct<ts:timestamp,seq:bigint>>")))
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # a row per day
    days = days.withColumn("earlier", F.coalesce(F.sum(F.size("barriers")).over(earlier), F.lit(0)))
    upto = F.size(F.filter("barriers", lambda b: b <= F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"))))
    return log.withColumn("day", F.to_date("ts")).join(days, "day").withColumn("epoch", F.col("earlier") + upto).drop("day", "barriers", "earlier")


def committed(log: DataFrame, rolled_back: DataFrame) -> DataFrame:
    """log less the transactions in rolled_back (txn)."""
    return log.join(rolled_back, "txn", "left_anti")


def coalesced(log: DataFrame) -> DataFrame:
    """What a flush of each transaction writes: one row per key, its last value."""
    return log.groupBy("txn", "key").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))
