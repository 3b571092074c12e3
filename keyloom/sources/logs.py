"""Command logs from tables: each names the commands that the rows of a table stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def command(op: Column | str, key: Column, field: Column | None = None, value: Column | None = None, seconds: Column | None = None, seq: Column | None = None, txn: Column | None = None) -> list[Column]:
    """The columns of a command log."""
    none = F.lit(None)
    return [
        (F.col("event_id") if seq is None else seq).cast("long").alias("seq"), F.col("ts"), (none if txn is None else txn).cast("long").alias("txn"), (F.lit(op) if isinstance(op, str) else op).alias("op"), key.alias("key"),
        (none if field is None else field).cast("string").alias("field"), (none if value is None else value).cast("string").alias("value"), (none if seconds is None else seconds).cast("int").alias("seconds"),
    ]


def user() -> Column:
    return F.concat(F.lit("user:"), F.col("user_id").cast("string"))


def queue() -> Column:
    return F.concat(F.lit("q:"), F.col("user_id").cast("string"))


def sets(spark: SparkSession, sf_dir: str, deletes: bool = False) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "DEL").otherwise("SET") if deletes else "SET"
    return events(spark, sf_dir).select(*command(op, user(), value=F.col("event_type"), txn=F.floor(F.col("event_id") / 10)))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "DECR").otherwise("INCR")
    return events(spark, sf_dir).select(*command(op, F.concat(F.lit("cnt:"), "event_type")))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("event_type") == "error"
    return events(spark, sf_dir).select(*command(F.when(bad, "HDEL").otherwise("HSET"), user(), F.when(bad, "view").otherwise(F.col("event_type")), F.col("event_id")))


def pushes_and_pops(spark: SparkSession, sf_dir: str, push: str, pop: str) -> DataFrame:
    op = F.when(F.col("event_id") % 3 == 0, pop).otherwise(push)
    return events(spark, sf_dir).select(*command(op, queue(), value=F.col("event_id")))


def deque(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = F.array(*map(F.lit, ("LPUSH", "RPUSH", "LPOP", "RPOP", "LLEN")))
    return events(spark, sf_dir).select(*command(F.get(ops, (F.col("event_id") % 5).cast("int")), queue(), value=F.col("event_id")))


def mixed_pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(*command(F.when(F.col("event_id") % 2 == 0, "LPUSH").otherwise("RPUSH"), queue(), value=F.col("event_id")))


def mixed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families on one key per user."""
    kind = F.col("event_type")
    op = F.when(kind == "click", "SET").when(kind == "view", "HSET").when(kind == "purchase", "LPUSH").when(kind == "signup", "DEL").otherwise("GET")
    return events(spark, sf_dir).select(*command(op, F.concat(F.lit("m:"), F.col("user_id").cast("string")), F.lit("f"), F.col("event_id")))


def keyspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state rows of a keyspace of all types: strings and lists from events, ints from counts, hashes from hash commands."""
    from keyloom.operators import batch

    items = "array<struct<ord:long,value:string>>"
    base = lambda df, kind, **c: df.select("key", F.lit(kind).alias("type"), *[c.get(n, F.lit(None)).cast(t).alias(n) for n, t in (("str", "string"), ("int", "long"), ("fields", "map<string,string>"), ("items", items), ("expire_at", "timestamp"), ("version", "long"))])
    strings = base(batch.last_values(sets(spark, sf_dir)).withColumn("key", F.concat(F.lit("s:"), "key")), "string", str=F.col("value"), version=F.lit(2))
    ints = base(batch.counters(counts(spark, sf_dir)), "int", int=F.col("value"), version=F.lit(2))
    maps = batch.fields(hashes(spark, sf_dir)).groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("f"))
    hashed = base(maps.withColumn("key", F.concat(F.lit("h:"), "key")), "hash", fields=F.col("f"), version=F.lit(2))
    lists = batch.pushed(mixed_pushes(spark, sf_dir)).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("l"))
    return strings.unionByName(ints).unionByName(hashed).unionByName(base(lists, "list", items=F.col("l"), version=F.lit(2)))
