"""Introspection of a keyspace: state rows (keyloom.model.STATE) as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.model import ENTRY_BYTES, FIELD_BYTES, NODE_BYTES


def live(state: DataFrame, now: Column) -> DataFrame:
    """Rows that aren't expired; at equality they are."""
    return state.where(F.col("expire_at").isNull() | (F.col("expire_at") > now))


def keys(state: DataFrame, now: Column) -> DataFrame:
    return live(state, now).select("key")


def key_bytes(state: DataFrame) -> DataFrame:
    return state.select("key", F.octet_length("key").cast("long").alias("key_bytes"))


def entry_bytes() -> Column:
    def total(sizes: Column) -> Column:
        return F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + n)

    fields = total(F.transform(F.map_values("fields"), lambda v: F.octet_length(v).cast("long") + FIELD_BYTES))
    items = total(F.transform("items", lambda x: F.octet_length(x["value"]).cast("long") + NODE_BYTES))
    own = F.when(F.col("type") == "string", F.octet_length("str").cast("long")).when(F.col("type") == "hash", fields).when(F.col("type") == "list", items)
    return F.lit(ENTRY_BYTES).cast("long") + F.coalesce(own, F.lit(0).cast("long"))


def memory_usage(state: DataFrame) -> DataFrame:
    return state.agg(F.coalesce(F.sum(entry_bytes()), F.lit(0).cast("long")).alias("memory_usage"))


def stats(state: DataFrame) -> DataFrame:
    """One row; keys that are expired but not yet evicted count too."""
    kinds = [F.count_if(F.col("type") == k).alias(f"{k}_count") for k in ("string", "int", "hash", "list")]
    return state.agg(F.count("*").alias("key_count"), *kinds, F.count_if(F.col("expire_at").isNotNull()).alias("expiring_count"), F.coalesce(F.sum(entry_bytes()), F.lit(0).cast("long")).alias("memory_usage"))


def info(state: DataFrame, storage: str = "session", persistence: str = "sync_table", worker: bool = False) -> DataFrame:
    text = f"# keyspace\nversion:1.0\nstorage_mode:{storage}\npersistence_mode:{persistence}\nbackground_worker_enabled:{'yes' if worker else 'no'}\nkey_count:%d\nmemory_usage:%d\n"
    return stats(state).select(F.format_string(text, "key_count", "memory_usage").alias("info"))


def snapshot(state: DataFrame, now: Column) -> DataFrame:
    """(key_count, payload): all live entries as one JSON array; bounded by the keyspace, as a snapshot's row is."""
    value = F.when(F.col("type").isin("string", "int"), F.to_json(F.struct(F.coalesce("str", F.col("int").cast("string")).alias("value")))).when(F.col("type") == "hash", F.to_json(F.struct("fields"))).otherwise(F.to_json(F.struct(F.transform("items", lambda x: x["value"]).alias("items"))))
    expiry = F.when(F.col("expire_at").isNotNull(), F.concat(F.lit(',"expire_at":'), F.to_json(F.struct(F.col("expire_at").alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("expire_at").alias("t")))) - 6))).otherwise("")
    entry = F.concat(F.to_json(F.struct("key", "type")).substr(F.lit(1), F.length(F.to_json(F.struct("key", "type"))) - 1), F.lit(',"value":'), value, expiry, F.lit("}"))
    return live(state, now).select("key", entry.alias("entry")).agg(F.count("*").alias("key_count"), F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "entry"))), lambda x: x["entry"]), ","), F.lit("]")).alias("payload"))


def snapshot_rows(payload: DataFrame) -> DataFrame:
    """The entries of snapshots: key, type, and the value's JSON."""
    parsed = payload.select(F.explode(F.from_json("payload", "array<struct<key:string,type:string,value:string>>")).alias("e"))
    return parsed.select("e.key", "e.type", "e.value")
