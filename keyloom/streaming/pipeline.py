"""The asynchronous path: a command stream, per-key state, change events, and an idempotent drain to tables.

Commands arrive as files; the stream folds each key with the same reducer as the batch path. State lives in the streaming
state store, offsets in the checkpoint, so a restarted query repeats a batch at most, and the drain writes a batch's rows
under its number and puts last entries in place of older ones, which makes the repetition harmless. Rate limits take the place
of a bounded queue.
"""

from __future__ import annotations

import pickle
import time
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keyloom.functions import codec
from keyloom.model import KvError
from keyloom.operators.fold import FOLDED, NO_REPLY, reply_columns, state_columns
from keyloom.operators.reducer import Entry, apply
from keyloom.shipping import ship
from keyloom.sources.store import Store, work_folder

#: Commands that a micro-batch takes from each trigger, in files.
FILES_PER_TRIGGER = 1000
COLUMNS = [c.split()[0] for c in FOLDED.replace("struct<ord:long,value:string>", "x").replace("map<string,string>", "x").split(", ")]


def _dropped(key: str, old: Entry | None, new: Entry | None) -> list[tuple]:
    """A row of kind dropped with the fields and places that an entry has lost; a removed key takes its children along."""
    if old is None or new is None:
        return []
    fields = {f: None for f in old.fields if f not in new.fields}
    places = {o for o, _ in new.items}
    items = [{"ord": o, "value": None} for o, _ in old.items if o not in places]
    return [("dropped", None, None, key, *NO_REPLY, old.type, None, None, fields, items, None, new.version)] if fields or items else []


def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, timers: bool) -> Iterator[pd.DataFrame]:
    """Fold a key's new commands into its entry; yields replies, the entry that is left and what it lost.

    With timers an entry whose time has come is removed without a command.
    """
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([("gone", None, None, key[0], *NO_REPLY, *state_columns(None))], columns=COLUMNS, dtype=object)
        return
    before = entry = pickle.loads(state.get[0]) if state.exists else None
    group, out = pd.concat(list(batches)).sort_values(["us", "seq"]), []
    for seq, us, op, name, value, seconds in zip(*(group[c] for c in ("seq", "us", "op", "field", "value", "seconds")), strict=True):
        none = lambda v: None if pd.isna(v) else v
        try:
            entry, reply = apply(entry, op, key[0], us, field=none(name), value=none(value), seconds=None if pd.isna(seconds) else int(seconds))
        except KvError as e:
            reply = e
        out.append(("reply", seq, op, key[0], *reply_columns(reply), *(None,) * 7))
    out.append(("state" if entry is not None else "gone", None, None, key[0], *NO_REPLY, *state_columns(entry)))
    out += _dropped(key[0], before, entry)
    if entry is not None:
        state.update((pickle.dumps(entry),))
        if timers and entry.expire_at is not None:
            state.setTimeoutTimestamp(max(entry.expire_at // 1000, state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=COLUMNS, dtype=object)


def replied(commands: DataFrame, lateness: str | None = None) -> DataFrame:
    """A stream of FOLDED rows from a stream of commands; entries of removed keys are rows of kind gone.

    With a lateness ("10 minutes") expired entries leave the state once the commands' times have passed them by that much;
    commands that are later than that are ignored. Without one all commands count, and entries stay until a command meets them.
    """
    ship(commands.sparkSession)
    rows = commands.select("seq", F.col("ts").cast("timestamp").alias("ts"), "op", "key", "field", "value", "seconds")
    if lateness is not None:
        rows = rows.withWatermark("ts", lateness)
    rows = rows.withColumn("us", F.unix_micros("ts"))
    timers = lateness is not None

    def fold(key, batches, state):
        return step(key, batches, state, timers)

    return rows.groupBy("key").applyInPandasWithState(fold, FOLDED, "entry binary", "append", GroupStateTimeout.EventTimeTimeout if timers else GroupStateTimeout.NoTimeout)


def run(log: DataFrame, files: int = 3, store: Store | None = None, lateness: str | None = None) -> tuple[SparkSession, str]:
    """Send a log through the stream until it is used up; return where each micro-batch's rows are.

    The log is written as files of ascending time, one per micro-batch, as a producer would. With a store, each micro-batch's
    entries become a version of its tables.
    """
    spark, folder = log.sparkSession, work_folder(log.sparkSession, "stream")
    cuts = log.select(F.percentile_approx(F.unix_micros("ts"), [k / files for k in range(1, files)], 1000)).first()[0] if files > 1 else []
    part = sum(((F.unix_micros("ts") > c).cast("int") for c in cuts or []), F.lit(0))
    cut = log.withColumn("part", part)
    for k in range(files):
        cut.where(F.col("part") == k).drop("part").coalesce(1).write.parquet(f"{folder}/in/part={k}")

    def drain(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        if store is not None:
            rows = spark.read.schema(FOLDED).parquet(f"{folder}/out/batch={number}")
            if not rows.isEmpty():
                store.commit(state_rows(rows), rows.where("kind = 'gone'").select("key"), F.timestamp_micros(F.lit(time.time_ns() // 1000)))

    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER if files == 1 else 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    query = replied(stream, lateness).writeStream.foreachBatch(drain).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark, folder


def streamed_replies(log: DataFrame) -> DataFrame:
    spark, folder = run(log)
    rows = spark.read.schema(f"{FOLDED}, batch int").parquet(f"{folder}/out")
    return rows.where("kind = 'reply'").select("seq", "op", "key", "reply_text", "reply_int", "reply_bool", "err_state", "err_msg", "err_detail")


def state_rows(folded: DataFrame) -> DataFrame:
    """The entries of FOLDED rows, as the durable tables take them."""
    return folded.where("kind = 'state'").select("key", "type", "str", "int", "fields", "items", F.timestamp_micros("expire_us").alias("expire_at"), "version")


def drained(log: DataFrame) -> DataFrame:
    """The durable tables' entries after the last micro-batch of a log."""
    store = Store(log.sparkSession)
    run(log, store=store)
    return store.state().select("key", "type", "str", "int", "fields", "items", "version")


def streamed_events(log: DataFrame) -> DataFrame:
    """The change events of a log's micro-batches, in the order of pos: the number of the micro-batch."""
    spark, folder = run(log)
    return events(spark.read.schema(f"{FOLDED}, batch int").parquet(f"{folder}/out"), F.col("batch").cast("long"))


def events(folded: DataFrame, pos: Column | None = None) -> DataFrame:
    """Change events of micro-batches' entries, of six kinds: keys put and removed, and their fields and items put and removed."""
    folded = folded.withColumn("pos", F.lit(0).cast("long") if pos is None else pos)
    state, dropped = folded.where("kind IN ('state', 'gone')"), folded.where("kind = 'dropped'")

    def base(df: DataFrame, kind: str, field: Column | None = None, ord: Column | None = None, value: Column | None = None) -> DataFrame:
        own = [(F.lit(None) if c is None else c).cast(t).alias(n) for n, t, c in (("field", "string", field), ("ord", "long", ord), ("value", "binary", value))]
        return df.select("pos", F.lit(kind).alias("etype"), F.col("type").alias("value_type"), "key", *own, F.timestamp_micros("expire_us").alias("expire_at"), F.col("expire_us").isNotNull().alias("has_expire"), "version")

    fields = lambda df: df.select("*", F.explode("fields").alias("f", "v"))
    items = lambda df: df.select("*", F.explode("items").alias("i"))
    kinds = [
        base(state.where("kind = 'state'"), "KEY_UPSERT", value=codec.encode(F.col("type"), F.col("str"), F.col("int"))),
        base(state.where("kind = 'gone'"), "KEY_DELETE"),
        base(fields(state.where("type = 'hash'")), "HASH_FIELD_UPSERT", field=F.col("f"), value=F.encode("v", "UTF-8")),
        base(items(state.where("type = 'list'")), "LIST_ITEM_INSERT", ord=F.col("i.ord"), value=F.encode("i.value", "UTF-8")),
        base(fields(dropped), "HASH_FIELD_DELETE", field=F.col("f")),
        base(items(dropped), "LIST_ITEM_DELETE", ord=F.col("i.ord")),
    ]
    out = reduce(DataFrame.unionByName, kinds)
    return out.drop("pos") if pos is None else out


def replayed(events: DataFrame) -> dict[str, DataFrame]:
    """The tables' rows that a queue of events (with pos) leaves: keys, fields and items, without those of removed keys."""
    last = last_writes(events)
    gone = events.where("etype = 'KEY_DELETE'").groupBy("key").agg(F.max("pos").alias("gone"))
    kept = last.join(gone, "key", "left").where(~F.col("etype").endswith("_DELETE") & (F.col("gone").isNull() | (F.col("pos") > F.col("gone"))))
    return {
        "store": kept.where("etype = 'KEY_UPSERT'").select("key", F.col("value_type").alias("type"), "value", "expire_at", "version"),
        "hash_fields": kept.where("etype = 'HASH_FIELD_UPSERT'").select("key", "field", "value"),
        "list_items": kept.where("etype = 'LIST_ITEM_INSERT'").select("key", "ord", "value"),
    }


def last_writes(events: DataFrame) -> DataFrame:
    """Events of a queue (with pos), the last one per key, field and ord, deletions included."""
    return events.groupBy("key", "field", "ord").agg(F.max_by(F.struct(*[c for c in events.columns if c not in ("key", "field", "ord")]), "pos").alias("l")).select("key", "field", "ord", "l.*")
