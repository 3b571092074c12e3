"""The general path: an ordered fold of a command log per key, right for any mix of commands.

All of a key's commands are folded in one task, so this serves logs whose keys are many; hot counters, registers, fields and
queues have set-based forms in keyloom.operators.batch.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.model import ITEMS, KvError
from keyloom.operators.reducer import Entry, Limits, apply
from keyloom.shipping import ship

FOLDED = f"kind string, seq long, op string, key string, reply_text string, reply_int long, reply_bool boolean, err_state string, err_msg string, err_detail string, type string, str string, int long, fields map<string,string>, items {ITEMS}, expire_us long, version long"
NO_REPLY = (None,) * 6


def reply_columns(reply) -> tuple:
    """(text, int, bool, state, message, detail) of a reply or an error."""
    if isinstance(reply, KvError):
        return None, None, None, reply.sqlstate, reply.message, reply.detail
    return reply if isinstance(reply, str) else None, reply if isinstance(reply, int) and not isinstance(reply, bool) else None, reply if isinstance(reply, bool) else None, None, None, None


def state_columns(entry: Entry | None) -> tuple:
    if entry is None:
        return (None,) * 7
    return entry.type, entry.str, entry.int, entry.fields if entry.type == "hash" else None, [{"ord": o, "value": v} for o, v in entry.items] if entry.type == "list" else None, entry.expire_at, entry.version


def fold(log: DataFrame, limits: Limits = Limits(), by: tuple[str, ...] = ("key",)) -> DataFrame:  # noqa: B008
    """log (seq, ts, op, key, field, value, seconds): FOLDED rows, of kind reply per command and of kind state per key that is left.

    Commands of a key are applied in the order of (ts, seq); ts is the logical clock. Commands without a key give null replies.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        entry, out = None, []
        group = group.sort_values(["us", "seq"])
        for seq, us, op, key, name, value, seconds in zip(*(group[c] for c in ("seq", "us", "op", "key", "field", "value", "seconds")), strict=True):
            none = lambda v: None if pd.isna(v) else v
            key = none(key)
            try:
                entry, reply = apply(entry, op, key, us, limits, field=none(name), value=none(value), seconds=None if pd.isna(seconds) else int(seconds))
            except KvError as e:
                reply = e
            out.append(("reply", seq, op, key, *reply_columns(reply), *(None,) * 7))
        if entry is not None:
            out.append(("state", None, None, key, *NO_REPLY, *state_columns(entry)))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in FOLDED.replace("struct<ord:long,value:string>", "x").replace("map<string,string>", "x").split(", ")], dtype=object)
        return frame

    ship(log.sparkSession)
    rows = log.select("seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "op", "key", "field", "value", "seconds", *[c for c in by if c != "key"])
    return rows.groupBy(*by).applyInPandas(run, FOLDED)


def replies(folded: DataFrame) -> DataFrame:
    return folded.where("kind = 'reply'").select("seq", "op", "key", "reply_text", "reply_int", "reply_bool", "err_state", "err_msg", "err_detail")


def states(folded: DataFrame) -> DataFrame:
    return folded.where("kind = 'state'").select("key", "type", "str", "int", "fields", "items", F.timestamp_micros("expire_us").alias("expire_at"), "version")
