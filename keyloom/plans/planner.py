"""Which path serves a log: set-based forms where they are exact, else the fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Mixes of commands with a closed form, by name.
FORMS = {"register": {"SET", "DEL", "GET"}, "counter": {"INCR", "DECR"}, "fields": {"HSET", "HDEL", "HGET", "HEXISTS"}, "pushes": {"LPUSH", "RPUSH"}, "queue": {"RPUSH", "LPOP"}, "stack": {"LPUSH", "LPOP"}, "tail": {"RPUSH", "RPOP"}}


def choose(log: DataFrame) -> str:
    """The first form that covers all commands of the log (a small aggregation), or "fold"."""
    ops = {r.op for r in log.select("op").distinct().collect()}  # at most the number of commands there are
    if not log.where(F.col("op") == "EXPIRE").isEmpty():
        return "fold"
    return next((name for name, covered in FORMS.items() if ops <= covered), "fold")
