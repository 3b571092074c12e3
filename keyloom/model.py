"""Schemas, limits, configuration and errors of the keyspace."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

COMMAND = "seq long, ts timestamp, txn long, op string, key string, field string, value string, seconds int"
REPLY = "seq long, op string, key string, reply_text string, reply_int long, reply_bool boolean, err_state string, err_msg string, err_detail string"
ITEMS = "array<struct<ord:long,value:string>>"
STATE = f"key string, type string, str string, int long, fields map<string,string>, items {ITEMS}, expire_at timestamp, version long"
STORE = "key string, type string, value binary, expire_at timestamp, version long, updated_at timestamp"
HASH_FIELDS = "key string, field string, value binary"
LIST_ITEMS = "key string, ord long, value binary"
EVENT = "pos long, etype string, value_type string, key string, field string, ord long, value binary, expire_at timestamp, has_expire boolean, version long"
SNAPSHOTS = "snapshot_id string, created_at timestamp, key_count long, payload string"
STATS = ("key_count", "string_count", "int_count", "hash_count", "list_count", "expiring_count", "memory_usage")

MAX_NAME, SHARED_HASH_VALUE = 1024, 65535
#: Bytes that the reference layout takes for an entry, a hash field and a list node; fixed values.
ENTRY_BYTES, FIELD_BYTES, NODE_BYTES = 1088, 1056, 48

READS = frozenset(("GET", "EXISTS", "TTL", "HGET", "HEXISTS", "LLEN"))
#: Arguments of each command besides the key.
ARGUMENTS = {
    "SET": ("value",), "GET": (), "DEL": (), "EXISTS": (), "EXPIRE": ("seconds",), "TTL": (), "INCR": (), "DECR": (), "HSET": ("field", "value"), "HGET": ("field",),
    "HDEL": ("field",), "HEXISTS": ("field",), "LPUSH": ("value",), "RPUSH": ("value",), "LPOP": (), "RPOP": (), "LLEN": (),
}


class KvError(Exception):
    """A command's error: SQLSTATE, message, detail."""

    def __init__(self, sqlstate: str, message: str, detail: str | None = None):
        super().__init__(message)
        self.sqlstate, self.message, self.detail = sqlstate, message, detail


PERSISTENCE = ("none", "sync_table", "async_table", "snapshot", "aof")
STORAGE = ("session", "shared")
FULL_ACTIONS = ("block", "sync_flush")


@dataclass
class KeyspaceConfig:
    """Settings; seconds, bytes and counts. Some have no counterpart in Spark and are kept so that programs can set them."""

    persistence_mode: str = "sync_table"
    storage_mode: str = "session"
    flush_interval: int = 5
    flush_batch_size: int = 1000
    ttl_cleanup_interval: int = 30
    max_key_size: int = 1024
    max_value_size: int = 1048576
    enable_background_worker: bool = False
    shared_max_memory: int = 256
    dirty_ring_size: int = 65536
    lock_partitions: int = 16
    bgworker_database: str = "postgres"
    async_full_action: str = "block"
    ring_reclaim_tick_interval: int = 1024
    ring_slot_stuck_timeout: int = 5000

    def __post_init__(self) -> None:
        for name, allowed in (("persistence_mode", PERSISTENCE), ("storage_mode", STORAGE), ("async_full_action", FULL_ACTIONS)):
            if getattr(self, name) not in allowed:
                raise KvError("22023", f'invalid value for {name}: "{getattr(self, name)}"', f"Allowed values: {', '.join(allowed)}")
        for name, low, high in (("flush_interval", 1, 3600), ("shared_max_memory", 1, 32768), ("dirty_ring_size", 1024, 1048576), ("lock_partitions", 1, 128)):
            if not low <= getattr(self, name) <= high:
                raise KvError("22023", f"{name} must be between {low} and {high}")

    def effective_persistence(self) -> str:
        """async_table needs shared storage; without it writes are synchronous, with a warning."""
        if self.persistence_mode == "async_table" and self.storage_mode != "shared":
            warnings.warn("async_table needs storage_mode = shared; using sync_table", stacklevel=2)
            return "sync_table"
        return self.persistence_mode
