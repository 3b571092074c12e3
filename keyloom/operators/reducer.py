"""The state machine of one key: the single source of truth for what commands do.

apply() takes a key's entry (None if there is none) and a command, and returns the new entry and the reply, or raises KvError
without having changed anything. Times are microseconds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from keyloom.model import ARGUMENTS, MAX_NAME, SHARED_HASH_VALUE, KvError

LOW, HIGH = -(2**63), 2**63 - 1
INTEGER = re.compile(r"[ \t\n\v\f\r]*[+-]?[0-9]+", re.A)
REMOVED = object()


@dataclass(frozen=True)
class Entry:
    type: str
    str: str | None = None
    int: int | None = None
    fields: dict = field(default_factory=dict)
    items: tuple = ()
    expire_at: int | None = None
    version: int = 1

    def expired(self, now: int) -> bool:
        return self.expire_at is not None and now >= self.expire_at


@dataclass(frozen=True)
class Limits:
    key: int = MAX_NAME
    value: int = 1048576
    hash_value: int | None = None

    @classmethod
    def of(cls, config) -> Limits:
        return cls(min(config.max_key_size, MAX_NAME), config.max_value_size, SHARED_HASH_VALUE if config.storage_mode == "shared" else None)


def parse_int(text: str) -> int | None:
    if len(text.encode()) > 31 or not INTEGER.fullmatch(text):
        return None
    return n if LOW <= (n := int(text)) <= HIGH else None


def _named(what: str, name: str, most: int) -> None:
    n = len(name.encode())
    if not n:
        raise KvError("22023", f"{what} must not be empty")
    if n > most:
        raise KvError("54000", f"{what} length {n} exceeds maximum {most}")


def _checked(op: str, key: str, args: dict, limits: Limits) -> None:
    _named("key", key, limits.key)
    if "field" in ARGUMENTS[op]:
        _named("field", args["field"], MAX_NAME)
    if "value" in ARGUMENTS[op]:
        n = len(args["value"].encode())
        most = limits.hash_value if op == "HSET" and limits.hash_value else limits.value
        if (limits.value > 0 and n > limits.value) or (op == "HSET" and limits.hash_value and n > most):
            raise KvError("54000", f"value length {n} exceeds maximum {min(most, limits.value) if limits.value > 0 else most}")


def apply(entry: Entry | None, op: str, key: str | None, now: int, limits: Limits = Limits(), **args):  # noqa: B008
    """Return (entry, reply). A null argument gives a null reply and changes nothing."""
    if op not in ARGUMENTS:
        raise KvError("42883", f'unknown command "{op}"')
    if key is None or any(args.get(a) is None for a in ARGUMENTS[op]):
        return entry, None
    _checked(op, key, args, limits)
    if op == "DEL":  # whether it is there, expired or not
        return None, entry is not None
    if entry is not None and entry.expired(now):
        entry = None
    return _COMMANDS[op](entry, key, now, **{a: args[a] for a in ARGUMENTS[op]})


def _typed(entry: Entry | None, key: str, *kinds: str) -> None:
    if entry is not None and entry.type not in kinds:
        raise KvError("42804", "WRONGTYPE operation against key holding the wrong kind of value", f'key "{key}" has type {entry.type}, command expects {kinds[0]}')


def _touched(entry: Entry, **changes) -> Entry:
    return replace(entry, version=entry.version + 1, **changes)


def _set(entry, key, now, value):
    old = entry or Entry("string")
    return _touched(old, type="string", str=value, int=None, fields={}, items=()), True


def _get(entry, key, now):
    _typed(entry, key, "string", "int")
    return entry, None if entry is None else entry.str if entry.type == "string" else str(entry.int)


def _exists(entry, key, now):
    return entry, entry is not None


def _expire(entry, key, now, seconds):
    if entry is None:
        return None, False
    return (None, True) if seconds <= 0 else (_touched(entry, expire_at=now + seconds * 1_000_000), True)


def _ttl(entry, key, now):
    return entry, -2 if entry is None else -1 if entry.expire_at is None else -(-(entry.expire_at - now) // 1_000_000)


def _add(step):
    def change(entry, key, now):
        _typed(entry, key, "int", "string")
        base = 0 if entry is None else entry.int if entry.type == "int" else parse_int(entry.str)
        if base is None:
            raise KvError("22P02", f'value at key "{key}" is not an integer')
        if not LOW <= base + step <= HIGH:
            raise KvError("22003", f'value at key "{key}" is out of range')
        return _touched(entry or Entry("int"), type="int", str=None, int=base + step), base + step

    return change


def _hset(entry, key, now, field, value):
    _typed(entry, key, "hash")
    old = entry or Entry("hash")
    return _touched(old, fields={**old.fields, field: value}), field not in old.fields


def _hget(entry, key, now, field):
    _typed(entry, key, "hash")
    return entry, None if entry is None else entry.fields.get(field)


def _hdel(entry, key, now, field):
    _typed(entry, key, "hash")
    if entry is None or field not in entry.fields:
        return entry, False
    return _touched(entry, fields={f: v for f, v in entry.fields.items() if f != field}), True


def _hexists(entry, key, now, field):
    _typed(entry, key, "hash")
    return entry, entry is not None and field in entry.fields


def _push(left):
    def change(entry, key, now, value):
        _typed(entry, key, "list")
        old = entry or Entry("list")
        place = 0 if not old.items else old.items[0][0] - 1 if left else old.items[-1][0] + 1
        items = ((place, value), *old.items) if left else (*old.items, (place, value))
        return _touched(old, items=items), len(items)

    return change


def _pop(left):
    def change(entry, key, now):
        _typed(entry, key, "list")
        if entry is None or not entry.items:
            return entry, None
        gone, rest = (entry.items[0], entry.items[1:]) if left else (entry.items[-1], entry.items[:-1])
        return _touched(entry, items=rest), gone[1]

    return change


def _llen(entry, key, now):
    _typed(entry, key, "list")
    return entry, 0 if entry is None else len(entry.items)


_COMMANDS = {
    "SET": _set, "GET": _get, "EXISTS": _exists, "EXPIRE": _expire, "TTL": _ttl, "INCR": _add(1), "DECR": _add(-1), "HSET": _hset, "HGET": _hget, "HDEL": _hdel, "HEXISTS": _hexists,
    "LPUSH": _push(True), "RPUSH": _push(False), "LPOP": _pop(True), "RPOP": _pop(False), "LLEN": _llen,
}
