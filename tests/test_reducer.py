"""Command sequences with the replies they must have; property tests of the reducer against plain structures."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.model import KeyspaceConfig, KvError
from keyloom.operators.reducer import Limits, apply, parse_int

SECOND = 1_000_000


class Keyspace:
    def __init__(self, limits=Limits()):
        self.entries, self.now, self.limits = {}, 0, limits

    def __call__(self, op, key, *args):
        names = {"SET": ("value",), "EXPIRE": ("seconds",), "HSET": ("field", "value"), "HGET": ("field",), "HDEL": ("field",), "HEXISTS": ("field",), "LPUSH": ("value",), "RPUSH": ("value",)}.get(op, ())
        entry, reply = apply(self.entries.get(key), op, key, self.now, self.limits, **dict(zip(names, args)))
        self.entries[key] = entry
        if entry is None:
            del self.entries[key]
        return reply

    def error(self, *command):
        with pytest.raises(KvError) as e:
            self(*command)
        return e.value.sqlstate


@pytest.fixture
def kv():
    return Keyspace()


def test_strings(kv):
    assert kv("GET", "nope") is None and kv("EXISTS", "nope") is False
    assert kv("SET", "k", "hello") is True and kv("GET", "k") == "hello" and kv("EXISTS", "k") is True
    assert kv("SET", "k", "") is True and kv("GET", "k") == ""
    assert kv("DEL", "k") is True and kv("DEL", "k") is False and kv("EXISTS", "k") is False


def test_counters(kv):
    assert [kv("INCR", "c"), kv("INCR", "c"), kv("DECR", "c"), kv("GET", "c")] == [1, 2, 1, "1"]
    kv("SET", "bad", "not-a-number")
    assert kv.error("INCR", "bad") == "22P02" and kv("GET", "bad") == "not-a-number"
    for text, number in ((" 7", 8), ("+7", 8), ("-7", -6)):
        kv("SET", "n", text)
        assert kv("INCR", "n") == number
    for text in ("7 ", "7x", "", "1" * 32, str(2**63)):
        kv("SET", "n", text)
        assert kv.error("INCR", "n") == "22P02"
    kv("SET", "n", str(2**63 - 1))
    assert kv.error("INCR", "n") == "22003"


def test_expiry(kv):
    assert kv("TTL", "k") == -2 and kv("EXPIRE", "k", 60) is False
    kv("SET", "k", "v")
    assert kv("TTL", "k") == -1 and kv("EXPIRE", "k", 60) is True
    kv.now += 1
    assert kv("TTL", "k") == 60
    kv("SET", "k", "w")
    assert kv("TTL", "k") == 60, "SET keeps the expiry"
    kv.now = 60 * SECOND
    assert kv("EXISTS", "k") is False
    kv("SET", "k", "v")
    assert kv("TTL", "k") == -1 and kv("EXPIRE", "k", 0) is True and kv("EXISTS", "k") is False
    kv("SET", "k", "v")
    assert kv("EXPIRE", "k", -5) is True and kv("TTL", "k") == -2
    kv("SET", "k", "v")
    kv("EXPIRE", "k", 1)
    kv.now += 2 * SECOND
    assert kv("DEL", "k") is True, "an expired key that nothing has touched is still there"


def test_hashes(kv):
    assert kv("HSET", "u", "name", "Alice") is True and kv("HSET", "u", "name", "Bob") is False and kv("HGET", "u", "name") == "Bob"
    kv("HSET", "u", "age", "30")
    assert kv("HEXISTS", "u", "age") is True and kv("HEXISTS", "u", "x") is False and kv("HGET", "u", "x") is None
    assert kv("HDEL", "u", "age") is True and kv("HDEL", "u", "age") is False
    kv("HDEL", "u", "name")
    assert kv("EXISTS", "u") is True
    kv("SET", "s", "x")
    assert kv.error("HSET", "s", "f", "v") == kv.error("GET", "u") == kv.error("LPUSH", "u", "v") == "42804"


def test_lists(kv):
    assert kv("LLEN", "q") == 0
    assert [kv("RPUSH", "q", v) for v in "abc"] == [1, 2, 3] and kv("LPUSH", "q", "X") == 4
    assert [kv("LPOP", "q"), kv("RPOP", "q"), kv("LLEN", "q"), kv("LPOP", "q"), kv("LPOP", "q"), kv("LLEN", "q"), kv("LPOP", "q"), kv("EXISTS", "q")] == ["X", "c", 2, "a", "b", 0, None, True]
    kv("LPUSH", "o", "a"), kv("LPUSH", "o", "b"), kv("RPUSH", "o", "c")
    assert kv("LPOP", "o") == "b" and kv.entries["o"].items == ((0, "a"), (1, "c"))


def test_limits_and_nulls(kv):
    assert kv.error("GET", "") == "22023" and kv.error("SET", "é" * 513, "v") == "54000" and kv("SET", "é" * 512, "v") is True
    assert kv.error("HSET", "h", "", "v") == "22023" and kv.error("SET", "k", "x" * 1048577) == "54000"
    assert kv("SET", None, "v") is None and kv("SET", "k", None) is None and kv("EXPIRE", "k", None) is None
    shared = Keyspace(Limits.of(KeyspaceConfig(storage_mode="shared")))
    assert shared("HSET", "h", "f", "x" * 65535) is True and shared.error("HSET", "h", "g", "x" * 65536) == "54000" and shared("HGET", "h", "f") == "x" * 65535


def test_versions(kv):
    kv("SET", "k", "v")
    assert kv.entries["k"].version == 2
    kv("EXPIRE", "k", 9), kv("GET", "k")
    assert kv.entries["k"].version == 3


def test_settings():
    with pytest.raises(KvError):
        KeyspaceConfig(persistence_mode="disk")
    with pytest.raises(KvError):
        KeyspaceConfig(dirty_ring_size=1)
    with pytest.warns(UserWarning):
        assert KeyspaceConfig(persistence_mode="async_table").effective_persistence() == "sync_table"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["LPUSH", "RPUSH", "LPOP", "RPOP", "LLEN"]), st.text(min_size=1, max_size=3))))
def test_lists_are_deques(commands):
    kv, model = Keyspace(), []
    for op, value in commands:
        got = kv(op, "q", value)
        if op == "LPUSH":
            model.insert(0, value)
        elif op == "RPUSH":
            model.append(value)
        elif op in ("LPOP", "RPOP"):
            assert got == (model.pop(0 if op == "LPOP" else -1) if model else None)
        if "PUSH" in op or op == "LLEN":
            assert got == len(model)


@given(st.text(max_size=40))
def test_parse_int_is_strict(text):
    n = parse_int(text)
    assert n is None or int(text.strip(" \t\n\v\f\r")) == n
