"""A keyspace's durable tables: versions of three Parquet tables, and a manifest that names the current one.

A commit writes new files beside the old ones and then adds the next manifest, which names them, in one rename that fails if
another commit from the same version was first. So readers see a whole version or the one before, and no commit is lost. Rows of keys that aren't touched are carried over by anti-joins; a touched key's children are replaced.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import codec
from keyloom.model import HASH_FIELDS, LIST_ITEMS, STORE, KvError

TABLES = {"store": STORE, "hash_fields": HASH_FIELDS, "list_items": LIST_ITEMS}


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the driver and the executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or "file:///tmp/checkpoints"
    return f"{shared.rstrip('/')}/keyspace/{name}-{uuid.uuid4().hex}"


class Store:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, (folder or work_folder(spark, "store")).rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(self._conf)

    def version(self) -> str | None:
        """The current version's folder, which the newest manifest names."""
        return self.text("manifests")

    def table(self, name: str, version: str | None = None) -> DataFrame:
        version = version or self.version()
        return self.spark.createDataFrame([], TABLES[name]) if version is None else self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{version}/{name}")

    def state(self, now: Column | None = None, key: str | None = None) -> DataFrame:
        """STATE rows of all keys (of live ones at now, or of one key); empty hashes and lists have rows too.

        One key's rows are found by a filter that reaches the files, so nothing else is read, shuffled or sent.
        """
        version = self.version()
        own = lambda name: self.table(name, version) if key is None else self.table(name, version).where(F.col("key") == key)
        store = own("store")
        store = store if now is None else store.where(F.col("expire_at").isNull() | (F.col("expire_at") > now))
        fields = own("hash_fields").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("field", F.decode("value", "UTF-8")))).alias("fields"))
        items = own("list_items").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", F.decode("value", "UTF-8").alias("value")))).alias("items"))
        rows = store.join(fields, "key", "left").join(items, "key", "left")
        no_fields, no_items = F.create_map().cast("map<string,string>"), F.array().cast("array<struct<ord:long,value:string>>")
        return rows.select("key", "type", codec.decode_string(F.col("value")).alias("str"), codec.decode_int(F.col("value")).alias("int"), F.when(F.col("type") == "hash", F.coalesce("fields", no_fields)).alias("fields"), F.when(F.col("type") == "list", F.coalesce("items", no_items)).alias("items"), "expire_at", "version")

    def commit(self, changed: DataFrame, removed: DataFrame | None, now: Column) -> None:
        """Put the STATE rows of changed in place, and remove the keys of removed (key) with their children."""
        base = self.version()
        touched = changed.select("key") if removed is None else changed.select("key").union(removed.select("key"))
        rest = lambda name: self.table(name, base).join(touched, "key", "left_anti")
        parents = changed.select("key", "type", codec.encode(F.col("type"), F.col("str"), F.col("int")).alias("value"), "expire_at", "version", now.alias("updated_at"))
        fields = changed.where("type = 'hash'").select("key", F.explode("fields").alias("field", "v")).select("key", "field", F.encode("v", "UTF-8").alias("value"))
        items = changed.where("type = 'list'").select("key", F.explode("items").alias("i")).select("key", "i.ord", F.encode("i.value", "UTF-8").alias("value"))
        self._write({"store": rest("store").unionByName(parents), "hash_fields": rest("hash_fields").unionByName(fields), "list_items": rest("list_items").unionByName(items)}, base)

    def clear(self) -> None:
        self._write({name: self.spark.createDataFrame([], schema) for name, schema in TABLES.items()}, self.version())

    def sweep(self, now: Column) -> None:
        """Remove expired keys and their children."""
        expired = self.table("store").where(F.col("expire_at") <= now).select("key")
        self.commit(self.spark.createDataFrame([], "key string, type string, str string, int long, fields map<string,string>, items array<struct<ord:long,value:string>>, expire_at timestamp, version long"), expired, now)

    def insert(self, rows: DataFrame, now: Column) -> None:
        """Put new keys in place; error 23505 if one is there already or twice in rows (STATE)."""
        known = self.table("store").select("key")
        twice = rows.groupBy("key").count().where("count > 1").select("key")
        clash = rows.select("key").join(known, "key", "left_semi").union(twice).first()
        if clash is not None:
            raise KvError("23505", "duplicate key value violates unique constraint", f'key "{clash.key}" already exists')
        self.commit(rows, None, now)

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows to a table without versions (snapshots)."""
        rows.write.mode("append").parquet(f"{self.folder}/{name}")

    def appended(self, name: str, schema: str) -> DataFrame:
        there = self._fs.exists(self._path(f"{self.folder}/{name}"))
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def put_text(self, name: str, text: str) -> None:
        """Replace a small document: a file of a higher number, whole once it is renamed."""
        names = self._numbered(name)
        number = f"{int(names[-1]) + 1 if names else 1:09d}"
        draft = self._path(f"{self.folder}/{name}/.{number}-{uuid.uuid4().hex[:8]}")
        out = self._fs.create(draft)
        out.write(text.encode())
        out.close()
        if not self._fs.rename(draft, self._path(f"{self.folder}/{name}/{number}")):
            raise KvError("40001", "could not serialize access due to concurrent update", f"{name} {number} is another session's")
        for old in names[:-1]:
            self._fs.delete(self._path(f"{self.folder}/{name}/{old}"), False)

    def text(self, name: str) -> str | None:
        names = self._numbered(name)
        return self._read(f"{name}/{names[-1]}") if names else None

    def _numbered(self, name: str) -> list[str]:
        place = self._path(f"{self.folder}/{name}")
        return sorted(n for s in self._fs.listStatus(place) if not (n := s.getPath().getName()).startswith(".")) if self._fs.exists(place) else []

    def _read(self, name: str) -> str:
        file = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        finally:
            file.close()

    def _write(self, tables: dict[str, DataFrame], base: str | None) -> None:
        """Write and publish the version after base; error 40001 if another one was published since."""
        name = f"v{int((base or 'v0').split('-')[0][1:]) + 1:09d}"
        version = f"{name}-{uuid.uuid4().hex[:8]}"
        for table, df in tables.items():
            df.write.parquet(f"{self.folder}/{version}/{table}")
        draft, final = self._path(f"{self.folder}/manifests/.{version}"), self._path(f"{self.folder}/manifests/{name}")
        out = self._fs.create(draft)
        out.write(version.encode())
        out.close()
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self._conf).rename(draft, final, options)
        except Py4JJavaError as e:
            if self._fs.exists(final):
                raise KvError("40001", "could not serialize access due to concurrent update", f"version {name} is another session's") from e
            raise
