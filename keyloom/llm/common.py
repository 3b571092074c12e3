"""What the operators of this package share: the shared work folder, saved tables and column helpers."""

from __future__ import annotations

import gc
import sys
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.shipping import ship

#: ASCII white space as the contracts name it.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null doc_id where rows are sorted or joined: such rows sort last. Results have the doc_id itself.
LAST_ID = 2**63 - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/keyloom/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage and outlives executors."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, id, text): id is LAST_ID for null doc_ids, null texts are empty; other columns stay out, so their names can't clash."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST_ID)).alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() serves where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Before Python workers run: Arrow batches of few rows, since one row may be a very long text, and this package sent to them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    ship(spark)


def forget_tables() -> None:
    """In a Python worker that is used again: drop the tables that the tokenizers' tasks left, which other operators don't need."""
    if tokens := sys.modules.get("keyloom.llm.tokens"):
        tokens.encoder.cache_clear()


def discard(saved: DataFrame) -> None:
    """Delete a saved table that nothing reads any more."""
    path = saved.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(saved.saved_at)
    path.getFileSystem(saved.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
