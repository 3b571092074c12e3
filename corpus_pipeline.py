"""A corpus from `documents` to packed sequences: toxicity, line dedup, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on, with the columns of documents; the last returns the
packed pieces. A stage's result is written and read back before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import LAST_ID, SPACES, read, save
from keyloom.llm.decontamination import leaks
from keyloom.llm.jaccard_join import jaccard_join
from keyloom.llm.line_dedup import dedup_lines
from keyloom.llm.packing import pack
from keyloom.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


KEY = ["id", "th"]


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the key of their rows: id, null ids as LAST_ID, and text hash; only repeated rows share one."""
    return docs.select(*COLUMNS, _id(), _text_hash())


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id and text hash are in gone (doc_id, th)."""
    return _keyed(docs).join(gone.select(_id(), "th").distinct(), KEY, "left_anti").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    scored = score_toxicity(docs, read(spark, sf_dir, "labels"))
    return _without(docs, scored.where("predicted = 1").select("doc_id", _text_hash()))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; a document of which nothing is left stays with an empty text."""
    deduped = dedup_lines(docs).select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "n_dropped", "kept")
    deduped = deduped.where("n_dropped > 0").dropDuplicates(["id", "th"])
    own = docs.select(*COLUMNS).withColumns({"id": F.coalesce("doc_id", F.lit(LAST_ID)), "th": F.xxhash64(F.coalesce("text", F.lit("")))})
    out = own.join(deduped, ["id", "th"], "left")
    kept = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text"))
    return out.select("doc_id", kept.alias("text"), "lang", "source", F.when(F.col("n_dropped") > 0, F.char_length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays, that with the smallest doc_id; texts without words link with nothing."""
    joined = save(jaccard_join(docs).where("n_shingles > 0").select(_id(), "th", "component"), "near-copies")
    first = joined.groupBy("component").agg(F.min(F.struct(*KEY)).alias("first")).select("first.*")
    repeated = joined.groupBy(*KEY).count().where("count > 1").select(*KEY)
    first = save(first.join(repeated.withColumn("repeated", F.lit(True)), KEY, "left").select(*KEY, F.coalesce("repeated", F.lit(False)).alias("repeated")), "first-rows")
    own = _keyed(docs)
    wordless = own.where(F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES)) == "")
    once = own.join(first.where("not repeated"), KEY, "left_semi")
    # Of equal rows one stays.
    one = own.join(first.where("repeated"), KEY, "left_semi").groupBy(*KEY).agg(F.min(F.struct("lang", "source", "n_chars", "text", "doc_id")).alias("row"))
    return wordless.select(*COLUMNS).union(once.select(*COLUMNS)).union(one.select(*[f"row.{c}" for c in COLUMNS]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, leaks(docs, read(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, packed."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_copies", near_copies), ("decontamination", decontamination), ("packing", packing)]

#: The stages have a classifier and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; the result's rows are the pieces of the packed corpus."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
