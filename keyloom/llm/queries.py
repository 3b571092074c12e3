"""The queries of this package's operators, opN_<name>, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import read
from keyloom.llm.decontamination import leaks
from keyloom.llm.html_extraction import extract_text
from keyloom.llm.jaccard_join import jaccard_join
from keyloom.llm.line_dedup import dedup_lines
from keyloom.llm.packing import pack
from keyloom.llm.pii import KINDS, counted, find_personal_data, listed
from keyloom.llm.quality import judge_quality
from keyloom.llm.suffix_dedup import remove_repeats
from keyloom.llm.token_files import token_table
from keyloom.llm.toxicity import score_toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(read(spark, sf_dir, "documents"))
    return out.select("doc_id", *[counted("base", k) for k in KINDS], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("th")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_table(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_quality(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_line_dedup, op3_personal_data, op4_html_extraction, op5_benchmark_decontamination, op6_suffix_dedup, op7_best_fit_packing, op8_token_files, op9_ngram_jaccard_join, op10_quality_rules, pipeline)}
#: The others have trained models, tokenizers, byte offsets or near copies.
ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": r"""
        with docs as (
            select row_number() over () as r, doc_id, coalesce(doc_id, 9223372036854775807) as id, string_split(coalesce(text, ''), chr(10)) as lines from documents
        ), split as (
            select r, doc_id, id, unnest(lines) as line, unnest(range(len(lines))) as pos from docs
        ), keyed as (
            select *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from split
        ), owners as (
            select key, min(id) as owner from keyed where length(key) >= 10 group by key
        ), judged as (
            select r, doc_id, pos, line, coalesce(owner < id, false) as gone from keyed left join owners using (key)
        )
        select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
        from judged group by r
    """,
}
