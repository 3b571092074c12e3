"""Quality rules and robust multivariate outliers.

Each document has a vector of transformed statistics. Per (lang, source) the minimum covariance determinant estimate of
centre and scatter is found by concentration steps: from the half of the rows nearest to the medians, estimate mean and
covariance, take the half that is nearest in Mahalanobis distance, and repeat. Sums and sketches per group are aggregated
partially, so a group of any size costs no task more than its share. Small groups use the estimate of their language.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import SPACES, save

WHITE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
VECTOR = ["v_chars", "v_symbols", "v_lines", "v_repeats"]
#: Least variance of each statistic, added to the diagonal: most texts have no symbols or repeats at all.
FLOOR = [0.004, 0.02, 0.01, 0.01]
#: The median of chi-square with len(VECTOR) degrees of freedom, to which the median distance is scaled.
CHI2_MEDIAN = 3.357
#: Groups whose estimates are sent to all tasks, at most; more meet their rows in a shuffle.
BROADCAST = 100_000


def _repeat_words() -> Column:
    """The size of the union of the 3-word windows that start at the sorted positions `hits`."""
    step = lambda acc, j: acc + F.least(F.lit(3), F.get(F.col("hits"), j) - F.get(F.col("hits"), j - 1))
    return F.when(F.size("hits") == 0, 0).when(F.size("hits") == 1, 3).otherwise(F.lit(3) + F.aggregate(F.sequence(F.lit(1), F.size("hits") - 1), F.lit(0), step))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); a null text is an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text.alias("text"))
    step = step.select("doc_id", "lang", "source", "text", F.filter(F.split("text", WHITE, -1), lambda w: w != "").alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    step = step.select("doc_id", "lang", "source", "words", lines.alias("lines"), F.regexp_count("text", F.lit(SYMBOLS)).alias("n_symbols"))
    word = lambda i: F.get(F.col("words"), i)
    window = lambda i: F.struct(F.xxhash64(word(i), word(i + 1), word(i + 2)).alias("h1"), F.xxhash64(F.lit(1), word(i), word(i + 1), word(i + 2)).alias("h2"), i.alias("at"))
    none = F.array().cast("array<struct<h1:bigint,h2:bigint,at:int>>")
    # Sorted by 128 bits of hash, equal windows are neighbours.
    step = step.withColumn("windows", F.when(F.size("words") >= 4, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("words") - 3), window))).otherwise(none))
    at = lambda j: F.get(F.col("windows"), j)
    position = lambda j: at(j)["at"]
    same = lambda j, k: (at(j)["h1"] == at(k)["h1"]) & (at(j)["h2"] == at(k)["h2"]) & (word(position(j)) == word(position(k))) & (word(position(j) + 1) == word(position(k) + 1)) & (word(position(j) + 2) == word(position(k) + 2))
    repeated = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size("windows") - 1, F.lit(0))), lambda j: F.when(F.coalesce(same(j, j + 1), F.lit(False)) | F.coalesce((j > 0) & same(j, F.greatest(j - 1, F.lit(0))), F.lit(False)), position(j))), lambda p: p.isNotNull())
    step = step.withColumn("hits", F.sort_array(repeated))
    return step.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").cast("long").alias("n_lines"), _repeat_words().cast("long").alias("n_repeat_words"),
    )


def _vectors(stats: DataFrame) -> DataFrame:
    words = F.greatest("n_words", F.lit(1))
    return stats.withColumns(
        {
            "v_chars": F.log(F.greatest("word_chars", F.lit(1)) / words),
            "v_symbols": F.log1p(10 * F.col("n_symbols") / words),
            "v_lines": F.asinh(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
            "v_repeats": F.asinh(F.col("n_repeat_words") / words),
        }
    )


def _names(rows: DataFrame, least: int) -> DataFrame:
    """(lang, source, g1, g2), the last two naming the group; groups under `least` rows are pooled by language, and then all together."""
    by_source = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = by_source.where(F.col("n") < least).groupBy("lang").agg(F.sum("n").alias("n_lang"))
    named = by_source.join(small, "lang", "left").select("lang", "source", (F.col("n") >= least).alias("own"), (F.col("n_lang") >= least).alias("pooled"))
    return named.select("lang", "source", F.when(F.col("own") | F.col("pooled"), F.concat(F.lit("="), "lang")).otherwise(F.lit("*")).alias("g1"), F.when(F.col("own"), F.concat(F.lit("="), "source")).otherwise(F.lit("*")).alias("g2"))


def _estimate(rows: DataFrame) -> DataFrame:
    """Per group the mean and the Cholesky factor of the covariance, as columns m{i}, l{i}{j}."""
    k = range(len(VECTOR))
    pairs = [(i, j) for i in k for j in k if j <= i]
    out = rows.groupBy("g1", "g2").agg(*[F.avg(VECTOR[i]).alias(f"m{i}") for i in k], *[F.avg(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"c{i}{j}") for i, j in pairs])
    out = out.withColumns({f"c{i}{j}": F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") + F.lit(FLOOR[i] if i == j else 0.0) for i, j in pairs})
    for i, j in pairs:
        rest = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{n}") * F.col(f"l{j}{n}") for n in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.select("g1", "g2", *[f"m{i}" for i in k], *[f"l{i}{j}" for i, j in pairs])


def _distances(rows: DataFrame, estimate: DataFrame, few: Callable[[DataFrame], DataFrame], how: str = "inner", more: list[str] | None = None) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance by forward substitution."""
    out = rows.join(few(estimate), ["g1", "g2"], how)
    for i in range(len(VECTOR)):
        out = out.withColumn(f"y{i}", (F.col(VECTOR[i]) - F.col(f"m{i}") - sum((F.col(f"l{i}{n}") * F.col(f"y{n}") for n in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return out.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(len(VECTOR))), F.lit(0.0))).select(*rows.columns, "d2", *(more or []))


def _nearest(rows: DataFrame, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    cut = rows.groupBy("g1", "g2").agg(F.percentile_approx("d2", 0.5, 10000).alias("cut"))
    return rows.join(few(cut), ["g1", "g2"]).where(F.col("d2") <= F.col("cut")).drop("cut", "d2")


def judge_quality(docs: DataFrame, rounds: int = 3, cutoff: float = 60.0, least: int = 50) -> DataFrame:
    """statistics() of docs (doc_id, text, lang, source) with base_failed, d2 and kept.

    base_failed: under 50 words, or over half of them in repeated windows. Rows that passed are kept unless their squared
    distance from their group's centre, scaled so that the group's median is that of chi-square, exceeds cutoff. A null lang
    or source counts as an empty one; groups under `least` rows are pooled. An empty table gives an empty result.
    """
    stats = save(_vectors(statistics(docs)).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "quality")
    names = save(_names(stats.where(~F.col("base_failed")), least), "quality-groups")
    few = F.broadcast if names.count() <= BROADCAST else (lambda df: df)  # there are as many groups at most
    good = save(stats.where(~F.col("base_failed")).select("lang", "source", *VECTOR).join(few(names), ["lang", "source"]).select("g1", "g2", *VECTOR), "quality-vectors")
    medians = good.groupBy("g1", "g2").agg(*[F.percentile_approx(v, 0.5, 10000).alias(f"m{i}") for i, v in enumerate(VECTOR)])
    around = good.join(few(medians), ["g1", "g2"]).withColumn("d2", sum((F.pow(F.col(v) - F.col(f"m{i}"), 2) / FLOOR[i] for i, v in enumerate(VECTOR)), F.lit(0.0))).select(*good.columns, "d2")
    estimate = save(_estimate(_nearest(around, few)), "quality-estimate")
    for _ in range(rounds - 1):
        estimate = save(_estimate(_nearest(_distances(good, estimate, few), few)), "quality-estimate")
    scale = _distances(good, estimate, few).groupBy("g1", "g2").agg(F.percentile_approx("d2", 0.5, 10000).alias("median"))
    final = estimate.join(scale, ["g1", "g2"])
    rows = stats.join(few(names), ["lang", "source"], "left")
    scaled = F.col("d2") * F.least(F.lit(1.0), CHI2_MEDIAN / F.greatest("median", F.lit(1e-9)))
    out = _distances(rows, final, few, "left", ["median"]).withColumn("d2", F.when(~F.col("base_failed"), scaled))
    return out.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cutoff)).alias("kept"))
