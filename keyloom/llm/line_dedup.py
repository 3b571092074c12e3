"""Line deduplication against levelled, sorted runs of line hashes.

Documents are taken in batches of ascending doc_id. A batch's line keys are merge-anti-joined with the runs of all earlier
batches; keys that are new form a run of their own, sorted by hash, with the smallest doc_id that holds them. When a level
has `fanout` runs they are compacted to one run of the next level. A key's owner never changes once it is in a run, so a
line goes if and only if the owner of its key is another, smaller document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import SPACES, ascii_lower, documents, save

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


class Runs:
    """Sorted runs by level; each is a saved table of (h1, h2, owner)."""

    def __init__(self, fanout: int):
        self.fanout, self.levels = fanout, []

    def table(self) -> DataFrame | None:
        runs = [r for level in self.levels for r in level]
        return reduce(DataFrame.unionByName, runs) if runs else None

    def add(self, fresh: DataFrame) -> None:
        run, at = self._sorted(fresh, 0), 0
        while True:
            if at == len(self.levels):
                self.levels.append([])
            self.levels[at].append(run)
            if len(self.levels[at]) < self.fanout:
                return
            run = self._sorted(reduce(DataFrame.unionByName, self.levels[at]), at + 1)
            self.levels[at], at = [], at + 1

    @staticmethod
    def _sorted(rows: DataFrame, level: int) -> DataFrame:
        return save(rows.sortWithinPartitions(*KEY), f"lines-run-{level}")


def dedup_lines(docs: DataFrame, batches: int = 4, fanout: int = 2, min_chars: int = 10) -> DataFrame:
    """Return (doc_id, text, n_lines, n_dropped, kept) for each row of docs (doc_id, text).

    Lines are split at \\n only; a null or empty text is one empty line. Keys shorter than min_chars code points never count.
    Rows with the same doc_id are one document; rows with a null doc_id are together one document that comes last.
    A text that loses all lines becomes empty. An empty table gives an empty result.
    """
    # A row's id sorts behind all others if it is null.
    rows = documents(docs).select("doc_id", F.struct(F.col("doc_id").isNull().alias("none"), F.col("id").alias("at")).alias("id"), "text", F.xxhash64("text").alias("th"))
    lines = rows.select("id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("id", "th", "pos", line_key(F.col("line")).alias("key"))
    lines = lines.where(F.char_length("key") >= min_chars).select("id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    cuts = sorted(set(rows.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or [])) if batches > 1 else []
    batch = reduce(lambda a, b: a + b, [(F.col("id.none") | (F.col("id.at") > c)).cast("int") for c in cuts], F.lit(0))
    lines = save(lines.withColumn("batch", batch), "lines", by=["batch"])
    runs = Runs(fanout)
    for b in range(len(cuts) + 1):
        firsts = lines.where(F.col("batch") == b).groupBy(*KEY).agg(F.min("id").alias("owner"))
        known = runs.table()
        runs.add(firsts if known is None else firsts.join(known.select(*KEY), KEY, "left_anti"))
    drops = lines.join(runs.table(), KEY).where(F.col("owner") < F.col("id")).groupBy("id", "th").agg(F.sort_array(F.collect_set("pos")).alias("drop"))
    return rows.join(drops, ["id", "th"], "left").select("doc_id", "text", F.split("text", "\n", -1).alias("lines"), F.coalesce("drop", F.array().cast("array<int>")).alias("drop")).select(
        "doc_id", "text", F.size("lines").cast("long").alias("n_lines"), F.size("drop").cast("long").alias("n_dropped"), F.when(F.size("drop") == 0, F.col("text")).otherwise(F.array_join(_without("lines", "drop"), "\n")).alias("kept")
    )


def _without(lines: str, drop: str) -> Column:
    """The lines whose position isn't in the sorted array drop: the slices between dropped positions, in linear time."""
    at = F.col(drop)

    def between(k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.get(at, k - 1) + 1)
        return F.slice(F.col(lines), start + 1, F.coalesce(F.get(at, k), F.size(lines)) - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(at)), between))
