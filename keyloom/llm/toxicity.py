"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over words and word beginnings is trained in numpy from confirmed toxic examples and unlabelled texts.
With class prior q the risk is q R_p(+) + max(0, R_u(-) - q R_p(-)): unlabelled texts count as negatives, corrected by what
the positives among them contribute; when the corrected part falls below zero, its gradient is reversed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import documents, forget_tables, prepare

#: Bounds of the training sample: confirmed toxic texts, unlabelled texts, and characters of either kind. The rows with the
#: smallest hashes of doc_id are taken.
MOST_POSITIVE, MOST_UNLABELLED, MOST_CHARS = 3000, 6000, 20_000_000
#: Features kept, and in how many toxic texts one must be.
MOST_FEATURES, LEAST_TEXTS = 4000, 3
#: Standard deviations by which a feature must be more frequent in toxic texts than in unlabelled ones.
LEAST_LIFT = 2.0
BEGINNINGS = (4, 5, 6, 7)
WORD = re.compile(r"\w+")
#: A score from which a text counts as toxic.
THRESHOLD = 0.7
MOST_CACHED = 300_000


def held_out(column: str = "doc_id") -> Column:
    """Rows that no label is learnt from: crc32 of the doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def names(word: str) -> list[str]:
    """The features of a word: itself, and its beginnings."""
    return ["=" + word, *(word[:k] for k in BEGINNINGS if len(word) > k)]


class _Hits(dict):
    """word -> its features that the model knows, as column numbers."""

    def __init__(self, columns: dict[str, int]):
        self.columns = columns

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > MOST_CACHED:
            self.clear()
        self[word] = hits = tuple(self.columns[n] for n in names(word) if n in self.columns)
        return hits


@dataclass
class Model:
    columns: dict[str, int]
    weights: np.ndarray
    bias: float

    def hits(self) -> _Hits:
        return _Hits(self.columns)

    def score(self, text: str | None, hits: _Hits) -> float:
        x = Counter(f for found in map(hits.__getitem__, WORD.findall((text or "").lower())) if found for f in found)
        z = self.bias + sum(self.weights[f] * np.log1p(min(n, 8)) for f, n in x.items())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _counted(text: str) -> Iterator[tuple[str, int]]:
    """The features of a text and how often they come, but for those of several words in several parts."""
    for word, n in Counter(WORD.findall(text.lower())).items():
        for name in names(word):
            yield name, n


def _frequent(texts: list[str], least: int) -> set[int]:
    """The hashes of the features that are in `least` texts at least."""
    hashed = [np.unique(np.fromiter((xxhash.xxh3_64_intdigest(name) for name, _ in _counted(t)), np.uint64)) for t in texts]
    values, n = np.unique(np.concatenate(hashed), return_counts=True)
    return set(values[n >= least].tolist())


def _rows(texts: Iterable[str], number: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text the numbers of the features that have one, and their counts."""
    for text in texts:
        c: Counter = Counter()
        for name, n in _counted(text):
            if name in number:
                c[number[name]] += n
        yield np.fromiter(c.keys(), np.int32, len(c)), np.minimum(np.fromiter(c.values(), np.int64, len(c)), 8).astype(np.uint8)


def train(positive: list[str], unlabelled: Iterable[str], prior: float, steps: int = 400, rate: float = 0.05, l2: float = 2e-4) -> Model:
    """Fit the classifier; with no positive text or no prior, a model that scores everything near 0.

    A word is a feature, and its beginnings are. Kept are the MOST_FEATURES features, at most, that are in LEAST_TEXTS toxic
    texts at least and there more frequent than in unlabelled ones by LEAST_LIFT standard deviations or more; a count above 8
    is taken as 8. Texts of both kinds are held as arrays of numbers, unlabelled ones are read once.
    """
    if not positive or prior <= 0:
        return Model({}, np.zeros(0), -6.0)
    frequent, number = _frequent(positive, min(LEAST_TEXTS, len(positive))), {}
    for text in positive:
        for name, _ in _counted(text):
            if name not in number and xxhash.xxh3_64_intdigest(name) in frequent:
                number[name] = len(number)
    of_p, of_u = list(_rows(positive, number)), list(_rows(unlabelled, number))
    n_p, n_u = len(of_p), len(of_u)
    if not n_u:
        return Model({}, np.zeros(0), -6.0)
    in_p, in_u = (np.bincount(np.concatenate([np.zeros(0, np.int32), *(i for i, _ in rows)]), minlength=len(number)) for rows in (of_p, of_u))
    share = (in_p + in_u + 1) / (n_p + n_u + 2)
    lift = (in_p / n_p - in_u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    chosen = sorted((n for n, i in number.items() if lift[i] >= LEAST_LIFT), key=lambda n: (-lift[number[n]], n))
    columns = {n: i for i, n in enumerate(chosen[:MOST_FEATURES])}

    place = np.full(len(number), -1, np.int64)
    place[[number[n] for n in columns]] = np.arange(len(columns))

    def matrix(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        r = np.repeat(np.arange(len(rows), dtype=np.int32), [len(i) for i, _ in rows])
        c, k = place[np.concatenate([i for i, _ in rows])], np.concatenate([k for _, k in rows])
        known = c >= 0
        return r[known], c[known], np.log1p(k[known].astype(np.float64)), len(rows)

    p, u = matrix(of_p), matrix(of_u)
    del of_p, of_u, number, frequent
    w, moment, square = np.zeros(len(columns) + 1), np.zeros(len(columns) + 1), np.zeros(len(columns) + 1)
    w[-1] = np.log(prior / (1 - prior)) if prior < 1 else 6.0

    def margin(m: tuple) -> np.ndarray:
        return np.bincount(m[0], m[2] * w[m[1]], m[3]) + w[-1]

    def gradient(m: tuple, slope: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(m[1], m[2] * slope[m[0]], len(columns)), slope.sum()) / m[3]

    for step in range(1, steps + 1):
        zp, zu = np.clip(margin(p), -30, 30), np.clip(margin(u), -30, 30)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
        g_negative = gradient(u, su) - prior * gradient(p, sp)
        g = prior * gradient(p, sp - 1) + g_negative if negative >= 0 else -g_negative
        g = g + l2 * np.append(w[:-1], 0)
        moment, square = 0.9 * moment + 0.1 * g, 0.999 * square + 0.001 * g * g
        w = w - rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Model(columns, w[:-1], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train from the rows of docs (doc_id, text) that aren't held out and labels (doc_id, toxic)."""
    rows = documents(docs.where(F.col("doc_id").isNotNull())).where(~held_out("id"))
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
    toxic, n = marks.agg(F.sum("toxic"), F.count("*")).first()
    prior = (toxic or 0) / n if n else 0.0
    first = lambda ids, most: ids.orderBy(F.xxhash64("id"), "id").limit(most)
    positive = first(marks.where("toxic = 1").select("id").distinct(), MOST_POSITIVE)
    unlabelled = first(rows.select("id"), MOST_UNLABELLED)
    return Model({}, np.zeros(0), -6.0) if not toxic else train(list(_texts(rows, positive)), _texts(rows, unlabelled), prior)


def _texts(rows: DataFrame, ids: DataFrame) -> Iterator[str]:
    """The texts of these few thousand rows, up to MOST_CHARS characters of whole texts."""
    held = 0
    for r in rows.join(F.broadcast(ids.distinct()), "id").orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).toLocalIterator():
        if held and held + len(r.text) > MOST_CHARS:
            return
        held += len(r.text)
        yield r.text


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Return (doc_id, text, held_out, score, predicted) for each row of docs (doc_id, text), scoring whole texts.

    Only texts are inputs of a score. A null text is scored as an empty one; a null doc_id is never held out nor learnt from;
    labels that are null or neither 0 nor 1 are ignored. Without toxic labels all scores are near 0. Repeated rows get equal
    scores. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        hits = model.value.hits()
        for batch in batches:
            scores = [model.value.score(t, hits) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(scores, pa.float64())], names=["doc_id", "text", "score"])

    scored = documents(docs).select("doc_id", "text").mapInArrow(score, "doc_id long, text string, score double")
    return scored.select("doc_id", "text", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
