"""Main text of HTML pages by a tree-structured graphical model.

Each node of a page's block tree is content or not. A node's own potential is linear in its features; an edge's potential
depends on the two states and on whether the child is an element or a run of text. Sum-product messages up from the leaves
and down from the root give exact marginals, for all pages of a batch at once, level by level. Training climbs the likelihood
of labelled pages, whose gradient is observed less expected counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import forget_tables, prepare
from keyloom.llm.html_pages import BOILERPLATE, CONTENT, Page, made_pages, parse

TAGS = "html article main section div p h1 h2 h3 h4 ul ol li table tr td blockquote pre figure nav header footer aside form button fieldset dl address".split()
#: Word stems in class, id and role that hint at each kind of boilerplate, and at content; fixed values.
STEMS = [re.compile("|".join(sorted({re.escape(w) if len(w) > 4 else rf"\b{re.escape(w)}(?:s|\b)" for w in names.split()}))) for names in BOILERPLATE.values()] + [re.compile("|".join(map(re.escape, CONTENT))), re.compile("hidden|screen-reader|sr-only")]
TRAINING_PAGES, STEPS, RATE, L2 = 400, 150, 0.15, 1e-3


def features(page: Page) -> np.ndarray:
    n = len(page.parent)
    chars, linked, runs = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n - 1, -1, -1):
        if page.text[i] is not None:
            chars[i], linked[i], runs[i] = len(page.text[i]), page.linked[i], 1
        if page.parent[i] >= 0:
            for v in (chars, linked, runs):
                v[page.parent[i]] += v[i]
    x = np.zeros((n, 2 * len(TAGS) + 2 * len(STEMS) + 16))
    columns = {t: k for k, t in enumerate(TAGS)}
    for i in range(n):
        leaf = page.text[i] is not None
        if page.tag[i] in columns:
            x[i, columns[page.tag[i]] + leaf * len(TAGS)] = 1
        if page.hint[i].strip():
            for k, stem in enumerate(STEMS):
                if stem.search(page.hint[i]):
                    x[i, 2 * len(TAGS) + k + leaf * len(STEMS)] = 1
    leaf = np.array([t is not None for t in page.text])
    density, size = linked / np.maximum(chars, 1), np.log1p(chars) / 5
    rest = [np.ones(n), density, size, density > 0.8, np.log1p(runs) / 3, chars < 20, chars > 200, np.array([(t or "").startswith("©") for t in page.text])]
    x[:, -16:-8] = np.stack(rest, 1) * leaf[:, None]
    x[:, -8:] = np.stack(rest, 1) * ~leaf[:, None]
    return x


class Forest:
    """The block trees of several pages as one set of arrays."""

    def __init__(self, pages: list[Page]):
        starts = np.cumsum([0, *(len(p.parent) for p in pages)])
        self.parent = np.concatenate([np.array(p.parent) + np.where(np.array(p.parent) >= 0, s, 0) for p, s in zip(pages, starts, strict=False)])
        depth = np.concatenate([p.depth for p in pages])
        self.leaf = np.concatenate([[t is not None for t in p.text] for p in pages])
        self.x = np.concatenate([features(p) for p in pages])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
        self.starts = starts


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


class Model:
    """weights of the features for the state content; edges[kind, parent's state, child's state], kind 1 for leaves."""

    def __init__(self, n: int):
        self.weights, self.edges = np.zeros(n), np.zeros((2, 2, 2))

    def marginals(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and the joint marginals of each node's parent and itself."""
        n = len(f.parent)
        own = np.stack([np.zeros(n), f.x @ self.weights], 1)
        up, out, message = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((n, 2))
        edge = self.edges[f.leaf.astype(int)]
        for nodes in f.levels[:0:-1]:
            message[nodes] = _logsum(edge[nodes] + (own[nodes] + up[nodes])[:, None, :], 2)
            np.add.at(up, f.parent[nodes], message[nodes])
        joint = np.zeros((n, 2, 2))
        for nodes in f.levels[1:]:
            p = f.parent[nodes]
            above = own[p] + up[p] + out[p] - message[nodes]
            out[nodes] = _logsum(edge[nodes] + above[:, :, None], 1)
            both = edge[nodes] + above[:, :, None] + (own[nodes] + up[nodes])[:, None, :]
            joint[nodes] = np.exp(both - _logsum(both.reshape(-1, 4), 1)[:, None, None])
        belief = own + up + out
        return np.exp(belief[:, 1] - _logsum(belief, 1)), joint


def train(sources: list[str]) -> Model:
    """Fit from labelled pages: leaves under data-content are content, and so are the elements above them."""
    pages = [parse(s) for s in sources]
    f = Forest(pages)
    label = np.concatenate([[m and t is not None for m, t in zip(p.marked, p.text, strict=True)] for p in pages])
    for nodes in f.levels[:0:-1]:
        np.logical_or.at(label, f.parent[nodes], label[nodes])
    y, model = label.astype(int), Model(f.x.shape[1])
    child = np.flatnonzero(f.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (f.leaf[child].astype(int), y[f.parent[child]], y[child]), 1)
    theta, scale = np.zeros(f.x.shape[1] + 8), len(pages)
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        p, joint = model.marginals(f)
        expected = np.stack([joint[~f.leaf].sum(0), joint[f.leaf].sum(0)])
        g = np.concatenate([f.x.T @ (y - p), (seen - expected).ravel()]) / scale - L2 * theta
        moment, square = 0.9 * moment + 0.1 * g, 0.99 * square + 0.01 * g * g
        theta = theta + RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        model.weights, model.edges = theta[:-8], theta[-8:].reshape(2, 2, 2)
    return model


@cache
def trained() -> Model:
    return train(made_pages(TRAINING_PAGES))


def main_texts(sources: list[str | None], model: Model) -> list[str]:
    """The runs of text whose marginal exceeds one half, in page order, a line each."""
    pages = [parse(s) for s in sources]
    if not pages:
        return []
    f = Forest(pages)
    content, _ = model.marginals(f)
    return ["\n".join(t for t, c in zip(p.text, content[s:], strict=False) if t is not None and c > 0.5) for p, s in zip(pages, f.starts, strict=False)]


def extract_text(pages: DataFrame) -> DataFrame:
    """Return (page_id, url, text, n_chars) for each row of pages (page_id, url, html).

    A null or empty html has an empty text, and so has a page without content. Null ids and urls stay null; repeated rows get
    equal results. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(trained())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts(batch.column("html").to_pylist(), model.value)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
    return out
