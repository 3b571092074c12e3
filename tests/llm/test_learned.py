"""Operators with trained models, by accuracy on what they weren't trained on; the pipeline."""

import random
import zlib

import numpy as np
import pytest

from keyloom.llm.html_extraction import Forest, Model, extract_text, main_texts, train, trained
from keyloom.llm.html_pages import made_pages, parse
from keyloom.llm.toxicity import held_out, score_toxicity
from keyloom.llm.toxicity import train as train_toxicity

TOXIC = "grub muck slime wretch oaf".split()


def corpus(n=900, seed=3):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghiklmnoprstu", k=r.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.15
        text = r.choices(words, k=r.randint(20, 120)) + (r.choices(TOXIC, k=r.randint(3, 6)) if toxic else [])
        r.shuffle(text)
        rows.append((i, " ".join(text)))
        if r.random() < 0.6:
            labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_is_learnt_from_positive_and_unlabelled(spark):
    rows, labels = corpus()
    truth = dict(labels)
    docs = spark.createDataFrame([*rows, (None, None), (None, "x")], "doc_id long, text string")
    marks = spark.createDataFrame([*((i, t) for i, t in labels), (None, 1), (5, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in score_toxicity(docs, marks).collect() if r.doc_id is not None}
    assert len(out) == len(rows) and all(out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in out)
    held = [i for i in truth if out[i].held_out]
    assert sum(out[i].predicted == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())
    # Labels of held-out rows change nothing.
    flipped = spark.createDataFrame([(i, 1 - t if out[i].held_out else t) for i, t in labels], "doc_id long, toxic int")
    assert {r.doc_id: r.score for r in score_toxicity(docs, flipped).collect() if r.doc_id is not None} == {i: r.score for i, r in out.items()}


def test_toxicity_without_examples(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in score_toxicity(docs, none).collect()] == [0, 0]
    assert score_toxicity(docs.limit(0), none).count() == 0
    model = train_toxicity([], ["x"], 0.1)
    assert model.score("x", model.hits()) < 0.1
    assert docs.select(held_out()).count() == 2


def test_messages_give_exact_marginals():
    r = np.random.default_rng(4)
    pages = [parse("<div><p>a</p><div>b<p>c</p></div></div><p>d</p>")]
    f = Forest(pages)
    model = Model(f.x.shape[1])
    model.weights, model.edges = r.normal(size=f.x.shape[1]), r.normal(size=(2, 2, 2))
    n, own = len(f.parent), f.x @ model.weights
    total, on = 0.0, np.zeros(n)
    for bits in range(2**n):
        s = [(bits >> k) & 1 for k in range(n)]
        p = np.exp(sum(own[k] * s[k] for k in range(n)) + sum(model.edges[int(f.leaf[k]), s[f.parent[k]], s[k]] for k in range(n) if f.parent[k] >= 0))
        total += p
        on += p * np.array(s)
    assert np.allclose(model.marginals(f)[0], on / total)


def truth(source):
    page = parse(source)
    return "\n".join(t for t, m in zip(page.text, page.marked) if m and t is not None)


def test_main_text_of_unseen_layouts():
    pages = made_pages(150, seed=99)
    got, expected = ([set(t.split("\n")) for t in x] for x in (main_texts(pages, trained()), map(truth, pages)))
    hits = sum(len(a & b) for a, b in zip(got, expected))
    assert hits / sum(map(len, got)) > 0.95 and hits / sum(map(len, expected)) > 0.95
    assert isinstance(train(made_pages(5)), Model)


def test_blocks():
    page = parse("<html><body><!-- x --><p>a &amp;amp; b<b>c</b>\n d<p>e<br>f<ul><li>g<li>h</ul><script>var t='</p>'</script><table><tr><td>i<td>j</table>k &lt;l")
    assert [t for t in page.text if t] == ["a &amp; bc d", "e f", "g", "h", "i", "j", "k <l"]
    for odd in (None, "", "<", "<p", "</p></div>", "<!-- open", "<script>never closed", "<div " + "<b>" * 3000 + "x", "plain & text"):
        parse(odd)


def test_blocks_after_elements_without_end_tag():
    def texts(source):
        return [t for t in parse(source).text if t]

    assert texts('<nav>a<svg class="i" /><svg/></nav><p>b<svg><svg x="1"/>c</svg>d</p>') == ["a", "b d"]
    assert texts("<datalist><option value=a><option value=b>x <b>y</b></datalist><p>c</p>") == ["c"]
    assert texts("<p>a<option>b</option>c</p><div><span><option>d</span>e</div><p>f") == ["a c", "e", "f"]
    assert texts("<svg><p>a</p><object><object>b</object><p>c</p><select><p>d") == ["a", "c", "d"]
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mspace/><mn>2</mn><annotation>tex</annotation></math> holds</p><math/><p>e") == ["so x=2 holds", "e"]
    assert texts("<svg href=a/>b</svg><p>c") == ["c"]
    assert texts("<p>a" + "<svg>" * 20000 + "b") == ["a b"]


def test_extract_text(spark):
    body = "".join(f"<p>This is sentence {k} of the article, which has quite some words in it.</p>" for k in range(5))
    page = f'<html><head><title>t</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></nav><div class="cookie-notice">We use cookies. <button>OK</button></div><article><h1>Title here</h1>{body}</article><section class="comments"><div class="comment"><b>bob</b><p>I disagree with this</p></div></section><aside class="sidebar"><a href="/r">Related</a></aside><footer>&copy; me</footer></body></html>'
    pages = spark.createDataFrame([(1, "u", page, 0), (2, None, None, 0), (None, "v", "", 0), (1, "u", page, 0)], "page_id long, url string, html string, text int")
    out = extract_text(pages).collect()
    expected = "Title here\n" + "\n".join(f"This is sentence {k} of the article, which has quite some words in it." for k in range(5))
    assert [r.text for r in out] == [expected, "", "", expected] and all(r.n_chars == len(r.text) for r in out) and out[2].page_id is None
    assert extract_text(pages.limit(0)).count() == 0


def test_pipeline_rejects_rows_not_ids(spark, monkeypatch):
    import corpus_pipeline as pipeline

    r = random.Random(6)
    a, b, c, d, e = (" ".join(f"{x}{r.randint(1, 10**6)}" for _ in range(60)) for x in "abcde")
    bad = " ".join(TOXIC * 6)
    data = [(1, a), (None, a + " end"), (None, b), (None, b + " end"), (2, c), (2, c), (2, d), (None, d), (None, None), (None, None), (3, ""), (None, e), (4, bad), (4, e + " end"), (None, bad), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    def kept(stage):
        return sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in stage(spark, docs, "-").collect())

    def less(*gone):
        out = [((-1 if i is None else i), t or "") for i, t in data]
        for x in gone:
            out.remove(x)
        return sorted(out)

    tables = {"benchmark": spark.createDataFrame([(1, b)], "item_id long, text string"), "labels": None}
    monkeypatch.setattr(pipeline, "read", lambda s, f, t: tables[t])
    monkeypatch.setattr(pipeline, "score_toxicity", lambda docs, labels: docs.select("doc_id", "text", (docs.text == bad).cast("int").alias("predicted")))
    assert kept(pipeline.decontamination) == less((-1, b), (-1, b + " end"))
    assert kept(pipeline.toxicity) == less((4, bad), (-1, bad))
    near = less((-1, a + " end"), (2, c), (-1, d), (-1, e), (-1, bad))
    got = kept(pipeline.near_copies)
    assert sum(t.startswith("b") for _, t in got) == 1 and [x for x in got if x[1][:1] != "b"] == [x for x in near if x[1][:1] != "b"]


def test_pipeline_stages(spark, docs, texts):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_copies", "decontamination", "packing"] and pipeline.ORACLE_SQL is None
    tables = {"labels": spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, texts[5])], "item_id long, text string")}
    real, pipeline.read = pipeline.read, lambda s, d, t: tables[t]
    try:
        out = docs
        for name, stage in pipeline.STAGES[:-1]:
            before, out = out, stage(spark, out, "-")
            assert out.columns == pipeline.COLUMNS, name
            assert out.count() <= before.count()
        kept = {r.doc_id for r in out.collect()}
        assert 5 not in kept and 40 in kept
        packed = pipeline.packing(spark, out, "-")
        assert packed.select("doc_id").distinct().count() == out.select("doc_id").distinct().count()
        assert pipeline.near_copies(spark, docs.where("doc_id in (40, 41, 42)"), "-").count() == 1
        assert all(stage(spark, docs.limit(0), "-").count() == 0 for _, stage in pipeline.STAGES)
    finally:
        pipeline.read = real
