"""Quality scores: features, descent, held-out accuracy, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from edge_data import EDGE_TEXTS, SF
from pagelens.llm import quality, queries

LABELS = "doc_id BIGINT, class INT, score DOUBLE, text STRING"


def test_runs_do_not_cross_words_and_do_not_depend_on_place():
    words = ["abc", "", "wörd", "x" * 5000, "\ud800a", "abc"]
    found, many = quality.units(words)
    ends = np.cumsum(many)
    split = np.split(found, ends[:-1])
    assert (split[0] == split[5]).all() and len(set(map(len, split))) > 3
    for word, mine in zip(words, split):
        alone, _ = quality.units([word])
        assert (alone == mine).all()
        marked = len(word) + 2
        runs = sum(max(marked - n + 1, 0) for n in range(3, 6) if n < marked)
        assert len(mine) == 1 + runs
    # Equal runs of different words are one feature.
    a, b = quality.units(["testing"])[0], quality.units(["resting"])[0]
    assert len(set(a.tolist()) & set(b.tolist())) >= 8
    assert found.min() > quality.REACH and found.max() < quality.BUCKETS


def test_shares_are_those_of_plain_counting():
    text = "one two two one\ntwo  three"
    used, shares = quality.text_units(text)
    plain = {quality.END: 1, 1: 1, 2: 1, 3: 2}
    for word in text.split():
        for u in quality.units([word])[0].tolist():
            plain[u] = plain.get(u, 0) + 1
    total = sum(plain.values())
    assert dict(zip(used.tolist(), (shares * total).round().astype(int).tolist())) == plain
    assert quality.text_units(None)[0].tolist() == [quality.END] == quality.text_units(" \n")[0].tolist()


def test_scores_equal_averaged_vectors(monkeypatch):
    scores = np.random.default_rng(0).normal(size=(quality.BUCKETS, 3))
    texts = ["a b", None, "word word other", "long " * 4000, "x" * 9000, ""]
    expected = []
    for text in texts:
        used, shares = quality.text_units(text)
        logit = shares @ scores[used]
        p = np.exp(logit - logit.max())
        expected.append(p / p.sum())
    monkeypatch.setattr(quality, "SLICE_CHARS", 100)
    monkeypatch.setattr(quality, "SLICE_WORDS", 2)
    assert np.abs(quality.probabilities(texts, scores) - expected).max() < 1e-12


def test_gradient_step_equals_plain_derivatives():
    texts = [(1, *quality.text_units("good words here")), (0, *quality.text_units("bad bad |"))]
    random = np.random.default_rng(quality.SEED)
    vectors = random.uniform(-1 / 4, 1 / 4, (quality.BUCKETS, 4))
    layer = np.zeros((2, 4))
    # Two epochs of one batch: the first moves the layer only, the second both.
    for step in (0.5, 0.25):
        dv, dl = np.zeros_like(vectors), np.zeros_like(layer)
        for c, used, shares in texts:
            mean = shares @ vectors[used]
            p = np.exp(layer @ mean)
            p = p / p.sum() - np.eye(2)[c]
            dl += np.outer(p, mean)
            dv[used] += np.outer(shares, p @ layer)
        vectors, layer = vectors - step * dv, layer - step * dl
    got = quality.train(texts, dims=4, epochs=2, rate=0.5, batch=2)
    assert np.abs(got - vectors @ layer.T).max() < 1e-12


def test_held_out_texts_are_told_apart(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.QUERIES["op12_subword_quality"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 100
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_odd_rows(spark, edges, empty):
    labels = spark.createDataFrame(
        [(2, 0, 0.1, "t"), (6, 1, 0.1, "t"), (11, 1, 0.1, "t"), (11, 0, 0.1, "t"), (5, 7, 0.1, "t"), (99, 1, 0.1, "t"), (None, 1, 0.1, "t"), (7, None, 0.1, "t")],
        LABELS,
    )
    texts = quality.training_texts(edges, labels)
    # Text 11 has two votes for each class in its rows with another text too.
    assert sorted(c for c, _, _ in texts) == [0, 1, 1, 1]
    scored = quality.score(edges, quality.train(texts), into="found")
    rows = scored.collect()
    assert len(rows) == edges.count() and set(edges.columns) < set(scored.columns)
    assert {r.score for r in rows} == {0.5}
    same = [r.found for r in rows if r.text == EDGE_TEXTS[-1]]
    assert len(same) == 3 and len(set(same)) == 1
    blank = {r.found for r in rows if not (r.text or "").split()}
    assert len(blank) == 1
    assert quality.training_texts(edges, labels.limit(0)) == [] == quality.training_texts(empty, labels)
    unknown = quality.score(edges, quality.train([]), into="found")
    assert {r.found for r in unknown.collect()} == {0.5}
    assert quality.score(empty, quality.train([]), into="found").collect() == []


def test_copies_of_one_text_do_not_fill_the_sample(spark):
    rows = [(i, "the same text" if i < 900 else f"text number {i}", "en", "s", 1, 0.0, "x", 1, 2, 3) for i in range(1000)]
    from edge_data import SCHEMA

    docs = spark.createDataFrame(rows, SCHEMA)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("class"))
    texts = quality.training_texts(docs, labels, rows=50)
    assert len(texts) == 50
    few = quality.training_texts(docs, labels, most_units=500)
    assert 0 < sum(len(u) for _, u, _ in few) <= 500


@pytest.mark.parametrize("classes", [3])
def test_more_than_two_classes(spark, classes):
    words = ["alpha beta", "gamma delta", "omega sigma"]
    texts = [(c, *quality.text_units(words[c] + f" {i}")) for i in range(40) for c in range(classes)]
    p = quality.probabilities(words, quality.train(texts, classes=classes, epochs=10))
    assert p.argmax(axis=1).tolist() == [0, 1, 2]
