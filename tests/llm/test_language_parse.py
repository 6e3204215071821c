"""Cross parsing against plain greedy search, large alphabets, the sample."""

import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.llm import langid


def _plain(parser, text, sample):
    """Phrases by searching the sample for ever longer pieces."""
    symbols, _ = parser.symbols([text.lower()])
    known, _ = parser.symbols([sample.lower()])
    text, sample = ("".join(map(chr, (s + 100).tolist())) for s in (symbols, known))
    at = phrases = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at, phrases = max(end - 1, at + 1), phrases + 1
    return phrases


def _samples():
    rng = random.Random(1)
    letters = {"x": "abcd  ", "y": "abce ", "z": "한국어각 "}
    return {k: "".join(rng.choice(a) for _ in range(2000)) for k, a in letters.items()}


@pytest.mark.parametrize("cells", [1 << 25, 10])
@pytest.mark.parametrize("lane", [1, 7, 2048])
def test_phrases_are_those_of_one_greedy_parse(monkeypatch, lane, cells):
    """In lanes of any length, with a dense table or hashed transitions."""
    monkeypatch.setattr(langid, "LANE", lane)
    monkeypatch.setattr(langid, "DENSE_CELLS", cells)
    samples, rng = _samples(), random.Random(2)
    parser = langid.CrossParser(samples)
    assert (parser.dense is None) == (cells == 10)
    texts = ["".join(rng.choice("abcd e한국") for _ in range(rng.randrange(300))) for _ in range(25)]
    texts += ["", "ab" * 400, samples["x"][:900], "q" * 50]
    got = parser.phrases(*parser.symbols(texts))
    want = [[_plain(parser, t, samples[k]) for k in parser.languages] for t in texts]
    assert got.tolist() == want


@pytest.mark.parametrize("cells", [1 << 25, 10])
def test_a_text_of_a_hundred_thousand_symbols(monkeypatch, cells):
    monkeypatch.setattr(langid, "DENSE_CELLS", cells)
    rng = random.Random(3)
    samples = {"x": "".join(rng.choices("abcdefg ", k=3000)), "y": "aab " * 700}
    parser = langid.CrossParser(samples)
    text = "".join(rng.choices("abcdefgh ", k=100_000)) + "aab " * 3000
    got = parser.phrases(*parser.symbols([text]))
    monkeypatch.setattr(langid, "LANE", 1 << 20)
    assert got.tolist() == parser.phrases(*parser.symbols([text])).tolist()
    assert got[0].tolist() == [_plain(parser, text, samples[k]) for k in "xy"]


def test_ten_large_alphabets_stay_small_and_right():
    rng = random.Random(4)
    letters = [chr(0x4E00 + 1000 * k + i) for k in range(10) for i in range(3000)]
    samples = {
        f"l{k}": "".join(rng.choices(letters[3000 * k : 3000 * k + 3000], k=30_000)) for k in range(10)
    }
    # Letters that no sample had, and alphabets beyond 16 bits of symbols.
    parser = langid.CrossParser(samples)
    assert parser.dense is None and len(pickle.dumps(parser)) < 100_000_000
    texts = [samples[f"l{k}"][5000:5400] for k in range(10)] + ["日本"[:0] + "\U00020000" * 9]
    names, scores = parser.predict(texts)
    assert names[:10] == [f"l{k}" for k in range(10)] and min(scores[:10]) > 0.5


def test_hashed_moves_find_what_is_there():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 50, 5000))
    moves = langid.HashedMoves(keys, np.arange(len(keys), dtype=np.int32))
    assert moves.find(keys).tolist() == list(range(len(keys)))
    assert (moves.find(keys + (1 << 51)) == -1).all() and (moves.keys >= 0).mean() <= 0.5
    assert langid.HashedMoves(keys[:0], keys[:0]).find(keys[:3]).tolist() == [-1] * 3


def test_a_shared_banner_does_not_fill_the_sample(spark):
    rng = random.Random(5)
    banner = "banner words that all rows of one source begin with " * 60
    rows = [("en", banner + "".join(rng.choices("klmnop ", k=20_000))) for _ in range(30)]
    rows += [("de", "".join(rng.choices("abcd ", k=45)) + str(i)) for i in range(900)]
    sample = langid.training_samples(spark.createDataFrame(rows, "lang STRING, text STRING").repartition(4))
    assert {k: len(v) for k, v in sample.items()} == {"en": langid.SAMPLE_CHARS, "de": langid.SAMPLE_CHARS}
    assert sample["en"].count("banner") < 0.4 * langid.SAMPLE_CHARS / 52


def test_rows_without_an_id_are_not_held_out(spark):
    rows = spark.createDataFrame([(None,), (1,)], "doc_id BIGINT")
    assert None not in [r[0] for r in rows.select(langid.held_out()).collect()]
    assert rows.filter(langid.held_out() & F.col("doc_id").isNull()).count() == 0
