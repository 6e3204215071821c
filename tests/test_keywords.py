"""Keyword automata and canonical decomposition against plain Python."""

import random
import sys
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from pagelens.functions import fixed_values as V, keywords, scoring, text

WORDS = {"contacto": 10, "contact": 7, "tact": 3, "acto": 12, "nosotros": 5, "ñandú": 4, "a": -2, "otros/": 6, "\U0001f600x": 9}


def _plain(body, table):
    return max([s for w, s in table.items() if w in body] + [0])


def test_overlapping_words_and_suffixes():
    bodies = ["", "/contact", "/contacto", "xtact", "nosotros/", "ñandú y \U0001f600x", "\ud800", "conta" * 50 + "acto"]
    (automaton,) = keywords.automata([WORDS])
    assert automaton.scores(bodies)[:, 0].tolist() == [_plain(b, WORDS) for b in bodies]


@pytest.mark.parametrize("cells", [1 << 24, 60])
def test_random_tables(monkeypatch, cells):
    """One automaton, or several of a few words each."""
    monkeypatch.setattr(keywords, "MOST_CELLS", cells)
    rng = random.Random(cells)
    word = lambda n: "".join(rng.choice("abc") for _ in range(rng.randrange(1, n)))
    tables = [{word(6): rng.randrange(1, 20) for _ in range(15)} for _ in range(3)]
    bodies = [word(40) for _ in range(300)]
    parts = keywords.automata(tables)
    assert (len(parts) > 1) == (cells == 60)
    for i, table in enumerate(tables):
        got = [max(a.scores([b])[0, i] for a in parts) for b in bodies]
        assert got == [_plain(b, table) for b in bodies]


def test_link_scores_are_those_of_the_substring_tests(spark):
    rng = random.Random(3)
    known = [*V.BASE_SCORES, *[w for t in V.ENTITY_SCORES.values() for w in t], "zz", "/", "x"]
    kinds = [*V.ENTITY_SCORES, "company", "other"]
    rows = [("https://s.cl/" + "".join(rng.choices(known, k=rng.randrange(4))).upper(), rng.choice(kinds)) for _ in range(800)]
    rows += [(None, "university"), ("", None), ("https://s.cl/contacto", None)]
    df = spark.createDataFrame(rows, "url STRING, kind STRING")
    url, kind = F.col("url"), F.col("kind")
    same = F.coalesce(scoring.link_score(url, kind), F.lit(0)) == scoring.link_score(url, kind, V.BASE_SCORES)
    assert df.filter(~F.coalesce(same, F.lit(False))).count() == 0
    own = df.select(scoring.link_score(url, "one", {"s.cl": 2}, {"one": {"https": 5}, "two": {"h": 9}}).alias("s"))
    assert {r.s for r in own.collect()} == {0, 5}


def test_entities_by_a_table_of_the_users_own(spark):
    df = spark.createDataFrame([("munivalpo.cl",), ("uach.cl",), ("a.cl",), (None,), ("unimuni.cl",)], "domain STRING")
    fixed, own, none = (
        [r[0] for r in df.select(scoring.entity(F.col("domain"), None, words)).collect()]
        for words in (None, V.ENTITY_KEYWORDS, {})
    )
    assert own == fixed and set(none) == {"company"}
    other = [r[0] for r in df.select(scoring.entity(F.col("domain"), None, {"x": ["uni"], "y": ["muni", "a.cl"]})).collect()]
    assert other == ["x" if d and "uni" in d else "y" if d and "a.cl" in d else "company" for (d,) in df.collect()] or other == ["x", "company", "y", "company", "x"]


def test_time_does_not_grow_with_the_words():
    rng = random.Random(1)
    bodies = ["https://www.sitio.cl/" + "".join(rng.choices("abcdefghij/", k=60)) for _ in range(20_000)]
    spent = []
    for many in (100, 10_000):
        table = {"".join(rng.choices("abcdefghij", k=rng.randrange(5, 12))): rng.randrange(1, 9) for _ in range(many)}
        (automaton,) = keywords.automata([table])
        automaton.scores(bodies[:100])
        started = time.perf_counter()
        automaton.scores(bodies)
        spent.append(time.perf_counter() - started)
    assert spent[1] < 6 * spent[0]


def test_decomposition_of_every_code_point(spark):
    codes = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    rows = [(i, "".join(map(chr, codes[i : i + 1]))) for i in range(len(codes))]
    got = spark.createDataFrame(rows, "i INT, t STRING").repartition(8).select("i", "t", text.deaccent(F.col("t")).alias("d"))
    bad = [(hex(ord(r.t)), r.d) for r in got.collect() if r.d != _bare(r.t)]
    assert bad == []


def _bare(s):
    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")


def test_decomposition_of_texts(spark):
    texts = ["", None, "plain ASCII 123", "Ñuñoa é ǘ", "한국어 각 갂", "\U0001f600é\U0001134b한", "ொ가", "ø ł ß"]
    rows = list(enumerate(texts))
    got = spark.createDataFrame(rows, "i INT, t STRING").select("i", text.deaccent(F.col("t")).alias("d"))
    assert {r.i: r.d for r in got.collect()} == {i: None if t is None else _bare(t) for i, t in rows}
