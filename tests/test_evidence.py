from pyspark.sql import functions as F

from pagelens.functions import text
from pagelens.operators import candidates as K, contacts as C, evidence as E
from pagelens.functions import fixed_values as V

SIGNALS = [
    ("<html lang='es-CL'><p>x", "https://a.com/", ["lang-es-cl"]),
    ("<html lang=' ES_cl '><p>x", "https://a.com/", ["lang-es-cl"]),
    ("<html lang='es'><p>x", "https://a.com/", []),
    ("<html lang='es-CL-x'><p>x", "https://a.com/", []),
    ("<p>RUT 76.086.428-5</p>", "https://a.com/", ["lexicon", "rut"]),
    ("<p>76086428-5</p>", "https://a.com/", ["rut"]),
    ("<p>76.086.428-1</p>", "https://a.com/", []),
    ("<p>6.265.837-1 nada</p>", "https://a.com/", ["rut"]),
    ("<p>22 818 5000</p>", "https://a.com/", ["phone-cl"]),
    ("<p>+56 2 2818 5000</p>", "https://a.com/", ["phone-cl"]),
    ("<p>+56 9 8765 4321</p>", "https://a.com/", ["phone-cl"]),
    ("<p>(55) 245-1000</p>", "https://a.com/", ["phone-cl"]),
    ("<p>+1 604 699 4000</p>", "https://a.com/", []),
    ("<p>+44 22 818 5000</p>", "https://a.com/", []),
    ("<p>Spokane, WA 99201-0301</p>", "https://a.com/", []),
    ("<p>pedido 1228185000123</p>", "https://a.com/", []),
    ("<p>Casilla 12</p>", "https://a.com/", ["lexicon"]),
    ("<p>Región Metropolitana</p>", "https://a.com/", ["lexicon"]),
    ("<p>frutas y telefono</p>", "https://a.com/", []),
    ("<p>Chile, Santiago</p>", "https://a.com/", []),
    ("<p>x</p>", "https://a.com/falabella-cl/x", ["path-cl"]),
    ("<p>x</p>", "https://a.com/es/CHILE", ["path-cl"]),
    ("<p>x</p>", "https://a.com/cl?x", ["path-cl"]),
    ("<p>x</p>", "https://a.com/clima/chileno", []),
    ("<p>x</p>", "https://a.cl", []),
    ("<script>casilla</script><p hidden>giro</p>", "https://a.com/", ["lexicon"]),
]


def test_signals(pages):
    table = pages(*[(url + ("" if "?" in url else f"#{i}"), html) for i, (html, url, _) in enumerate(SIGNALS)])
    got = {r.url: r.evidence for r in E.page_evidence(table).collect()}
    for (i, (html, url, expected)) in enumerate(SIGNALS):
        key = url + ("" if "?" in url else f"#{i}")
        assert got[key] == expected, (html, url)


def test_accents_cover_the_latin_blocks(spark):
    import unicodedata

    chars = [chr(c) for c in [*range(0x20, 0x250), *range(0x1E00, 0x1F00)]]
    rows = spark.createDataFrame([(c,) for c in chars], "c STRING")
    got = dict(rows.select("c", text.deaccent(F.col("c"))).collect())
    for c in chars:
        plain = "".join(
            p for p in unicodedata.normalize("NFD", c) if unicodedata.category(p) != "Mn"
        )
        assert got[c] == plain


def test_absent_page_is_not_empty_evidence(pages, spark):
    contacts = spark.createDataFrame(
        [("a@b.cl", "https://a.cl/1"), ("c@d.cl", "https://a.cl/none")],
        "email STRING, source STRING",
    )
    rows = E.attach_evidence(contacts, pages(("https://a.cl/1", "<p>x</p>"))).collect()
    assert {r.email: r.evidence for r in rows} == {"a@b.cl": [], "c@d.cl": None}


def test_attached_evidence_equals_evidence_from_the_same_parse(pages):
    table = pages(
        ("https://a.cl/chile", "<p>a@b.cl comuna</p>"),
        ("https://a.cl/2", "<p>c@d.cl</p>"),
        ("https://a.cl/3", "<p>casilla</p>"),
    )
    one = C.extract_contacts(table, evidence=True)
    two = E.attach_evidence(C.extract_contacts(table), table)
    as_set = lambda df: {(r.email, r.source, tuple(r.evidence)) for r in df.collect()}
    assert as_set(one) == as_set(two)


NAMES = [
    ("Ana Soto", [("Ana", "Soto")]),
    ("Soto Ana", [("Ana", "Soto")]),
    ("Pérez Núñez", [("Pérez", "Núñez")]),
    ("Ana Soto Ana Soto", [("Ana", "Soto")]),
    ("Juan Pablo Soto", [("Pablo", "Juan")]),
    ("Ana  \n Soto", [("Ana", "Soto")]),
    ("ANA SOTO Jo Li xAna Soto", []),
    ("Ana-Soto Ñandú Ibáñez", [("Soto", "Ñandú")]),
    ("Anaß Soto", []),
]


def test_names(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NAMES)], "i INT, t STRING")
    got = dict(rows.select("i", text.name_pairs(F.col("t"))).collect())
    for i, (line, pairs) in enumerate(NAMES):
        assert [tuple(p) for p in got[i]] == pairs, line


def test_presets(spark):
    pairs = spark.createDataFrame([("Andrés", "Núñez-Peña")], "first STRING, last STRING")
    made = {r.preset: r.email for r in K.preset_candidates(pairs, "a.cl").collect()}
    assert made == {
        "first.last": "andres.nunezpena@a.cl",
        "flast": "anunezpena@a.cl",
        "f.last": "a.nunezpena@a.cl",
        "first_last": "andres_nunezpena@a.cl",
        "last.first": "nunezpena.andres@a.cl",
        "lastf": "nunezpenaa@a.cl",
        "first": "andres@a.cl",
    }
    assert len(made) == len(V.PATTERN_PRESETS)


def test_candidates_are_distinct_per_page_and_marked(page):
    table = page("<p>Ana Soto</p><p>Ana Sota</p><p>Eva Rojas</p>")
    rows = K.candidate_addresses(table, "{first}", "@A.CL").orderBy("pos").collect()
    assert [(r.email, r.generated) for r in rows] == [("ana@a.cl", True), ("eva@a.cl", True)]


def test_generation_gate():
    assert K.generation_wanted("{first}", "a.cl")
    assert not K.generation_wanted("{first}", "a.com")
    assert not K.generation_wanted("", "a.cl")
    assert not K.generation_wanted("{first}", None)
