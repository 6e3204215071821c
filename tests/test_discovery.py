import pytest
from pyspark.sql import functions as F

from pagelens import schemas
from pagelens.functions import fixed_values as V, scoring, text, urls
from pagelens.operators import discovery as D, links as L
from pagelens.plans import scan
from pagelens.sources import readers


def test_certificate_names_in_first_seen_order(spark):
    records = spark.createDataFrame(
        [(0, "nunoa.cl\nwww.nunoa.cl\n*.nunoa.cl"), (1, "MAIL.NUNOA.CL\r\nwww.nunoa.cl\nx.org\nxnunoa.cl")],
        "seq INT, name_value STRING",
    )
    names = readers.packed_names(records, ["seq"])
    hosts = D.hosts_under(names, "nunoa.cl", ["seq", "pos"]).orderBy("seq", "pos")
    assert [r.host for r in hosts.collect()] == ["nunoa.cl", "www.nunoa.cl", "mail.nunoa.cl", "xnunoa.cl"]


def fallback(spark, found, asked):
    out = D.source_fallback(
        spark.createDataFrame(found, "domain STRING, source_order INT, host STRING"),
        spark.createDataFrame(asked, "domain STRING, source_order INT, answered BOOLEAN"),
    )
    rows = {}
    for r in out.collect():
        rows.setdefault(r.domain, (r.answered, set()))[1].update([r.host] if r.host else [])
    return rows


def test_sources_fall_back_in_order(spark):
    found = [("a.cl", 0, "h1"), ("a.cl", 1, "h2"), ("b.cl", 1, "h3"), ("d.cl", 0, "stale")]
    asked = [("a.cl", 0, True), ("a.cl", 1, True), ("b.cl", 0, True), ("b.cl", 1, True),
             ("c.cl", 0, True), ("c.cl", 1, False), ("d.cl", 0, False), ("d.cl", 1, False)]
    assert fallback(spark, found, asked) == {
        "a.cl": (True, {"h1"}), "b.cl": (True, {"h3"}), "c.cl": (True, set()), "d.cl": (False, set())
    }


ENTITIES = [
    ("nunoa.cl", "municipality"), ("minsal.cl", "government"), ("usach.cl", "university"),
    ("bcn.cl", "government"), ("bhp.cl", "company"), (" Munistgo.CL ", "municipality"),
    ("huachipatofc.cl", "university"), ("gore.gob.cl", "municipality"), ("udp.cl", "university"),
]


def test_entities(spark):
    table = spark.createDataFrame([(d,) for d, _ in ENTITIES], "domain STRING")
    listed = spark.createDataFrame([("nunoa.cl",)], "domain STRING")
    got = dict(D.with_entity(table, listed).select("domain", "entity").collect())
    assert got == dict(ENTITIES)
    assert dict(D.with_entity(table).select("domain", "entity").collect())["nunoa.cl"] == "municipality"


def test_every_municipality_is_known_without_a_table(spark):
    """Also those outside the regional target list; a user's table overrides."""
    assert len(set(V.MUNICIPALITIES)) == 344
    names = [*V.MUNICIPALITIES, " Angol.CL ", "achm.cl", None]
    table = spark.createDataFrame([(d,) for d in names], "domain STRING")
    rows = D.with_entity(table).select("domain", "entity").collect()
    other = {r.domain for r in rows if r.entity != "municipality"}
    assert len(rows) == len(names) and other == {"achm.cl", None}
    mine = spark.createDataFrame([("achm.cl",)], "domain STRING")
    got = dict(D.with_entity(table, mine).select("domain", "entity").collect())
    assert got["achm.cl"] == "municipality" and got["angol.cl"] == "company"


SCORES = [
    ("https://a.cl/transparencia/funcionarios", "municipality", 10),
    ("https://a.cl/Contacto", "municipality", 10),
    ("https://a.cl/programas", "municipality", 3),
    ("https://a.cl/programas", "company", 0),
    ("https://a.cl/noticias/2026", "municipality", 0),
    ("https://contacto.cl/x", "company", 10),
    ("https://a.cl/rector", "university", 8),
]


def test_scores(spark):
    table = spark.createDataFrame(SCORES, "url STRING, kind STRING, score INT")
    for r in table.withColumn("got", scoring.link_score(F.col("url"), F.col("kind"))).collect():
        assert r.got == r.score, r.url


def test_links_are_ranked_and_internal(page):
    table = page(
        '<a href="/transparencia/funcionarios">1</a><a href="/contacto">2</a><a href="/programas">3</a>'
        '<a href="/noticias/2026">4</a><a href="/contacto">5</a>'
        '<a href="https://example.com/contacto?ref=nunoa.cl">6</a><a href="mailto:contacto@nunoa.cl">7</a>'
    )
    ranked = L.rank_links(L.internal_edges(table, "nunoa.cl", "municipality")).collect()
    assert [(r.dst.rsplit("/", 1)[1], r.score) for r in ranked] == [
        ("funcionarios", 10), ("contacto", 10), ("programas", 3)
    ]


URLS = [
    ("https://www.nunoa.cl/a", True, True), ("http://X.CL:8080/", True, True), ("https://cl/", False, True),
    ("https://a.com/?x=.cl", False, True), ("mailto:a@b.cl", False, False), ("//b.cl/x", True, False),
    ("", False, False), ("https://u:p@b.cl/", False, True), ("ftp://b.cl", True, False),
]


def test_url_predicates(spark):
    table = spark.createDataFrame(URLS, "url STRING, tld BOOLEAN, http BOOLEAN")
    for r in table.withColumn("t", urls.in_tld(F.col("url"))).withColumn("h", urls.is_http(F.col("url"))).collect():
        assert (r.t, r.h) == (r.tld, r.http), r.url


def test_unknown_scope_is_refused():
    with pytest.raises(ValueError):
        urls.in_scope(None, None, "phase2")


def test_live_hosts(spark):
    probes = spark.createDataFrame(
        [("a.cl", True, 200), ("b.cl", True, 404), ("c.cl", True, 500), ("d.cl", False, 200), ("e.cl", True, None)],
        schemas.HOST_PROBES,
    )
    got = D.live_hosts(probes.select("host"), probes).orderBy("host").collect()
    assert [r.url for r in got] == ["https://a.cl", "https://b.cl"]


def test_cascade_strips_slash_and_keeps_the_first(spark):
    make = lambda rows: spark.createDataFrame(rows, "domain STRING, url STRING, rank INT")
    stages = [make([("a.cl", "https://a.cl/", 0), ("a.cl", "", 1)]),
              make([("a.cl", "https://a.cl", 0), ("a.cl", "https://a.cl/contacto/", 1)])]
    rows = D.seed_cascade(stages).orderBy("stage", "rank").collect()
    assert [(r.url, r.stage) for r in rows] == [("https://a.cl", 0), ("https://a.cl/contacto", 1)]
    assert D.seed_cascade(stages, 1).count() == 1


def test_slug_and_first_resolving_candidate(spark):
    targets = spark.createDataFrame(
        [("Padre Hurtado", None), ("Ñuñoa", "nunoa.cl"), ("Nadie", None)], "comuna STRING, domain STRING"
    )
    live = spark.createDataFrame([("mpadrehurtado.cl",), ("munipadrehurtado.cl",)], "host STRING")
    got = dict(D.resolve_targets(targets, live).collect())
    assert got == {"Padre Hurtado": "munipadrehurtado.cl", "Ñuñoa": "nunoa.cl"}
    slug = spark.createDataFrame([("Ñuñoa – San José 2_ü",)], "n STRING").select(text.slug(F.col("n")))
    assert slug.first()[0] == "nunoasanjose2ü"


def test_seeds_of_a_domain(spark, pages):
    domains = spark.createDataFrame([("nunoa.cl",)], "domain STRING")
    names = spark.createDataFrame(
        [("nunoa.cl", 0, 0, 0, "nunoa.cl"), ("nunoa.cl", 0, 0, 1, "mail.nunoa.cl"), ("nunoa.cl", 1, 0, 0, "solo2.nunoa.cl")],
        "domain STRING, source_order INT, seq INT, pos INT, name STRING",
    )
    asked = spark.createDataFrame([("nunoa.cl", 0, True)], "domain STRING, source_order INT, answered BOOLEAN")
    probes = spark.createDataFrame(
        [("nunoa.cl", True, 200), ("mail.nunoa.cl", True, 503), ("www.nunoa.cl", True, 200)], schemas.HOST_PROBES
    )
    home = pages(("https://nunoa.cl", '<a href="/contacto/">c</a><a href="/programas">p</a><a href="/x">x</a>'))
    listed = spark.createDataFrame([("nunoa.cl",)], "domain STRING")
    found = spark.createDataFrame([("nunoa.cl", "https://nunoa.cl/", 0), ("nunoa.cl", "https://w.cl/", 1)],
                                  "domain STRING, url STRING, rank INT")
    seeds = scan.discover_seeds(domains, names, asked, probes, home, listed, found)
    assert [r.url for r in seeds.orderBy("stage", "rank").collect()] == [
        "https://www.nunoa.cl", "https://nunoa.cl", "https://nunoa.cl/contacto",
        "https://nunoa.cl/programas", "https://w.cl",
    ]


def test_no_side_that_grows_is_broadcast(spark, pages, capsys):
    """Small rows here, whose size the planner knows: it would broadcast them all."""
    domains = spark.createDataFrame([("a.cl",), ("b.cl",)], "domain STRING")
    names = spark.createDataFrame(
        [("a.cl", 0, 0, 0, "mail.a.cl")],
        "domain STRING, source_order INT, seq BIGINT, pos INT, name STRING",
    )
    asked = domains.select("domain", F.lit(0).alias("source_order"), F.lit(True).alias("answered"))
    probes = spark.createDataFrame(
        [(h, True, 200) for h in ("mail.a.cl", "a.cl", "www.b.cl")],
        "host STRING, resolved BOOLEAN, http_status INT",
    )
    live = scan.live_seed_hosts(domains, names, asked, probes)
    live.explain()
    assert "Broadcast" not in capsys.readouterr().out
    assert sorted((r.host, r["rank"]) for r in live.collect()) == [("a.cl", 1), ("mail.a.cl", 2), ("www.b.cl", 1)]
    homes = pages(("https://a.cl", '<a href="/contacto">c</a>'), ("https://c.cl", ""))
    linked = scan.scored_seed_links(live, homes, D.with_entity(domains), 5)
    linked.explain()
    # Only the counted list of home pages.
    assert capsys.readouterr().out.count("BroadcastExchange") <= 1
    assert [r.url for r in linked.collect()] == ["https://a.cl/contacto"]
