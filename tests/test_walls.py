import pytest
from pagelens import schemas
from pagelens.operators.facts import page_counts, readable, wall_report, with_walls

STUB = (
    '<html><head><meta http-equiv="refresh" content="0;url=/.well-known/sgcaptcha/?r=%2F">'
    "</head></html>"
)


CASES = [
    (STUB, 202, {}, "SiteGround"),
    ("<html><body></body></html>", 200, {}, ""),
    ("", 200, {}, ""),
    ("<script>location='/cdn-cgi/challenge-platform/x'</script>", 200, {}, "Cloudflare"),
    ("<html></html>", 200, {"cf-mitigated": "challenge"}, "Cloudflare"),
    (STUB, 200, {"x-sucuri-block": "1"}, "Sucuri"),
    (STUB, 403, {}, None),
    (STUB, 302, {}, None),
    ("<p>Bienvenidos: just a moment</p>" * 3, 200, {}, None),
    ('<a href="/inicio"></a>', 200, {}, None),
    ('<a href="#x"></a><a href="mailto:a@b.cl"></a><a href=" "></a>', 200, {}, ""),
    ("<!--" + "x" * 2100 + "-->", 200, {}, None),
    ("<!--" + "x" * 2041 + "-->", 200, {}, ""),
    ("<!--" + "ñ" * 2041 + "-->", 200, {}, ""),
    ("<p hidden>texto</p>", 200, {}, None),
]


def test_wall(spark):
    rows = [(f"https://a.cl/{i}", s, h, html) for i, (html, s, h, _) in enumerate(CASES)]
    judged = with_walls(spark.createDataFrame(rows, schemas.RESPONSES)).collect()
    got = {r.url: r.wall_vendor for r in judged}
    for (url, status, headers, html), case in zip(rows, CASES):
        assert got[url] == case[3], (html[:60], status, headers)


def test_pages_without_status_count_as_answered(page):
    assert readable(page("<html></html>")).count() == 0
    assert readable(page("<p>hola</p>")).count() == 1


@pytest.fixture
def report(spark):
    def run(vendors, read):
        rows = [(v,) for v in vendors] + [(None,)] * read
        judged = spark.createDataFrame(rows, "wall_vendor STRING")
        assert page_counts(judged).first() == (read, len(vendors))
        return wall_report(judged).first().report

    return run


def test_nothing_blocked_says_nothing(report):
    assert report([], 3) == ""


def test_one_page_is_singular_and_unnamed(report):
    assert report([""], 2).startswith("1 pagina no se pudo leer. ")


def test_vendors_are_sorted_and_distinct(report):
    said = report(["Sucuri", "Cloudflare", "", "Sucuri"], 1)
    assert said.startswith("4 paginas no se pudo leer (Cloudflare, Sucuri). ")


def test_nothing_read_is_another_claim(report):
    said = report(["SiteGround"], 0)
    assert said.startswith("Ninguna pagina se pudo leer (SiteGround): ")
    assert said.endswith("que el sitio no tenga correos.")
