import pytest
from pyspark.sql import functions as F

from pagelens.functions import text
from pagelens.operators import contacts as C
from pagelens.plans import scan
from test_markup import HIDING


def found(df):
    return sorted((r.email, r.hidden) for r in df.collect())


def by_page(pages, htmls):
    """Sorted (address, hidden) per page, all pages in one job."""
    table = pages(*[(f"https://p.cl/{i}", h) for i, h in enumerate(htmls)])
    out = [[] for _ in htmls]
    for row in C.extract_contacts(table).collect():
        out[int(row.source.rsplit("/", 1)[1])].append((row.email, row.hidden))
    return [sorted(rows) for rows in out]


ROUTES = [
    ('<a href="mailto:Ana.Soto@Minera.cl">x</a>', ["ana.soto@minera.cl"]),
    ("<p>info [at] empresa.cl</p>", ["info@empresa.cl"]),
    ("<p>info (at) empresa.cl</p>", ["info@empresa.cl"]),
    ("<p>info at empresa.cl</p>", ["info@empresa.cl"]),
    ("<p>info [AT]\n empresa.cl</p>", ["info@empresa.cl"]),
    ("<p>support@company.com</p>", []),
    ("<p>visit us at nunoa.cl</p>", ["us@nunoa.cl"]),
    ("<p>a@b.cl.evil.com</p>", ["a@b.cl"]),
    ("<p>a@b.clx a@b.cl_ a@b.clé</p>", []),
    ("<p>a@b.cl, c@d.cl; a@b.cl</p>", ["a@b.cl", "c@d.cl"]),
    ('<a href="mailto:a@b.cl,c@d.cl">x</a>', ["a@b.cl,c@d.cl"]),
    ('<a href="mailto:a@b.cl.com">x</a>', ["a@b.cl.com"]),
    ('<a href="mailto:a%40b.cl">x</a>', []),
    ('<a href="mailto: a@b.cl ?subject=hola">x</a>', ["a@b.cl"]),
    ("<p>info</p><p>at</p><p>empresa.cl</p>", ["info@empresa.cl"]),
    ("<p>a&#64;b.cl c@d&#46;cl e@f&period;cl</p>", ["a@b.cl", "c@d.cl", "e@f.cl"]),
    ("<p>x@y.&#99;l</p>", ["x@y.cl"]),
    ("<p>x@y.&#x43;l</p>", ["x@y.cl"]),
    ("<p>first.last+tag_1%a-b@sub.dom-1.cl</p>", ["first.last+tag_1%a-b@sub.dom-1.cl"]),
    ("<p>uno@a.cl.dos@b.cl</p>", [".dos@b.cl", "uno@a.cl"]),
]


def test_routes(pages):
    got = by_page(pages, [html for html, _ in ROUTES])
    for (html, emails), rows in zip(ROUTES, got):
        assert [e for e, _ in rows] == sorted(emails), html


def test_hidden_only_addresses_are_marked(pages):
    htmls = [f"<html><body>{h}</body></html>" for h in HIDING]
    for html, rows in zip(htmls, by_page(pages, htmls)):
        assert rows == [("t@a.cl", True)], html


def test_visible_twin_wins(page):
    html = '<div style="display:none">a@b.cl t@x.cl</div><p>a@b.cl</p>'
    assert found(C.extract_contacts(page(html))) == [("a@b.cl", False), ("t@x.cl", True)]


def payload(address, key=0xA5):
    return f"{key:02x}" + "".join(f"{b ^ key:02x}" for b in address.encode())


PAYLOAD_ADDRESSES = [
    ("ventas@tienda.cl", ["ventas@tienda.cl"]),
    ("ventas@tienda.cl?subject=Hola", ["ventas@tienda.cl"]),
    ("Ventas@Tienda.CL", ["ventas@tienda.cl"]),
    ("ventas@tienda.com", []),
    ("nada", []),
    ("ñandú@tienda.cl", []),
]


def test_payload_forms(pages):
    for form in (
        '<span class="__cf_email__" data-cfemail="{}">[x]</span>',
        '<a href="/cdn-cgi/l/email-protection#{}">x</a>',
    ):
        got = by_page(pages, [form.format(payload(a)) for a, _ in PAYLOAD_ADDRESSES])
        for (address, expected), rows in zip(PAYLOAD_ADDRESSES, got):
            assert [e for e, _ in rows] == expected, address


PAYLOADS = [
    (payload("a@b.cl"), ["a@b.cl"]),
    (payload("a@b.cl") + "f", ["a@b.cl"]),
    (payload("a@b.cl").upper(), ["a@b.cl"]),
    ("a5", []),
    ("a5c", []),
    ("", []),
    ("zz" + payload("a@b.cl")[2:], []),
    (payload("a@b.cl") + "zz", []),
    (payload("a@b.cl")[:-2] + "ff00", []),
    ("00ff40", []),
    (payload("é@b.cl", 0), ["é@b.cl"]),
]


def test_decoding(spark):
    rows = spark.createDataFrame([([code],) for code, _ in PAYLOADS], "p ARRAY<STRING>")
    got = [r[0] for r in rows.select(text.decode_payloads(F.col("p"))).collect()]
    assert got == [clear for _, clear in PAYLOADS]


CODED = [
    '<a href="/cdn-cgi/l/email-protection&#35;{}">x</a>',
    '<a href="/cdn-cgi/l/email-protection&num;{}">x</a>',
    '<a href="/cdn-cgi/l/e&#x6D;ail-protection#{}">x</a>',
    '<a href="/cdn-cgi/l/EMAIL&hyphen;protection#{}">x</a>',
    "<SPAN DATA-CFEMAIL={}>x</SPAN>",
]


def test_no_coded_form_is_dropped_before_the_parse(pages):
    htmls = [form.format(payload("a@b.cl")) for form in CODED]
    htmls += ["<p>a@b&#46;cl</p>", "<p>a@b&#0046cl</p>", "<p>a@b&#X2E;cl</p>", "<p>a@b.&#067;L</p>",
              "<p>a@b&period;cl</p>", "<p>a@b.C&#108;</p>"]
    table = pages(*[(f"https://p.cl/{i}", h) for i, h in enumerate(htmls)])
    unfiltered = C.contact_arrays(table).filter("size(visible) > 0").select("url")
    kept = C.extract_contacts(table).select(F.col("source").alias("url"))
    rows = lambda df: sorted(r.url for r in df.distinct().collect())
    assert rows(kept) == rows(unfiltered)
    assert len(rows(kept)) >= 9


def test_hidden_payload_is_hidden(page):
    html = f'<p hidden><span data-cfemail="{payload("a@b.cl")}"></span></p>'
    assert found(C.extract_contacts(page(html))) == [("a@b.cl", True)]


def test_first_page_wins_with_its_flags(pages):
    table = pages(
    ("https://a.cl/1", "<p hidden>a@b.cl</p>"),
    ("https://a.cl/2", "<p>a@b.cl c@d.cl</p>"),
    ("https://a.cl/3", "<p>c@d.cl</p>"),
    )
    firsts = C.first_seen(C.extract_contacts(table, keep=["crawl_seq"]))
    rows = sorted((r.email, r.source, r.hidden) for r in firsts.collect())
    assert rows == [
    ("a@b.cl", "https://a.cl/1", True),
    ("c@d.cl", "https://a.cl/2", False),
    ]


def test_scraped_address_precedes_an_equal_guess(pages):
    table = pages(("https://a.cl/1", "<p>Ana Soto</p><p>ana.soto@a.cl</p>"))
    rows = scan.discoveries(table, "a.cl", "{first}.{last}").collect()
    assert [(r.email, r.generated) for r in rows] == [("ana.soto@a.cl", False)]


def test_guesses_are_marked_and_keep_their_page(pages):
    table = pages(
    ("https://a.cl/chile/1", "<p>Ana Soto, comuna</p>"),
    ("https://a.cl/2", "<p>Ana Soto</p><p>x@a.cl</p>"),
    )
    rows = {r.email: r for r in scan.discoveries(table, "@A.cl", "{f}{last}").collect()}
    assert rows["asoto@a.cl"].generated and rows["asoto@a.cl"].source.endswith("/chile/1")
    assert rows["asoto@a.cl"].evidence == ["lexicon", "path-cl"]
    assert not rows["x@a.cl"].generated and rows["x@a.cl"].evidence == []


def test_foreign_target_gets_no_guesses(pages):
    table = pages(("https://a.com/", "<p>Ana Soto</p>"))
    assert scan.discoveries(table, "a.com", "{first}").count() == 0


def test_target_is_a_plain_suffix(pages):
    table = pages(("https://a.cl/", "<p>x@notnunoa.cl y@nunoa.cl z@otra.cl</p>"))
    rows = scan.discoveries(table, "nunoa.cl").collect()
    assert sorted(r.email for r in rows) == ["x@notnunoa.cl", "y@nunoa.cl"]


def test_payload_yield_counts_only_what_others_missed(pages, spark):
    code, other = payload("a@b.cl"), payload("z@b.cl")
    html = (
        f'<span data-cfemail="{code}"></span><!-- data-cfemail="{other}" '
        f'data-cfemail="{payload("q@x.com")}" -->'
    )
    row = C.payload_yield(pages(("https://b.cl/", html))).first()
    assert (row.payloads, row.decoded_cl, row.new_addresses, row.sample) == (3, 2, 1, "z@b.cl")


def test_addresses_inside_one_huge_run_cost_little(page):
    html = "<p>" + "a" * 400_000 + " " + "b" * 400_000 + "@</p><p>x@y.cl</p>"
    assert [e for e, _ in found(C.extract_contacts(page(html)))] == ["x@y.cl"]


@pytest.mark.parametrize("tld, expected", [("com", "a@b.com"), ("co.uk", "c@d.co.uk")])
def test_tld_is_a_parameter(page, tld, expected):
    html = "<p>a@b.com c@d.co.uk e@f.cl</p>"
    assert [e for e, _ in found(C.extract_contacts(page(html), tld))] == [expected]


def test_addresses_inside_texts_are_found_spelled_out(spark):
    """The query finds what the given texts hold, not only a planted ending."""
    import duckdb

    from pagelens.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    plain = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.com\b"
    sql = f"SELECT doc_id, lower(unnest(regexp_extract_all(text, '{plain}'))) FROM '{sf}/documents.parquet'"
    held = set(duckdb.sql(sql).fetchall())
    found = {(r.doc_id, r.email) for r in QUERIES["sca_9_spelled_out_in_place"](spark, sf).collect()}
    assert held and held <= found
