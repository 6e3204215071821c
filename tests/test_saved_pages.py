"""Saved result and index pages as files, and what is made of them."""

import pytest
from pyspark.sql import functions as F

from pagelens.operators import discovery as D
from pagelens.sources import readers


def _save(root, name, content):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_status_body_and_names(spark, tmp_path):
    two = "HTTP/1.1 302 Found\r\nLocation: x\r\n\r\nHTTP/2 404\r\nA: b\r\n\r\nnone"
    _save(tmp_path, "pgp.one/a.cl.html", "<pre>x@a.cl</pre>")
    _save(tmp_path, "pgp.one/b.cl.html", two)
    _save(tmp_path, "pgp.one/c.cl.html", " \n")
    _save(tmp_path, "pgp.one/d.cl", "HTTP/1.0 200 OK\n\nbody\r\n\r\nHTTP/1.1 500 quoted")
    _save(tmp_path, "server=pgp two/domain=ñ+1.cl.txt", "á".encode("latin-1"))
    _save(tmp_path, "pgp.one/e.cl.html", b"\xef\xbb\xbfHTTP/1.1 503 No\r\nA: b")
    got = {(r.server, r.domain): (r.status, r.body) for r in readers.read_keyserver_pages(spark, str(tmp_path)).collect()}
    assert got == {
        ("pgp.one", "a.cl"): (200, "<pre>x@a.cl</pre>"),
        ("pgp.one", "b.cl"): (404, "none"),
        ("pgp.one", "c.cl"): (None, " \n"),
        ("pgp.one", "d"): (200, "body\r\n\r\nHTTP/1.1 500 quoted"),
        ("pgp two", "ñ+1.cl"): (200, "á"),
        ("pgp.one", "e.cl"): (503, ""),
    }


def test_keyserver_rows_from_files(spark, tmp_path):
    _save(tmp_path, "s1/nunoa.cl.html", "Ana@NUNOA.cl b@mail.nunoa.cl c@other.cl ana@nunoa.cl")
    _save(tmp_path, "s2/nunoa.cl.html", "HTTP/1.1 404 Not Found\r\n\r\nana@nunoa.cl")
    _save(tmp_path, "s3/nunoa.cl.html", "\n")
    rows = readers.keyserver_rows(readers.read_keyserver_pages(spark, str(tmp_path)))
    got = {r.server: (r.outcome, r["count"], r.addresses) for r in rows.collect()}
    assert got == {
        "s1": ("ok", 2, "ana@nunoa.cl b@mail.nunoa.cl"), "s2": ("none", 0, ""), "s3": ("error", 0, ""),
    }


def test_saved_searches_keep_the_order_of_their_pages(spark, tmp_path):
    for k in (2, 10, 1):
        _save(tmp_path, f"nunoa.cl/{k}.html", f'<a href="https://www.nunoa.cl/p{k}/">x</a>')
    _save(tmp_path, "nunoa.cl/3.html", "HTTP/1.1 429 No\r\n\r\nhttps://www.nunoa.cl/p3")
    pages = readers.read_saved_searches(spark, str(tmp_path))
    seeds = D.found_seeds(pages, F.col("body"), ["k"]).orderBy("rank").collect()
    assert [r.url for r in seeds] == [f"https://www.nunoa.cl/p{k}" for k in (1, 2, 10)]


@pytest.mark.parametrize("many", [5, 30])
def test_the_cut_comes_after_slash_duplicates(spark, many):
    links = " ".join(f"https://www.nunoa.cl/p{i} https://www.nunoa.cl/p{i}/" for i in range(many))
    rows = spark.createDataFrame([("nunoa.cl", 0, links)], "domain STRING, k INT, body STRING")
    seeds = D.found_seeds(rows, F.col("body"), ["k"]).orderBy("rank").collect()
    assert [r.url for r in seeds] == [f"https://www.nunoa.cl/p{i}" for i in range(min(many, 20))]
    assert [r.rank for r in seeds] == list(range(1, min(many, 20) + 1))


def test_no_files_of_the_pattern_give_no_rows(spark, tmp_path):
    _save(tmp_path, "nunoa.cl/1.pdf", "x")
    assert readers.read_saved_pages(spark, str(tmp_path), ["domain", "k"], "*.html").collect() == []
