"""The walk against a plain queue, over random graphs with walls."""

import random
from collections import deque

import pytest

from pagelens.operators.links import crawl_frontier
from pagelens.plans import scan


def queue_walk(edges, seeds, known, max_depth, max_pages, in_scope):
    links = {}
    for src, dst, pos in sorted(edges, key=lambda e: e[2]):
        links.setdefault(src, []).append(dst)
    queue = deque((s, 0) for s in seeds)
    visited, out, read = set(), [], 0
    while queue and (max_pages is None or read < max_pages):
        url, depth = queue.popleft()
        if url in visited or depth > max_depth:
            continue
        visited.add(url)
        if not in_scope(url) and url not in seeds:
            continue
        if url not in known:
            continue
        out.append((url, depth))
        if known[url]:
            continue
        read += 1
        if depth < max_depth:
            queue.extend((d, depth + 1) for d in links.get(url, []))
    return out


def graph(seed):
    rng = random.Random(seed)
    n = 40
    name = lambda i: f"https://s.{'com' if i % 9 == 4 else 'cl'}/p{i}"
    known = {name(i): rng.random() < 0.2 for i in range(n) if rng.random() < 0.9}
    edges = []
    for i in range(n):
        for pos in range(rng.randrange(5)):
            target = 0 if rng.random() < 0.3 else rng.randrange(n)
            edges.append((name(i), name(target), pos))
    seeds = [name(i) for i in rng.sample(range(n), 4)]
    return edges, seeds, known


@pytest.mark.parametrize(
    "seed, max_depth, max_pages, scope",
    [(1, 3, None, "tld"), (2, 2, 6, "any"), (3, 3, 9, "tld"), (4, 1, 1, "any"), (5, 0, None, "tld")],
)
def test_walk_equals_queue(spark, seed, max_depth, max_pages, scope):
    edges, seeds, known = graph(seed)
    walked = crawl_frontier(
        spark.createDataFrame(edges, "src STRING, dst STRING, pos INT"),
        spark.createDataFrame(list(zip(seeds, range(len(seeds)))), "url STRING, rank INT"),
        spark.createDataFrame(
            [(u, "" if w else None) for u, w in known.items()], "url STRING, wall_vendor STRING"
        ),
        max_depth,
        max_pages,
        scope,
    )
    got = [(r.url, r.depth) for r in walked.orderBy("depth", "path").collect()]
    in_scope = lambda u: scope == "any" or u.split("/")[2].endswith(".cl")
    assert got == queue_walk(edges, seeds, known, max_depth, max_pages, in_scope)


def test_scan_reads_walked_pages_in_order(pages, spark):
    table = pages(
        ("https://a.cl/", "<p>x@a.cl</p><a href='/2'>2</a><a href='/1'>1</a>"),
        ("https://a.cl/1", "<p hidden>y@a.cl</p>"),
        ("https://a.cl/2", "<p>y@a.cl</p><a href='https://b.com/'>b</a>"),
        ("https://b.com/", "<p>z@a.cl</p>"),
        ("https://a.cl/suelta", "<p>w@a.cl</p>"),
    )
    seeds = spark.createDataFrame([("https://a.cl/", 0)], "url STRING, rank INT")
    mx = spark.createDataFrame([("a.cl", "mx", None)], "domain STRING, mx_outcome STRING, mx_detail STRING")
    run = scan.scan(table, seeds, mx, smtp_enabled=False)
    rows = sorted((r.email, r.source, r.hidden) for r in run["results"].collect())
    assert rows == [
        ("x@a.cl", "https://a.cl/", False),
        ("y@a.cl", "https://a.cl/2", False),
    ]
    assert run["walls"].first().pages_read == 3


def test_large_and_small_walks_give_the_same_addresses(pages, spark, monkeypatch):
    table = pages(
        ("https://a.cl/", "<p>x@a.cl</p><a href='/1'>1</a>"),
        ("https://a.cl/1", "<p hidden>y@a.cl</p><p>x@a.cl</p>"),
    )
    seeds = spark.createDataFrame([("https://a.cl/", 0)], "url STRING, rank INT")
    mx = spark.createDataFrame([("a.cl", "mx", None)], "domain STRING, mx_outcome STRING, mx_detail STRING")
    as_rows = lambda run: sorted((r.email, r.source, r.hidden) for r in run["results"].collect())
    small = as_rows(scan.scan(table, seeds, mx, smtp_enabled=False))
    assert len(small) == 2
    monkeypatch.setattr(scan, "small", lambda df: False)
    assert as_rows(scan.scan(table, seeds, mx, smtp_enabled=False)) == small
    assert as_rows(scan.scan(table, seeds, mx, target="a.cl", pattern="{first}", smtp_enabled=False)) == small


def test_failed_responses_are_neither_read_nor_followed(spark):
    rows = [
        ("https://a.cl/", 200, "<p>x@a.cl</p><a href='/f'>f</a><a href='/n'>n</a>"),
        ("https://a.cl/f", 404, "<p>err@a.cl</p><a href='/deep'>d</a>"),
        ("https://a.cl/n", 200, None),
        ("https://a.cl/deep", 200, "<p>deep@a.cl</p>"),
    ]
    table = spark.createDataFrame(rows, "url STRING, status INT, html STRING")
    seeds = spark.createDataFrame([("https://a.cl/", 0)], "url STRING, rank INT")
    mx = spark.createDataFrame([("a.cl", "mx", None)], "domain STRING, mx_outcome STRING, mx_detail STRING")
    run = scan.scan(table, seeds, mx, smtp_enabled=False)
    assert [r.email for r in run["results"].collect()] == ["x@a.cl"]
    outcomes = {r.url: r.outcome for r in run["walk"].collect()}
    assert outcomes == {
        "https://a.cl/": "read", "https://a.cl/f": "failed", "https://a.cl/n": "failed"
    }
    assert run["walls"].first()[:2] == (1, 0)
