"""Queries on walls, scope predicates, links and the walk."""

from pyspark.sql import functions as F

from pagelens.catalog import inputs as I
from pagelens.catalog.base import query
from pagelens.functions import fixed_values as V, scoring, urls
from pagelens.operators import links as L
from pagelens.operators.facts import page_counts, readable, wall_report, with_walls
from pagelens.plans import scan

RESPONSE = "WITH " + I.RESPONSE_SQL
SNAPSHOT = "WITH RECURSIVE " + I.SNAPSHOT_SQL


# --- walls ------------------------------------------------------------------


@query(
    "flt_9_wall_filter",
    RESPONSE + "SELECT k, url, status FROM judged WHERE outcome = 'read'",
)
def flt_9(spark, sf):
    return readable(I.responses(spark, sf)).select("k", "url", "status")


@query(
    "flt_10_wall_vendor",
    RESPONSE + "SELECT k, wall_vendor, outcome FROM judged WHERE outcome <> 'read'",
)
def flt_10(spark, sf):
    return (
        with_walls(I.responses(spark, sf))
        .filter("outcome <> 'read'")
        .select("k", "wall_vendor", "outcome")
    )


@query(
    "agg_4_page_counts",
    RESPONSE
    + """
    SELECT run, count(*) FILTER (outcome = 'read') AS pages_read,
           count(*) FILTER (outcome = 'blocked') AS pages_blocked
    FROM judged GROUP BY run
    """,
)
def agg_4(spark, sf):
    return page_counts(with_walls(I.responses(spark, sf)), ["run"])


@query(
    "agg_5_wall_report",
    RESPONSE
    + """
    , r AS (SELECT run, outcome, wall_vendor FROM judged UNION ALL
            SELECT 100 + (k % 9)::INT, outcome, wall_vendor FROM judged
            WHERE (k % 9 < 4 AND outcome <> 'read') OR (k % 9 = 4 AND outcome <> 'blocked')),
    c AS (
      SELECT run, count(*) FILTER (outcome = 'read') AS pages_read,
             count(*) FILTER (outcome = 'blocked') AS pages_blocked,
             coalesce(array_to_string(list_sort(list(DISTINCT wall_vendor)
               FILTER (wall_vendor <> '')), ', '), '') AS names
      FROM r GROUP BY run)
    SELECT run, pages_read, pages_blocked,
      CASE WHEN pages_blocked = 0 THEN '' ELSE replace(replace(replace(
        CASE WHEN pages_read > 0 THEN '""" + V.WALLS_PARTIAL + """' ELSE '""" + V.WALLS_TOTAL + """' END,
        '{n}', pages_blocked::VARCHAR), '{plural}', CASE WHEN pages_blocked > 1 THEN 's' ELSE '' END),
        '{vendors}', CASE WHEN names = '' THEN '' ELSE ' (' || names || ')' END) END AS report
    FROM c
    """,
)
def agg_5(spark, sf):
    judged = with_walls(I.responses(spark, sf)).select("k", "run", "wall_vendor", "outcome")
    ninth, outcome = F.col("k") % 9, F.col("outcome")
    more = judged.filter(
        ((ninth < 4) & (outcome != "read")) | ((ninth == 4) & (outcome != "blocked"))
    ).withColumn(
        "run", (ninth + 100).cast("int")
    )
    return wall_report(judged.unionByName(more), ["run"])


# --- URL predicates -------------------------------------------------------------


_URL_SQL = r"""
WITH u AS (
  SELECT o_orderkey AS k,
    ['https://www.nunoa.cl/a', 'http://x.CL:8080/b', 'https://example.com/contacto?ref=nunoa.cl',
     'mailto:a@b.cl', '/relative/nunoa.cl', 'ftp://files.nunoa.cl/', 'https://cl/',
     'https://user@xnunoa.cl/p#q'][o_orderkey % 8 + 1] || o_orderkey AS url
  FROM orders)
"""
_URLS = [
    "https://www.nunoa.cl/a",
    "http://x.CL:8080/b",
    "https://example.com/contacto?ref=nunoa.cl",
    "mailto:a@b.cl",
    "/relative/nunoa.cl",
    "ftp://files.nunoa.cl/",
    "https://cl/",
    "https://user@xnunoa.cl/p#q",
]


def _url_rows(spark, sf):
    k = F.col("o_orderkey")
    heads = F.array(*[F.lit(u) for u in _URLS])
    return I.table(spark, sf, "orders", "o_orderkey").select(
        k.alias("k"),
        F.concat(F.get(heads, (k % 8).cast("int")), k.cast("string")).alias("url"),
    )


@query("flt_1_tld_scope", _URL_SQL + "SELECT k, url FROM u WHERE k % 8 IN (0, 1, 5, 7)")
def flt_1(spark, sf):
    return _url_rows(spark, sf).filter(urls.in_tld(F.col("url")))


@query(
    "flt_1_tld_scope_pages",
    r"""
    SELECT page_id, url FROM pages
    WHERE regexp_matches(regexp_extract(url, '^https?://([^/?#]*)', 1), '[.]org$')
    """,
)
def flt_1_pages(spark, sf):
    return I.pages(spark, sf).filter(urls.in_tld(F.col("url"), "org")).select(
        "page_id", "url"
    )


@query(
    "flt_2_crawl_scope",
    _URL_SQL
    + """
    SELECT k, 'tld' AS scope FROM u WHERE k % 8 IN (0, 1, 5, 7) OR k % 100 = 2
    UNION ALL SELECT k, 'any' FROM u
    """,
)
def flt_2(spark, sf):
    rows = _url_rows(spark, sf)
    seed = F.col("k") % 100 == 2
    kept = [
        rows.filter(urls.in_scope(F.col("url"), seed, scope)).select(
            "k", F.lit(scope).alias("scope")
        )
        for scope in ("tld", "any")
    ]
    return kept[0].unionByName(kept[1])


@query("flt_6_http_links", _URL_SQL + "SELECT k, url FROM u WHERE k % 8 IN (0, 1, 2, 6, 7)")
def flt_6(spark, sf):
    return _url_rows(spark, sf).filter(urls.is_http(F.col("url")))


@query("flt_7_internal_links", _URL_SQL + "SELECT k, url FROM u WHERE k % 8 IN (0, 5, 7)")
def flt_7(spark, sf):
    return _url_rows(spark, sf).filter(urls.is_internal(F.col("url"), "nunoa.cl"))


# --- edges ------------------------------------------------------------------------

_EDGE_SQL = r"""
WITH link AS (
  SELECT url AS src, regexp_extract(url, '^https?://[^/?#]*') AS base,
         unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
         generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS pos
  FROM pages),
edge AS (
  SELECT src, pos::INT AS pos, CASE WHEN href LIKE 'http%' THEN href ELSE base || href END AS dst
  FROM link)
"""


@query("job_link_edges", _EDGE_SQL + "SELECT src, dst, pos FROM edge")
def job_link_edges(spark, sf):
    return L.link_edges(I.pages(spark, sf))


@query("sca_4_resolve_link", SNAPSHOT + "SELECT src, dst, pos FROM edge")
def sca_4(spark, sf):
    return L.link_edges(I.snapshot(spark, sf))


def _values(table: dict) -> str:
    return ", ".join(f"('{w}', {v})" for w, v in table.items())


_SCORES = {**V.BASE_SCORES}
for _word, _value in V.ENTITY_SCORES["university"].items():
    _SCORES[_word] = max(_value, _SCORES.get(_word, 0))


@query(
    "sca_29_link_score",
    f"""
    WITH w(word, points) AS (VALUES {_values(_SCORES)}),
    u AS (SELECT doc_id, 'https://x.cl/' || lower(source) || '/' ||
            ['contacto','Staff','rector/correo','nada','postgrado','about-us','carreras'][doc_id % 7 + 1]
            AS url FROM documents)
    SELECT doc_id, coalesce(max(points), 0) AS score
    FROM u LEFT JOIN w ON contains(lower(url), word) GROUP BY doc_id
    """,
)
def sca_29(spark, sf):
    words = ["contacto", "Staff", "rector/correo", "nada", "postgrado", "about-us", "carreras"]
    pick = F.get(F.array(*[F.lit(w) for w in words]), (F.col("doc_id") % 7).cast("int"))
    url = F.concat(F.lit("https://x.cl/"), F.lower("source"), F.lit("/"), pick)
    return I.table(spark, sf, "documents", "doc_id").select(
        "doc_id", scoring.link_score(url, "university").alias("score")
    )


@query(
    "agg_10_best_score",
    _EDGE_SQL
    + f""", w(word, points) AS (VALUES {_values({**V.BASE_SCORES, **V.ENTITY_SCORES['company']})}),
    scored AS (SELECT src, dst, pos, coalesce(max(points), 0) AS score
      FROM edge LEFT JOIN w ON contains(lower(dst), word) GROUP BY ALL)
    SELECT src, max(score) AS best, count(*) AS links FROM scored GROUP BY src
    """,
)
def agg_10(spark, sf):
    return L.link_edges(I.pages(spark, sf), "company").groupBy("src").agg(
        F.max("score").alias("best"), F.count(F.lit(1)).alias("links")
    )


def _contact_links(spark, sf):
    """Edges of a page per order; the path word decides the score."""
    k = F.col("o_orderkey")
    words = F.array(
        *[F.lit(w) for w in ("transparencia/funcionarios", "contacto", "programas", "noticias/2026")]
    )
    host = F.when(k % 5 == 0, "https://example.com/?ref=nunoa.cl&p=").otherwise(
        "https://www.nunoa.cl/"
    )
    dst = F.concat(host, F.get(words, (k % 4).cast("int")), F.lit("/"), (k % 300).cast("string"))
    return I.table(spark, sf, "orders", "o_orderkey").select(
        F.lit("https://www.nunoa.cl/").alias("src"),
        dst.alias("dst"),
        k.cast("int").alias("pos"),
        scoring.link_score(dst, "municipality").alias("score"),
    )


_CONTACT_LINKS_SQL = """
WITH l AS (
  SELECT o_orderkey AS k,
    CASE WHEN o_orderkey % 5 = 0 THEN 'https://example.com/?ref=nunoa.cl&p='
         ELSE 'https://www.nunoa.cl/' END
    || ['transparencia/funcionarios', 'contacto', 'programas', 'noticias/2026'][o_orderkey % 4 + 1]
    || '/' || (o_orderkey % 300) AS dst,
    [10, 10, 3, 0][o_orderkey % 4 + 1] AS score
  FROM orders)
"""


@query("flt_8_min_score", _CONTACT_LINKS_SQL + "SELECT k, dst, score FROM l WHERE score >= 3")
def flt_8(spark, sf):
    return _contact_links(spark, sf).filter(F.col("score") >= V.MIN_LINK_SCORE).select(
        F.col("pos").cast("bigint").alias("k"), "dst", "score"
    )


@query(
    "top_1_rank_links",
    _CONTACT_LINKS_SQL
    + """
    SELECT dst, max(score) AS score FROM l
    WHERE score >= 3 AND dst LIKE 'https://www.nunoa.cl/%' GROUP BY dst
    """,
)
def top_1(spark, sf):
    kept = _contact_links(spark, sf).filter(
        urls.is_internal(F.col("dst"), "nunoa.cl") & (F.col("score") >= V.MIN_LINK_SCORE)
    )
    return L.rank_links(kept)


# --- walk ---------------------------------------------------------------------------

_WALK_SQL = SNAPSHOT + """
, step AS (
  SELECT e.src, e.dst AS url, e.pos, n.wall, n.failed FROM edge e JOIN node n ON n.url = e.dst),
d0 AS (SELECT s.url, n.wall, n.failed, lpad(rank::VARCHAR, 12, '0') AS path FROM seed s JOIN node n USING (url)),
d1 AS (SELECT s.url, any_value(s.wall) AS wall, any_value(s.failed) AS failed, min(d.path || '.' || s.pos) AS path
  FROM d0 d JOIN step s ON s.src = d.url WHERE NOT d.wall AND NOT d.failed
  AND s.url NOT IN (SELECT url FROM d0) GROUP BY s.url),
d2 AS (SELECT s.url, any_value(s.wall) AS wall, any_value(s.failed) AS failed, min(d.path || '.' || s.pos) AS path
  FROM d1 d JOIN step s ON s.src = d.url WHERE NOT d.wall AND NOT d.failed
  AND s.url NOT IN (SELECT url FROM d0 UNION ALL SELECT url FROM d1) GROUP BY s.url),
d3 AS (SELECT s.url, any_value(s.wall) AS wall, any_value(s.failed) AS failed, min(d.path || '.' || s.pos) AS path
  FROM d2 d JOIN step s ON s.src = d.url WHERE NOT d.wall AND NOT d.failed
  AND s.url NOT IN (SELECT url FROM d0 UNION ALL SELECT url FROM d1
    UNION ALL SELECT url FROM d2) GROUP BY s.url),
steps AS (
  SELECT url, 0 AS depth, path, wall, failed FROM d0
  UNION ALL SELECT url, 1, path, wall, failed FROM d1
  UNION ALL SELECT url, 2, path, wall, failed FROM d2
  UNION ALL SELECT url, 3, path, wall, failed FROM d3),
walk AS (
  SELECT url, depth, path,
         CASE WHEN failed THEN 'failed' WHEN wall THEN 'blocked' ELSE 'read' END AS outcome
  FROM steps)
"""


def _walk(spark, sf, **options):
    walked = scan.walk_snapshot(
        I.snapshot(spark, sf), I.snapshot_seeds(spark, sf), **options
    )
    head = F.lpad(F.element_at("path", 1).cast("string"), 12, "0")
    tail = F.array_join(F.slice("path", 2, 10).cast("array<string>"), ".")
    path = F.when(F.size("path") == 1, head).otherwise(F.concat_ws(".", head, tail))
    return walked.select("url", "depth", path.alias("path"), "outcome")


@query("job_crawl_frontier", _WALK_SQL + "SELECT * FROM walk")
def job_crawl_frontier(spark, sf):
    return _walk(spark, sf)


@query(
    "top_4_max_pages",
    _WALK_SQL
    + """
    , numbered AS (SELECT *, count(*) FILTER (outcome = 'read') OVER (ORDER BY depth, path
        ROWS UNBOUNDED PRECEDING) AS read FROM walk)
    SELECT url, depth, path, outcome FROM numbered
    WHERE read < (SELECT count(*) // 12 FROM customer)
       OR (read = (SELECT count(*) // 12 FROM customer) AND outcome = 'read')
    """,
)
def top_4(spark, sf):
    size = I.table(spark, sf, "customer").count()
    return _walk(spark, sf, max_pages=size // 12)


@query(
    "join_10_visited_anti",
    SNAPSHOT
    + """
    SELECT DISTINCT e.dst AS url FROM edge e JOIN seed s ON s.url = e.src
      JOIN node f ON f.url = e.src JOIN node n ON n.url = e.dst
    WHERE NOT f.wall AND NOT f.failed AND e.dst NOT IN (SELECT url FROM seed)
    """,
)
def join_10(spark, sf):
    """What one round of the walk adds: pages not visited before."""
    walked = scan.walk_snapshot(
        I.snapshot(spark, sf), I.snapshot_seeds(spark, sf), max_depth=1
    )
    return walked.filter("depth = 1").select("url")
