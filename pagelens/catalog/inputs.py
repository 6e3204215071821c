"""Inputs of the registered queries, all computed from the given tables.

The given tables hold no mail observations and no obfuscated pages, so those
are derived from their rows by plain arithmetic. Each derivation has a DuckDB
twin (``*_SQL``) that states the same facts or, for pages, the addresses a
reader should find in them.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagelens.operators.shared import spread
from pagelens.sources.readers import read_pages


def table(spark: SparkSession, sf: str, name: str, *spread_by: str) -> DataFrame:
    """A given table; ``spread_by`` widens a single-split file before heavy work."""
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(rows, *spread_by) if spread_by else rows


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_pages(spark, f"{sf}/pages.parquet", widen=True)


# --- pages with addresses published in thirteen ways ------------------------------

CONTACT_SQL = """
contact AS (
  SELECT c_custkey AS k, c_custkey % 13 AS v, c_nationkey AS nk,
         's' || (c_custkey % 50) || '@' || lower(c_mktsegment) || '.cl' AS addr,
         'https://www.' || lower(c_mktsegment) || '.cl/p/' || c_custkey AS url
  FROM customer),
published AS (
  SELECT k, url, addr AS email, v IN (4, 5, 6, 10) AS hidden
  FROM contact WHERE v <> 11)
"""


def _xor_hex(address: Column, key: Column) -> Column:
    octets = F.transform(
        F.sequence(F.lit(1), F.length(address)),
        lambda i: F.lpad(
            F.lower(F.hex(F.ascii(F.substr(address, i, F.lit(1))).bitwiseXOR(key))),
            2,
            "0",
        ),
    )
    return F.concat(F.lpad(F.lower(F.hex(key)), 2, "0"), F.array_join(octets, ""))


def contact_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page per customer; the way of publishing is ``c_custkey % 13``."""
    k = F.col("c_custkey")
    segment = F.lower("c_mktsegment")
    local = F.concat(F.lit("s"), (k % 50).cast("string"))
    host = F.concat(segment, F.lit(".cl"))
    addr = F.concat(local, F.lit("@"), host)
    code = _xor_hex(addr, (k % 256).cast("int"))
    shown = [
        F.concat(F.lit("<p>Escriba a "), F.upper(addr), F.lit(" hoy</p>")),
        F.concat(F.lit('<a href="mailto:'), addr, F.lit('?subject=a&amp;b">correo</a>')),
        F.concat(F.lit("<p>"), local, F.lit(" [at] "), host, F.lit("</p>")),
        F.concat(F.lit("<li>"), local, F.lit("  at\n"), host, F.lit("</li>")),
        F.concat(F.lit('<div style="display: none">'), addr, F.lit("</div>")),
        F.concat(F.lit("<div hidden><p><b>"), addr, F.lit("</b></p></div>")),
        F.concat(F.lit('<a style="font-size:0" href="mailto:'), addr, F.lit('">.</a>')),
        F.concat(
            F.lit('<span class="__cf_email__" data-cfemail="'),
            code,
            F.lit('">[protegido]</span>'),
        ),
        F.concat(
            F.lit("<a href='/cdn-cgi/l/email-protection#"), code, F.lit("'>correo</a>")
        ),
        F.concat(
            F.lit('<p aria-hidden="true">'), addr, F.lit("</p><p>"), addr, F.lit("</p>")
        ),
        F.concat(
            F.lit('<span style="color:#fff;background:white">'), addr, F.lit("</span>")
        ),
        F.concat(F.lit("<p>"), local, F.lit("@"), segment, F.lit(".com</p>")),
        F.concat(F.lit("<p>"), local, F.lit("&#64;"), host, F.lit("</p>")),
    ]
    body = F.lit("")
    for variant, markup in enumerate(shown):
        body = F.when(k % len(shown) == variant, markup).otherwise(body)
    lang = (
        F.when(F.col("c_nationkey") % 3 == 0, "es-CL")
        .when(F.col("c_nationkey") % 3 == 1, " ES_cl")
        .otherwise("es")
    )
    return table(spark, sf, "customer", "c_custkey").select(
        k.alias("page_id"),
        F.concat(
            F.lit("https://www."), host, F.lit("/p/"), k.cast("string")
        ).alias("url"),
        F.concat(
            F.lit('<!DOCTYPE html><html lang="'),
            lang,
            F.lit('"><head><script>var a = "no@script.cl";</script></head><body>'),
            F.lit("<!-- no@comment.cl --><h1>Ficha</h1>"),
            body,
            F.lit("<footer>fin</footer></body></html>"),
        ).alias("html"),
        k.alias("crawl_seq"),
    )


# --- responses, some of them walls ---------------------------------------------------

RESPONSE_SQL = """
response AS (
  SELECT c_custkey AS k, 'https://h' || (c_custkey % 7) || '.cl/' || c_custkey AS url,
         CASE WHEN c_custkey % 9 = 8 THEN 404 WHEN c_custkey % 13 = 5 THEN 500
              WHEN c_custkey % 2 = 0 THEN 200 ELSE 202 END AS status,
         c_custkey % 17 = 6 AS bodiless,
         c_custkey % 8 AS v, c_nationkey AS run
  FROM customer),
judged AS (
  SELECT *, CASE WHEN status NOT BETWEEN 200 AND 299 OR bodiless THEN 'failed'
                 WHEN wall_vendor IS NULL THEN 'read' ELSE 'blocked' END AS outcome FROM (
  SELECT k, url, run, status, bodiless,
         CASE WHEN status NOT BETWEEN 200 AND 299 OR bodiless THEN NULL
              WHEN v = 0 THEN 'SiteGround' WHEN v = 1 THEN 'Cloudflare'
              WHEN v = 2 THEN '' WHEN v = 3 THEN 'Sucuri' WHEN v = 6 THEN ''
         END AS wall_vendor
  FROM response))
"""


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """One recorded response per customer: eight shapes of body, failures, none."""
    k = F.col("c_custkey")
    bodies = [
        '<html><head><meta http-equiv="refresh" content="0;/.well-known/sgcaptcha/'
        '?r=%2F"></head></html>',
        '<html><head><script src="/CDN-cgi/challenge-platform/x.js"></script></head>'
        "<body> </body></html>",
        "<html><body><div></div></body></html>",
        "<html><body></body></html>",
        "<html><body><p>Bienvenidos: just a moment, sucuri_cloudproxy</p></body></html>",
        '<html><body><a href="/inicio"></a></body></html>',
        '<html><body><a href="#top"></a><a href="mailto:a@b.cl"></a></body></html>',
    ]
    body = F.concat(F.lit("<html><!--"), F.repeat(F.lit("x"), 2100), F.lit("--></html>"))
    for variant, markup in enumerate(bodies):
        body = F.when(k % 8 == variant, markup).otherwise(body)
    return table(spark, sf, "customer", "c_custkey").select(
        k.alias("k"),
        F.concat(
            F.lit("https://h"), (k % 7).cast("string"), F.lit(".cl/"), k.cast("string")
        ).alias("url"),
        F.when(k % 9 == 8, 404)
        .when(k % 13 == 5, 500)
        .when(k % 2 == 0, 200)
        .otherwise(202)
        .alias("status"),
        F.when(k % 16 == 3, F.create_map(F.lit("x-sucuri-block"), F.lit("1")))
        .when(k % 8 == 3, F.create_map(F.lit("X-Sucuri-Block"), F.lit("1")))
        .otherwise(F.create_map(F.lit("Server"), F.lit("nginx")))
        .alias("headers"),
        F.when(k % 17 != 6, body).alias("html"),
        k.alias("crawl_seq"),
        F.col("c_nationkey").alias("run"),
    )


# --- a linked snapshot --------------------------------------------------------------

SNAPSHOT_SQL = """
node AS (
  SELECT c_custkey AS k, 'https://site.cl/p' || c_custkey AS url,
         c_custkey % 17 = 5 AS wall,
         c_custkey % 19 = 4 OR c_custkey % 23 = 7 OR c_custkey % 29 = 9 AS failed,
         (SELECT count(*) FROM customer) AS n FROM customer),
edge AS (
  SELECT url AS src, pos, CASE pos
           WHEN 0 THEN 'https://site.cl/p' || ((k * 3 + 1) % n)
           WHEN 1 THEN 'https://site.cl/p' || ((k * 7 + 2) % n)
           WHEN 2 THEN 'https://site.cl/p0'
           WHEN 3 THEN 'https://site.cl/missing' || k
           ELSE 'https://other.com/p' || k END AS dst
  FROM node, (VALUES (0), (1), (2), (3), (4)) AS p(pos)
  WHERE NOT (wall AND NOT failed) AND k % 29 <> 9),
seed AS (SELECT url, k AS rank FROM node WHERE k % 40 = 3)
"""


def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """One page per customer linking to two others, to page 0 and outside.

    Some are walls, some answered 404 or 500 with links in the body, some have
    no body.
    """
    customer = table(spark, sf, "customer", "c_custkey")
    size = table(spark, sf, "customer").agg(F.count(F.lit(1))).scalar()
    k, n = F.col("c_custkey"), F.col("n")

    def link(prefix: str, number: Column) -> Column:
        return F.concat(
            F.lit(f'<a href="{prefix}'), number.cast("string"), F.lit('">x</a>')
        )

    html = F.concat(
        F.lit("<html><body>pagina"),
        link("p", (k * 3 + 1) % n),
        link("/p", (k * 7 + 2) % n),
        F.lit('<a href="https://site.cl/p0">inicio</a>'),
        link("./missing", k),
        link("https://other.com/p", k),
        F.lit('<a href="mailto:a@site.cl">m</a></body></html>'),
    )
    return customer.withColumn("n", size).select(
        k.alias("page_id"),
        F.concat(F.lit("https://site.cl/p"), k.cast("string")).alias("url"),
        F.when(k % 29 == 9, None)
        .when((k % 17 == 5) & ~_failed(k), "<html><body></body></html>")
        .otherwise(html)
        .alias("html"),
        F.when(k % 19 == 4, 404).when(k % 23 == 7, 500).otherwise(200).alias("status"),
        k.alias("crawl_seq"),
    )


def _failed(k: Column) -> Column:
    return (k % 19 == 4) | (k % 23 == 7) | (k % 29 == 9)


def snapshot_seeds(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return (
        table(spark, sf, "customer")
        .filter(k % 40 == 3)
        .select(
            F.concat(F.lit("https://site.cl/p"), k.cast("string")).alias("url"),
            k.alias("rank"),
        )
    )


# --- mail observations ---------------------------------------------------------------

MAIL_SQL = """
address AS (
  SELECT c_custkey, 'c' || c_custkey
           || CASE WHEN c_custkey % 11 = 0 THEN '' ELSE '@' END
           || lower(c_mktsegment) || '.cl' AS email,
         lower(c_mktsegment) || '.cl' AS domain,
         c_custkey % 11 <> 0 AS syntax_ok
  FROM customer),
reply AS (
  SELECT o_custkey,
         CASE min(o_orderkey) % 6 WHEN 0 THEN 250 WHEN 1 THEN 550 WHEN 2 THEN 450
              WHEN 3 THEN 421 WHEN 4 THEN 252 ELSE 250 END AS code,
         CASE min(o_orderkey) % 5 WHEN 0 THEN '5.1.1 no such user'
              WHEN 1 THEN '5.7.1 policy' WHEN 2 THEN '5.2.2 full' WHEN 3 THEN ''
              ELSE 'Try again later' END AS message
  FROM orders GROUP BY o_custkey),
mx_row AS (
  SELECT s_suppkey, CASE s_nationkey % 5 WHEN 0 THEN 'automobile.cl'
           WHEN 1 THEN 'building.cl' WHEN 2 THEN 'furniture.cl'
           WHEN 3 THEN 'household.cl' ELSE 'machinery.cl' END AS domain,
         s_suppkey % 3 AS transport_order,
         CASE WHEN s_suppkey % 7 = 0 THEN 'unavailable' ELSE 'mx' END AS outcome,
         (s_suppkey % 4) * 10 AS preference, 'mx' || s_suppkey AS exchange
  FROM supplier),
mx_first AS (
  SELECT domain, min(transport_order) AS chosen FROM mx_row
  WHERE outcome = 'mx' GROUP BY domain),
mx_verdict AS (
  SELECT d.domain, CASE WHEN f.chosen IS NULL THEN 'unavailable' ELSE 'mx' END AS mx_outcome,
         (SELECT r.exchange FROM mx_row r WHERE r.domain = d.domain
            AND r.outcome = 'mx' AND r.transport_order = f.chosen
          ORDER BY r.preference, r.exchange LIMIT 1) AS mx_host
  FROM (SELECT DISTINCT domain FROM mx_row) d LEFT JOIN mx_first f USING (domain)),
catch_all AS (
  SELECT DISTINCT lower(c_mktsegment) || '.cl' AS domain,
         length(c_mktsegment) % 2 = 1 AS catch_all
  FROM customer)
"""


def addresses(spark: SparkSession, sf: str) -> DataFrame:
    """``email, source``; every eleventh lost its at sign."""
    k = F.col("c_custkey")
    at = F.when(k % 11 == 0, "").otherwise("@")
    return table(spark, sf, "customer").select(
        F.concat(
            F.lit("c"), k.cast("string"), at, F.lower("c_mktsegment"), F.lit(".cl")
        ).alias("email"),
        F.concat(F.lit("https://lista.cl/"), k.cast("string")).alias("source"),
        k.alias("c_custkey"),
    )


def smtp_replies(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o")
    firsts = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min("o_orderkey").alias("o")
    )
    codes = F.array(*[F.lit(c) for c in (250, 550, 450, 421, 252, 250)])
    texts = F.array(
        *[
            F.lit(m)
            for m in ("5.1.1 no such user", "5.7.1 policy", "5.2.2 full", "", "Try again later")
        ]
    )
    mailed = addresses(spark, sf)
    return mailed.join(firsts, mailed.c_custkey == firsts.o_custkey).select(
        "email",
        F.get(codes, (o % 6).cast("int")).alias("code"),
        F.get(texts, (o % 5).cast("int")).alias("message"),
        F.lit(None).cast("string").alias("error"),
    )


def mx_observations(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    names = F.array(
        *[
            F.lit(f"{d}.cl")
            for d in ("automobile", "building", "furniture", "household", "machinery")
        ]
    )
    failed = s % 7 == 0
    return table(spark, sf, "supplier").select(
        F.get(names, (F.col("s_nationkey") % 5).cast("int")).alias("domain"),
        F.get(
            F.array(F.lit("system"), F.lit("public"), F.lit("doh")), (s % 3).cast("int")
        ).alias("transport"),
        (s % 3).cast("int").alias("transport_order"),
        F.when(failed, "unavailable").otherwise("mx").alias("outcome"),
        ((s % 4) * 10).cast("int").alias("preference"),
        F.concat(F.lit("mx"), s.cast("string")).alias("exchange"),
        F.when(failed, F.concat(F.lit("timeout "), (s % 3).cast("string"))).alias("detail"),
    )


def catch_all_probes(spark: SparkSession, sf: str) -> DataFrame:
    """Two probes per address domain; domains of odd length refuse one."""
    domains = table(spark, sf, "customer").select(
        F.concat(F.lower("c_mktsegment"), F.lit(".cl")).alias("domain")
    ).distinct()
    refuses = F.length("domain") % 2 == 1
    return domains.withColumn(
        "probe_no", F.explode(F.array(F.lit(1), F.lit(2)))
    ).withColumn("code", F.when(refuses & (F.col("probe_no") == 2), 550).otherwise(250))


# --- results, history and frames -------------------------------------------------------

RESULT_SQL = """
result AS (
  SELECT event_id AS id, user_id AS session_id,
         'u' || user_id || '@' || event_type || '.cl' AS email,
         'https://s.cl/' || event_id AS source,
         CASE event_type WHEN 'click' THEN 'valid' WHEN 'view' THEN 'unknown'
              WHEN 'purchase' THEN 'catch_all' WHEN 'error' THEN 'invalid'
              ELSE event_type END AS status,
         CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'e<' || (event_id % 3) || '>&"' END AS error,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 5 = 1 END AS hidden,
         CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 6 = 1 END AS generated,
         CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'path-cl, rut' END AS evidence
  FROM events)
"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Verified records from ``events``; optional fields are sometimes absent."""
    e, kind = F.col("event_id"), F.col("event_type")
    return table(spark, sf, "events").select(
        e.alias("id"),
        F.col("user_id").alias("session_id"),
        F.concat(
            F.lit("u"), F.col("user_id").cast("string"), F.lit("@"), kind, F.lit(".cl")
        ).alias("email"),
        F.concat(F.lit("https://s.cl/"), e.cast("string")).alias("source"),
        F.when(kind == "click", "valid")
        .when(kind == "view", "unknown")
        .when(kind == "purchase", "catch_all")
        .when(kind == "error", "invalid")
        .otherwise(kind)
        .alias("status"),
        F.when(
            e % 4 != 0, F.concat(F.lit("e<"), (e % 3).cast("string"), F.lit('>&"'))
        ).alias("error"),
        F.when(e % 3 == 1, F.array().cast("array<string>"))
        .when(e % 3 == 2, F.array(F.lit("path-cl"), F.lit("rut")))
        .alias("evidence"),
        F.when(e % 6 != 0, e % 6 == 1).alias("generated"),
        F.when(e % 5 != 0, e % 5 == 1).alias("hidden"),
    )


SESSION_SQL = """
session AS (
  SELECT o_custkey AS id, min(o_orderdate) AS created_at,
         '@' || (o_custkey % 9) || '.cl' AS target_domain
  FROM orders GROUP BY o_custkey)
"""


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_custkey")
    return table(spark, sf, "orders").groupBy(k.alias("id")).agg(
        F.min("o_orderdate").alias("created_at")
    ).select(
        "id",
        "created_at",
        F.concat(F.lit("@"), (F.col("id") % 9).cast("string"), F.lit(".cl")).alias(
            "target_domain"
        ),
        F.lit("").alias("seed_urls"),
        F.lit(0).alias("total_found"),
        F.lit(0).alias("total_valid"),
    )


def session_emails(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).select(
        "id", "session_id", "email", F.col("source").alias("source_url"), "status"
    )
