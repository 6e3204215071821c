"""Queries that run a whole job from its inputs to its results."""

from pyspark.sql import functions as F

from pagelens.catalog import inputs as I
from pagelens.catalog.base import query
from pagelens.catalog.mail import CLASSIFIED_SQL
from pagelens.operators import verdicts as D
from pagelens.plans import scan, verify


@query(
    "plan_verify_list",
    "WITH " + CLASSIFIED_SQL
    + """
    SELECT email || chr(9) || status || chr(9)
      || CASE WHEN c_custkey % 2 = 0 THEN 'https://lista.cl/' || c_custkey ELSE '' END AS value
    FROM told WHERE c_custkey % 10 <> 9
    """,
)
def plan_verify_list(spark, sf):
    k = F.col("c_custkey")
    line = (
        F.when(k % 10 == 9, F.concat(F.lit("# "), F.col("email")))
        .when(k % 2 == 0, F.concat_ws("\t", "email", F.lit("unknown"), "source"))
        .otherwise(F.concat(F.lit("  "), F.col("email")))
    )
    lines = I.addresses(spark, sf).select(line.alias("value"))
    run = verify.verify_list(
        lines,
        I.mx_observations(spark, sf),
        I.smtp_replies(spark, sf),
        I.catch_all_probes(spark, sf),
    )
    return run["lines"]


def _site(spark, sf):
    """Contact pages that also link: each to the next two of its own number."""
    pages = I.contact_pages(spark, sf)
    size = I.table(spark, sf, "customer").agg(F.count(F.lit(1))).scalar()
    k, n = F.col("page_id"), F.col("n")

    def link(number):
        return F.concat(
            F.lit('<a href="https://www.sitio.cl/p/'), number.cast("string"), F.lit('">s</a>')
        )

    html = F.concat("html", link((k * 2 + 1) % n), link((k * 2 + 2) % n))
    return pages.withColumn("n", size).select(
        F.concat(F.lit("https://www.sitio.cl/p/"), k.cast("string")).alias("url"),
        html.alias("html"),
    )


_SCAN_SQL = "WITH RECURSIVE " + I.CONTACT_SQL + """
, size AS (SELECT count(*) AS n FROM customer),
seed AS (SELECT k AS s, k FROM contact WHERE k % 25 = 4),
step AS (
  SELECT k AS src, pos, (k * 2 + 1 + pos) % n AS dst FROM contact, size, (VALUES (0), (1)) v(pos)),
d0 AS (SELECT k, lpad(s::VARCHAR, 12, '0') AS path FROM seed),
d1 AS (SELECT dst AS k, min(path || '.' || pos) AS path FROM d0 JOIN step ON src = k
  WHERE dst NOT IN (SELECT k FROM d0) GROUP BY dst),
d2 AS (SELECT dst AS k, min(path || '.' || pos) AS path FROM d1 JOIN step ON src = k
  WHERE dst NOT IN (SELECT k FROM d0 UNION ALL SELECT k FROM d1) GROUP BY dst),
walk AS (SELECT k, '0' || path AS at_ FROM d0 UNION ALL SELECT k, '1' || path FROM d1
  UNION ALL SELECT k, '2' || path FROM d2),
found AS (
  SELECT email, arg_min('https://www.sitio.cl/p/' || k, at_) AS source, arg_min(hidden, at_) AS hidden
  FROM published JOIN walk USING (k) GROUP BY email)
"""


@query(
    "plan_scan",
    _SCAN_SQL
    + """
    SELECT email, source, hidden, false AS generated,
      CASE WHEN email LIKE '%@building.cl' THEN 'invalid' WHEN email LIKE '%@machinery.cl' THEN 'unknown'
           ELSE 'unknown' END AS status,
      CASE WHEN email LIKE '%@building.cl' THEN 'No MX record: building.cl does not exist'
           WHEN email LIKE '%@machinery.cl' THEN 'MX lookup failed: timeout'
           ELSE '' END AS error
    FROM found
    """,
)
def plan_scan(spark, sf):
    """Walk, extraction, first page and verdict; mail hosts but no replies."""
    seeds = I.contact_pages(spark, sf).filter("page_id % 25 = 4").select(
        F.concat(F.lit("https://www.sitio.cl/p/"), F.col("page_id").cast("string")).alias("url"),
        F.col("page_id").alias("rank"),
    )
    segment = F.concat(F.lower("c_mktsegment"), F.lit(".cl"))
    seen = I.table(spark, sf, "customer").select(segment.alias("domain")).distinct()
    mx = seen.select(
        "domain",
        F.lit("system").alias("transport"),
        F.lit(0).alias("transport_order"),
        F.when(F.col("domain") == "building.cl", "not_found")
        .when(F.col("domain") == "machinery.cl", "unavailable")
        .otherwise("mx")
        .alias("outcome"),
        F.lit(10).alias("preference"),
        F.lit("mx.").alias("exchange"),
        F.when(F.col("domain") == "machinery.cl", "timeout").alias("detail"),
    )
    run = scan.scan(
        _site(spark, sf), seeds, D.mx_verdicts(mx), max_depth=2, max_pages=None, smtp_enabled=False
    )
    return run["results"].select("email", "source", "hidden", "generated", "status", "error")
