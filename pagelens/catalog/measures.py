"""Queries on estimates: siblings, keyservers, intervals, quantiles, samples."""

from pyspark.sql import functions as F

from pagelens.catalog import inputs as I
from pagelens.catalog.base import query
from pagelens.catalog.extraction import wilson_sql
from pagelens.catalog.mail import CLASSIFIED_SQL, classified
from pagelens.operators import estimates as E
from pagelens.plans import measures

_K_N = wilson_sql("k", "n")


@query(
    "agg_15_wilson",
    f"""
    WITH c AS (SELECT source, sum(quality)::BIGINT AS k, count(*) AS n
      FROM documents JOIN labels USING (doc_id) GROUP BY source
      UNION ALL SELECT 'none', 0, 0)
    SELECT source, k, n, {_K_N[0]} AS low, {_K_N[1]} AS high FROM c
    """,
)
def agg_15(spark, sf):
    docs = I.table(spark, sf, "documents").join(I.table(spark, sf, "labels"), "doc_id")
    counted = docs.groupBy("source").agg(
        F.sum("quality").alias("k"), F.count(F.lit(1)).alias("n")
    )
    empty = counted.agg(F.lit("none").alias("source")).select(
        "source", F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("n")
    )
    both = E.with_wilson(counted.unionByName(empty), "k", "n")
    return both.select(
        "source", "k", "n", F.round("low", 9).alias("low"), F.round("high", 9).alias("high")
    )


@query(
    "agg_16_latency_quantiles",
    """
    WITH r AS (
      SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
        count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE event_type <> 'signup')
    SELECT event_type, max(value) FILTER (i = n // 2) AS median,
      max(value) FILTER (i = least(n - 1, floor(n * 0.95)::BIGINT)) AS p95
    FROM r GROUP BY event_type
    """,
)
def agg_16(spark, sf):
    timed = I.table(spark, sf, "events").filter("event_type <> 'signup'")
    return E.latency_quantiles(timed, ["event_type"], "value")


@query(
    "agg_16_latency_quantiles_all",
    """
    WITH r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i,
        count(*) OVER () AS n FROM lineitem)
    SELECT 1 AS run, max(v) FILTER (i = n // 2) AS median,
      max(v) FILTER (i = least(n - 1, floor(n * 0.95)::BIGINT)) AS p95 FROM r
    """,
)
def agg_16_all(spark, sf):
    prices = I.table(spark, sf, "lineitem").select(
        F.lit(1).alias("run"), F.col("l_extendedprice").alias("v")
    )
    return E.latency_quantiles(prices, ["run"], "v")


# --- siblings ------------------------------------------------------------------------

_SIBLING_SQL = """
host AS (
  SELECT o_orderkey AS seq, ['www.emp{n}.com', 'emp{n}.co.uk', 'a.b.emp{n}.org.', 'co.uk', 'EMP{n}.com', 'solo'][o_orderkey % 6 + 1] AS t,
    o_orderkey % 6 AS v, o_custkey % 400 AS n FROM orders),
named AS (
  SELECT seq, v, replace(t, '{n}', n::VARCHAR) AS host,
    CASE WHEN v IN (3, 5) THEN NULL ELSE 'emp' || n END AS base FROM host),
obs AS (SELECT 'emp' || n || '.cl' AS sibling, ['mail-capable', 'no-mail', 'unreachable'][n % 3 + 1] AS outcome,
    'd' || n AS detail, n / 8.0 AS seconds FROM (SELECT DISTINCT o_custkey % 400 AS n FROM orders)),
probe AS (
  SELECT seq, host, coalesce(base || '.cl', '') AS sibling,
    CASE WHEN base IS NULL THEN 'no-base' ELSE outcome END AS outcome,
    CASE WHEN base IS NULL THEN 'host is a public suffix'
      WHEN seq > min(seq) OVER (PARTITION BY base) THEN detail || ' (cached)' ELSE detail END AS detail,
    CASE WHEN base IS NULL THEN 0.0 ELSE seconds END::DOUBLE AS seconds
  FROM named LEFT JOIN obs ON obs.sibling = base || '.cl')
"""


def _hosts(spark, sf):
    k = F.col("o_orderkey")
    shapes = F.array(
        *[
            F.lit(h)
            for h in ("www.emp{n}.com", "emp{n}.co.uk", "a.b.emp{n}.org.", "co.uk", "EMP{n}.com", "solo")
        ]
    )
    name = F.replace(
        F.get(shapes, (k % 6).cast("int")),
        F.lit("{n}"),
        (F.col("o_custkey") % 400).cast("string"),
    )
    return I.table(spark, sf, "orders").select(k.alias("seq"), name.alias("host"))


def _suffixes(spark, sf):
    """Rules with the regions' keys as further two-level suffixes."""
    own = F.concat(F.lit("r"), F.col("r_regionkey").cast("string"), F.lit(".uk"))
    regions = I.table(spark, sf, "region").select(own.alias("suffix"))
    fixed = I.table(spark, sf, "region").select(
        F.explode(F.array(F.lit("com"), F.lit("uk"), F.lit("co.uk"), F.lit("org"))).alias("suffix")
    )
    return regions.unionByName(fixed)


def _sibling_answers(spark, sf):
    n = (F.col("o_custkey") % 400).alias("n")
    kinds = F.array(*[F.lit(o) for o in ("mail-capable", "no-mail", "unreachable")])
    seen = I.table(spark, sf, "orders").select(n).distinct()
    return seen.select(
        F.concat(F.lit("emp"), F.col("n").cast("string"), F.lit(".cl")).alias("sibling"),
        F.get(kinds, (F.col("n") % 3).cast("int")).alias("outcome"),
        F.concat(F.lit("d"), F.col("n").cast("string")).alias("detail"),
        (F.col("n") / 8.0).alias("seconds"),
    )


def _sibling_probes(spark, sf):
    return E.sibling_outcomes(
        _hosts(spark, sf), _suffixes(spark, sf), _sibling_answers(spark, sf)
    )


@query("plan_sibling_measure", "WITH " + _SIBLING_SQL + "SELECT outcome, count(*) AS n FROM probe GROUP BY outcome")
def plan_sibling_measure(spark, sf):
    run = measures.sibling_measure(
        _hosts(spark, sf), _suffixes(spark, sf), _sibling_answers(spark, sf)
    )
    return run["counts"]


@query("join_7_longest_suffix", "WITH " + _SIBLING_SQL + "SELECT seq, host, base FROM named")
def join_7(spark, sf):
    return E.base_labels(_hosts(spark, sf), _suffixes(spark, sf)).select("seq", "host", "base")


@query("join_8_sibling_observation", "WITH " + _SIBLING_SQL + "SELECT * FROM probe")
def join_8(spark, sf):
    return _sibling_probes(spark, sf)


@query(
    "agg_14_outcome_counts",
    "WITH " + _SIBLING_SQL + "SELECT outcome, count(*) AS n FROM probe GROUP BY outcome",
)
def agg_14(spark, sf):
    return E.outcome_counts(_sibling_probes(spark, sf))


_YES = wilson_sql("yes", "answered")


@query(
    "agg_14_outcome_report",
    "WITH " + _SIBLING_SQL
    + f""", u AS (SELECT sibling, arg_min(outcome, seq) AS outcome FROM probe WHERE sibling <> '' GROUP BY sibling),
    c AS (SELECT count(*) AS distinct_domains, count(*) FILTER (outcome = 'mail-capable') AS yes,
      count(*) FILTER (outcome = 'no-mail') AS no, count(*) FILTER (outcome = 'unreachable') AS non_response,
      count(*) FILTER (outcome IN ('mail-capable', 'no-mail')) AS answered FROM u)
    SELECT *, {_YES[0]} AS low, {_YES[1]} AS high, (SELECT count(*) FROM probe) AS rows FROM c
    """,
)
def agg_14_report(spark, sf):
    report = E.outcome_report(_sibling_probes(spark, sf), "mail-capable", "no-mail")
    return report.withColumn("low", F.round("low", 9)).withColumn("high", F.round("high", 9))


# --- keyservers ------------------------------------------------------------------------

_KEY_SQL = """
k AS (
  SELECT o_orderkey, 'd' || (o_custkey % 300) || '.cl' AS domain,
    ['company', 'university', 'municipality'][o_custkey % 300 % 3 + 1] AS entity,
    CASE WHEN o_orderkey % 2 = 0 THEN 'ubuntu' ELSE 'mit' END AS server,
    ['ok', 'none', 'http 500', 'ok', 'error: x'][o_orderkey % 5 + 1] AS outcome,
    CASE WHEN o_orderkey % 5 IN (0, 3) THEN ['a' || (o_orderkey % 4), 'b'] ELSE [] END AS who
  FROM orders),
addr AS (SELECT DISTINCT domain, server, entity, unnest(who) || '@' || domain AS address FROM k)
"""


def _key_rows(spark, sf):
    k = F.col("o_orderkey")
    d = F.col("o_custkey") % 300
    domain = F.concat(F.lit("d"), d.cast("string"), F.lit(".cl"))
    kinds = F.array(*[F.lit(o) for o in ("ok", "none", "http 500", "ok", "error: x")])
    entities = F.array(*[F.lit(e) for e in ("company", "university", "municipality")])
    found = F.when(
        (k % 5).isin(0, 3),
        F.concat(F.lit("a"), (k % 4).cast("string"), F.lit("@"), domain, F.lit(" b@"), domain),
    ).otherwise("")
    return I.table(spark, sf, "orders").select(
        domain.alias("domain"),
        F.get(entities, (d % 3).cast("int")).alias("entity"),
        F.when(k % 2 == 0, "ubuntu").otherwise("mit").alias("server"),
        F.get(kinds, (k % 5).cast("int")).alias("outcome"),
        found.alias("addresses"),
    )


@query(
    "agg_6_domain_union",
    "WITH " + _KEY_SQL
    + """
    SELECT domain, count(DISTINCT address) AS addresses
    FROM (SELECT DISTINCT domain FROM k) LEFT JOIN addr USING (domain) GROUP BY domain
    """,
)
def agg_6(spark, sf):
    return E.domain_union(_key_rows(spark, sf))


@query("set_4_server_union", "WITH " + _KEY_SQL + "SELECT DISTINCT domain, address FROM addr")
def set_4(spark, sf):
    return E.found_addresses(_key_rows(spark, sf))


@query(
    "agg_7_per_server",
    "WITH " + _KEY_SQL
    + """
    SELECT server, (SELECT count(DISTINCT address) FROM addr a WHERE a.server = k.server) AS addresses,
      count(*) FILTER (outcome NOT IN ('ok', 'none')) AS failed FROM k GROUP BY server
    """,
)
def agg_7(spark, sf):
    return E.per_server(_key_rows(spark, sf))


_ENTITY_SQL = """
SELECT entity, count(*) AS domains, count(*) FILTER (n > 0) AS with_addresses, sum(n)::BIGINT AS addresses
FROM (SELECT domain, any_value(k.entity) AS entity, count(DISTINCT address) AS n
      FROM k LEFT JOIN addr USING (domain) GROUP BY domain) GROUP BY entity
"""


@query("agg_8_by_entity", "WITH " + _KEY_SQL + _ENTITY_SQL)
def agg_8(spark, sf):
    return E.by_entity(_key_rows(spark, sf))


@query(
    "join_13_entity_of_domain",
    "WITH " + _KEY_SQL
    + """
    SELECT domain, any_value(k.entity) AS entity, count(DISTINCT address) AS addresses
    FROM k LEFT JOIN addr USING (domain) GROUP BY domain
    """,
)
def join_13(spark, sf):
    rows = _key_rows(spark, sf)
    kinds = rows.select("domain", "entity").distinct()
    return E.domain_union(rows).join(kinds, "domain")


_LIVE = wilson_sql("live", "verified")


_GATE_SQL = (
    "WITH " + _KEY_SQL + "," + CLASSIFIED_SQL
    + f""", t AS (SELECT count(*) AS requests, count(*) FILTER (outcome IN ('ok', 'none')) AS answered,
        (SELECT count(DISTINCT address) FROM addr) AS addresses FROM k),
    v AS (SELECT count(*) AS verified, count(*) FILTER (status <> 'invalid') AS live FROM verdict),
    b AS (SELECT *, addresses / greatest(1, answered)::DOUBLE AS rate, {_LIVE[0]} AS low, {_LIVE[1]} AS high FROM t, v)
    SELECT requests, answered, addresses, round(rate, 6) AS per_request, verified, live,
      round(low, 6) AS low, round(high, 6) AS high, round(rate * live / verified, 6) AS point,
      round(rate * low, 6) AS point_low, round(rate * high, 6) AS point_high,
      rate * low >= 0.65 AS clears_gate FROM b
    """
)


@query("agg_18_yield_gate", _GATE_SQL)
def agg_18(spark, sf):
    return _shown(E.yield_gate(E.keyserver_totals(_key_rows(spark, sf)), classified(spark, sf)))


def _shown(gate):
    shown = ["per_request", "low", "high", "point", "point_low", "point_high"]
    return gate.select(
        *[F.round(c, 6).alias(c) if c in shown else F.col(c) for c in gate.columns]
    )


# --- samples ------------------------------------------------------------------------------


@query(
    "top_7_seeded_sample",
    """
    SELECT c_custkey, c_name FROM customer
    ORDER BY md5('20260726' || c_custkey::VARCHAR), c_custkey LIMIT 60
    """,
)
def top_7(spark, sf):
    return E.seeded_sample(
        I.table(spark, sf, "customer"), "c_custkey", 20260726, 60
    ).select("c_custkey", "c_name")


# --- runs ---------------------------------------------------------------------------------


@query("plan_keyserver_measure", _GATE_SQL)
def plan_keyserver_measure(spark, sf):
    run = measures.keyserver_measure(_key_rows(spark, sf), classified(spark, sf))
    return _shown(run["gate"])
