"""Queries on readers, organisations and seed discovery."""

from pyspark.sql import Window, functions as F

from pagelens.catalog import inputs as I
from pagelens.catalog.base import query
from pagelens.functions import fixed_values as V, text, urls
from pagelens.operators import discovery as D
from pagelens.operators.shared import cut, scratch_path, taken
from pagelens.plans import measures, scan
from pagelens.sources import readers

# --- readers ---------------------------------------------------------------------

_LINES_SQL = """
WITH l AS (
  SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '   '
    WHEN 2 THEN '# nota ' || o_orderkey WHEN 3 THEN '  #otra' ELSE '  https://s.cl/' || o_orderkey || ' ' END AS value
  FROM orders)
"""


def _lines(spark, sf):
    k = F.col("o_orderkey")
    line = (
        F.when(k % 5 == 0, "")
        .when(k % 5 == 1, "   ")
        .when(k % 5 == 2, F.concat(F.lit("# nota "), k.cast("string")))
        .when(k % 5 == 3, "  #otra")
        .otherwise(F.concat(F.lit("  https://s.cl/"), k.cast("string"), F.lit(" ")))
    )
    return I.table(spark, sf, "orders").select(k.alias("k"), line.alias("value"))


@query("src_2_line_list", _LINES_SQL + "SELECT k, trim(value) AS value FROM l WHERE k % 5 = 4")
def src_2(spark, sf):
    path = scratch_path(spark, "src2")
    _lines(spark, sf).select("value").write.text(path)
    found = readers.read_line_list(spark, path).select(
        F.regexp_extract("value", r"(\d+)$", 1).cast("bigint").alias("k"), "value"
    )
    return taken(found, path)


@query(
    "src_2_line_list_documents",
    r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents)
    SELECT doc_id, count(*) AS lines FROM l
    WHERE regexp_replace(value, '^\s+|\s+$', '', 'g') <> ''
      AND regexp_replace(value, '^\s+|\s+$', '', 'g') NOT LIKE '#%' GROUP BY doc_id
    """,
)
def src_2_documents(spark, sf):
    lines = I.table(spark, sf, "documents", "doc_id").select(
        "doc_id", F.explode(F.split("text", "\n")).alias("value")
    )
    return readers.lines_of(lines).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "src_3_address_list",
    """
    SELECT o_orderkey AS k, 'a' || o_orderkey || '@b.cl' AS email,
      CASE WHEN o_orderkey % 4 = 2 THEN 'https://s.cl/x' ELSE '' END AS source
    FROM orders WHERE o_orderkey % 4 <> 3
    """,
)
def src_3(spark, sf):
    k = F.col("o_orderkey")
    mail = F.concat(F.lit("a"), k.cast("string"), F.lit("@b.cl"))
    line = (
        F.when(k % 4 == 0, F.concat(F.lit(" "), mail))
        .when(k % 4 == 1, F.concat(mail, F.lit("\tvalid")))
        .when(k % 4 == 2, F.concat(mail, F.lit(" \tvalid\t https://s.cl/x ")))
        .otherwise(F.concat(F.lit("# "), mail))
    )
    path = scratch_path(spark, "src3")
    I.table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    found = readers.read_address_list(spark, path).select(
        F.regexp_extract("email", r"^a(\d+)", 1).cast("bigint").alias("k"), "email", "source"
    )
    return taken(found, path)


_CT_SQL = """
raw AS (
  SELECT s_suppkey, o_orderkey AS seq, pos, name FROM (
    SELECT s_nationkey AS s_suppkey, o_orderkey,
      unnest(CASE WHEN o_orderkey % 3 = 0 THEN ['d' || s_nationkey || '.cl', '*.d' || s_nationkey || '.cl']
        WHEN o_orderkey % 3 = 1 THEN ['MAIL.d' || s_nationkey || '.CL', ' w' || (o_orderkey % 9) || '.d' || s_nationkey || '.cl']
        ELSE ['other.org'] END) AS name,
      unnest(CASE WHEN o_orderkey % 3 = 2 THEN [0] ELSE [0, 1] END) AS pos
    FROM orders, (SELECT DISTINCT s_nationkey FROM supplier) s WHERE o_custkey % 25 = s_nationkey)),
named AS (
  SELECT 'd' || s_suppkey || '.cl' AS domain, seq, pos, lower(trim(name)) AS host FROM raw),
under AS (
  SELECT domain, host, min(seq * 10 + pos) AS ord FROM named
  WHERE host NOT LIKE '%*%' AND ends_with(host, domain) GROUP BY domain, host)
"""


def _records(spark, sf):
    """Certificate records per domain, names packed one per line."""
    nations = I.table(spark, sf, "supplier").select("s_nationkey").distinct()
    o = I.table(spark, sf, "orders").withColumn(
        "s_nationkey", (F.col("o_custkey") % 25).cast("int")
    )
    k, n = F.col("o_orderkey"), F.col("s_nationkey").cast("string")
    own = F.concat(F.lit("d"), n, F.lit(".cl"))
    packed = (
        F.when(k % 3 == 0, F.concat(own, F.lit("\n*."), own))
        .when(
            k % 3 == 1,
            F.concat(
                F.lit("MAIL.d"), n, F.lit(".CL\r\n w"), (k % 9).cast("string"), F.lit("."), own
            ),
        )
        .otherwise("other.org")
    )
    return o.join(nations, "s_nationkey").select(
        own.alias("domain"), k.alias("seq"), packed.alias("name_value")
    )


@query(
    "src_4_ct_crtsh",
    "WITH " + _CT_SQL + "SELECT 'd' || s_suppkey || '.cl' AS domain, 0 AS source_order, pos, name FROM raw",
)
def src_4(spark, sf):
    path = scratch_path(spark, "src4")
    _records(spark, sf).select("domain", "name_value").write.json(path)
    names = readers.read_ct_crtsh(spark, path, lines=True)
    return taken(names.select("domain", "source_order", "pos", "name"), path)


@query(
    "src_5_ct_certspotter",
    """
    SELECT 'd' || o_orderkey AS domain, 1 AS source_order, unnest(CASE WHEN o_orderkey % 2 = 0
      THEN ['a' || o_orderkey || '.cl', 'b.cl'] ELSE [] END) AS name FROM orders
    """,
)
def src_5(spark, sf):
    k = F.col("o_orderkey")
    names = F.when(
        k % 2 == 0, F.array(F.concat(F.lit("a"), k.cast("string"), F.lit(".cl")), F.lit("b.cl"))
    )
    path = scratch_path(spark, "src5")
    own = F.concat(F.lit("d"), k.cast("string"))
    I.table(spark, sf, "orders").select(
        own.alias("domain"), names.alias("dns_names")
    ).write.json(path)
    found = readers.read_ct_certspotter(spark, path, lines=True)
    return taken(found.select("domain", "source_order", "name"), path)


@query("flt_5_host_under", "WITH " + _CT_SQL + "SELECT domain, host, ord FROM under")
def flt_5(spark, sf):
    names = readers.packed_names(_records(spark, sf), ["domain", "seq"])
    hosts = D.hosts_under(names, F.col("domain"), ["seq", "pos"], ["domain"])
    return hosts.select("domain", "host", (F.col("seq") * 10 + F.col("pos")).alias("ord"))


@query(
    "src_7_suffix_rules",
    """
    SELECT o_orderkey AS k, 's' || o_orderkey || '.uk' AS suffix
    FROM orders WHERE o_orderkey % 3 = 2
    """,
)
def src_7(spark, sf):
    k = F.col("o_orderkey")
    line = (
        F.when(k % 3 == 0, "// ===BEGIN===")
        .when(k % 3 == 1, " ")
        .otherwise(F.concat(F.lit("s"), k.cast("string"), F.lit(".uk ")))
    )
    path = scratch_path(spark, "src7")
    I.table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    rules = readers.read_suffix_rules(spark, path).select(
        F.regexp_extract("suffix", r"(\d+)", 1).cast("bigint").alias("k"), "suffix"
    )
    return taken(rules, path)


@query(
    "src_8_search_results",
    """
    WITH u AS (SELECT c_custkey AS k, unnest([
        'https://www.nunoa.cl/p' || (c_custkey % 40), 'http://otro.cl/?u=nunoa.cl&n=' || (c_custkey % 30),
        'https://ajeno.cl/x']) AS url FROM customer)
    SELECT url, min(k) AS k FROM u WHERE contains(url, 'nunoa.cl') GROUP BY url
    """,
)
def src_8(spark, sf):
    k = F.col("c_custkey")
    body = F.concat(
        F.lit('<a href="https://www.nunoa.cl/p'), (k % 40).cast("string"),
        F.lit('">uno</a> http://otro.cl/?u=nunoa.cl&n='), (k % 30).cast("string"),
        F.lit(" <b>https://ajeno.cl/x</b> https://nunoa.com/z"),
    )
    saved = I.table(spark, sf, "customer").select(k.alias("k"), body.alias("body"))
    return D.search_result_urls(saved, F.col("body"), "nunoa.cl", ["k"]).select("url", "k")


@query(
    "src_8_found_seeds",
    """
    WITH u AS (SELECT c_nationkey % 3 AS n, c_custkey AS k,
        unnest(['https://www.s' || (c_nationkey % 3) || '.cl/p' || (c_custkey % 40),
                'https://ajeno.cl/?d=s' || (c_nationkey % 3) || '.cl&n=' || (c_custkey % 7)]) AS url,
        unnest([0, 1]) AS pos FROM customer),
    f AS (SELECT n, url, min(k * 2 + pos) AS at_ FROM u GROUP BY n, url),
    r AS (SELECT 's' || n || '.cl' AS domain, url, row_number() OVER (PARTITION BY n ORDER BY at_) AS rank FROM f)
    SELECT domain, url, rank FROM r WHERE rank <= 20
    """,
)
def src_8_seeds(spark, sf):
    """The first results of each domain, ready for seed discovery."""
    k = F.col("c_custkey")
    domain = F.concat(F.lit("s"), (F.col("c_nationkey") % 3).cast("string"), F.lit(".cl"))
    body = F.concat(
        F.lit('<a href="https://www.'), domain, F.lit("/p"), (k % 40).cast("string"),
        F.lit('">uno</a> https://ajeno.cl/?d='), domain, F.lit("&n="), (k % 7).cast("string"),
        F.lit(" https://nada.cl/z"),
    )
    saved = I.table(spark, sf, "customer").select(
        domain.alias("domain"), k.alias("k"), body.alias("body")
    )
    return D.found_seeds(saved, F.col("body"), ["k"])


@query(
    "src_8_saved_pages",
    """
    WITH u AS (SELECT c_nationkey % 3 AS n, c_custkey % 25 AS k, c_custkey,
        unnest(['https://www.s' || (c_nationkey % 3) || '.cl/p' || (c_custkey % 40) || repeat('/', c_custkey % 2),
                'https://ajeno.cl/?d=s' || (c_nationkey % 3) || '.cl&n=' || (c_custkey % 7)]) AS url,
        unnest([0, 1]) AS pos FROM customer WHERE c_custkey % 25 <> 4),
    f AS (SELECT n, rtrim(url, '/') AS url, min(struct_pack(k := k, c := c_custkey, p := pos)) AS at_ FROM u GROUP BY ALL),
    r AS (SELECT 's' || n || '.cl' AS domain, url, row_number() OVER (PARTITION BY n ORDER BY at_) AS place FROM f)
    SELECT domain, url, place FROM r WHERE place <= 20
    """,
)
def src_8_saved(spark, sf):
    """Result pages saved as files, read into seed discovery.

    The fifth page of every search was refused; it is saved with its headers.
    """
    folder = scratch_path(spark, "src8")
    c = F.col("c_custkey")
    domain = F.concat(F.lit("s"), (F.col("c_nationkey") % 3).cast("string"), F.lit(".cl"))
    links = F.concat(
        F.lit('<a href="https://www.'), domain, F.lit("/p"), (c % 40).cast("string"),
        F.repeat(F.lit("/"), (c % 2).cast("int")),
        F.lit('">uno</a> https://ajeno.cl/?d='), domain, F.lit("&n="), (c % 7).cast("string"), F.lit(" "),
    )
    saved = I.table(spark, sf, "customer").groupBy(domain.alias("domain"), (c % 25).alias("k")).agg(
        F.array_sort(F.collect_list(F.struct(c.alias("c"), links.alias("links")))).alias("all")
    )
    body = F.array_join(F.transform("all", lambda x: x["links"]), "")
    head = F.when(F.col("k") == 4, "HTTP/1.1 429 Too Many\r\nRetry-After: 9\r\n\r\n").otherwise("")
    saved.select("domain", "k", F.concat(head, body).alias("value")).repartition(
        1, "domain", "k"
    ).write.partitionBy("domain", "k").option("lineSep", "\n").text(folder)
    pages = readers.read_saved_searches(spark, folder, ("domain", "k", None))
    none = {
        "names": "domain STRING, source_order INT, seq BIGINT, pos INT, name STRING",
        "asked": "domain STRING, source_order INT, answered BOOLEAN",
        "probes": "host STRING, resolved BOOLEAN, http_status INT",
        "pages": "url STRING, html STRING",
    }
    seeds = scan.discover_seeds(
        pages.select("domain").distinct(),
        **{name: spark.createDataFrame([], schema) for name, schema in none.items()},
        found_urls=D.found_seeds(pages, F.col("body"), ["k"]),
    )
    w = Window.partitionBy("domain").orderBy("stage", "rank")
    placed = seeds.select("domain", "url", F.row_number().over(w).cast("bigint").alias("place"))
    return taken(placed, folder)


_SAVED_INDEX_SQL = """
WITH k AS (SELECT o_orderkey, o_custkey % 40 AS d, CASE WHEN o_orderkey % 2 = 0 THEN 'ubuntu' ELSE 'mit' END AS server FROM orders),
a AS (SELECT DISTINCT server, d, unnest(['ana' || (o_orderkey % 9) || '@d' || d || '.cl', 'x@mail.d' || d || '.cl']) AS address
      FROM k WHERE d % 5 >= 3)
"""


@query(
    "src_10_saved_pages",
    _SAVED_INDEX_SQL
    + """
    SELECT server, (SELECT count(DISTINCT address) FROM a WHERE a.server = k.server) AS addresses,
      count(DISTINCT d) FILTER (d % 5 IN (1, 2)) AS failed FROM k GROUP BY server
    """,
)
def src_10_saved(spark, sf):
    """Index pages saved as files, read into the keyserver measure.

    Of five domains one was answered with 404, one with 500, one not at all;
    the others were saved with or without their headers.
    """
    folder = scratch_path(spark, "src10")
    k, d = F.col("o_orderkey"), F.col("d")
    domain = F.concat(F.lit("d"), d.cast("string"), F.lit(".cl"))
    asked = I.table(spark, sf, "orders").select(
        k, (F.col("o_custkey") % 40).alias("d"), F.when(k % 2 == 0, "ubuntu").otherwise("mit").alias("server")
    )
    line = F.concat(
        F.lit("<pre>ANA"), (k % 9).cast("string"), F.lit("@"), domain, F.lit("&gt; x@mail."),
        domain, F.lit(" otro@ajeno.cl</pre> "),
    )
    saved = asked.groupBy("server", "d").agg(F.array_join(F.array_sort(F.collect_set(line)), "").alias("lines"))
    head = F.when(d % 5 == 3, "HTTP/1.1 301 Moved\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\n").otherwise("")
    content = (
        F.when(d % 5 == 0, F.concat(F.lit("HTTP/1.1 404 Not Found\r\n\r\n"), F.col("lines")))
        .when(d % 5 == 1, "HTTP/1.1 500 Error\r\nA: b\r\n\r\n")
        .when(d % 5 == 2, "")
        .otherwise(F.concat(head, F.col("lines")))
    )
    saved.select("server", domain.alias("domain"), content.alias("value")).repartition(
        1, "server", "domain"
    ).write.partitionBy("server", "domain").option("lineSep", "\n").text(folder)
    pages = readers.read_keyserver_pages(spark, folder, ("server", "domain", None))
    rows = cut(readers.keyserver_rows(pages)).withColumn("entity", F.lit("company"))
    verdicts = spark.createDataFrame([], "email STRING, status STRING")
    return taken(measures.keyserver_measure(rows, verdicts)["servers"], folder)


@query(
    "src_10_keyserver_index",
    """
    SELECT o_orderkey AS k, 'b' || (o_custkey % 9) || '.cl' AS domain,
      CASE WHEN o_orderkey % 4 = 0 THEN 'none' WHEN o_orderkey % 4 = 1 THEN 'http 500' ELSE 'ok' END AS outcome,
      CASE WHEN o_orderkey % 4 < 2 THEN 0 ELSE 2 END AS count,
      CASE WHEN o_orderkey % 4 < 2 THEN '' ELSE 'ana@b' || (o_custkey % 9) || '.cl x'
        || o_orderkey || '@mail.b' || (o_custkey % 9) || '.cl' END AS addresses
    FROM orders
    """,
)
def src_10(spark, sf):
    k = F.col("o_orderkey")
    domain = F.concat(F.lit("b"), (F.col("o_custkey") % 9).cast("string"), F.lit(".cl"))
    body = F.concat(
        F.lit("<pre>Ana &lt;ANA@"), F.upper(domain), F.lit("&gt; x"), k.cast("string"),
        F.lit("@mail."), domain, F.lit(" ana@"), domain, F.lit(" otro@ajeno.cl y@bx"),
        domain, F.lit("</pre>"),
    )
    status = F.when(k % 4 == 0, 404).when(k % 4 == 1, 500).otherwise(200)
    saved = I.table(spark, sf, "orders").select(
        k.alias("k"), domain.alias("domain"), status.alias("status"), body.alias("body")
    )
    return readers.keyserver_rows(saved)


_TARGET_VALUES = ", ".join(
    "('{}', {})".format(c, "NULL" if d is None else f"'{d}'") for c, d in V.TARGETS
)
_TARGETS_SQL = f"""
WITH t(comuna, domain) AS (VALUES {_TARGET_VALUES}),
wanted AS (SELECT DISTINCT CASE WHEN n_nationkey % 5 = 0 THEN 'nadie ' || n_nationkey
    ELSE (['Ñuñoa', 'MAIPÚ', 'renca', 'Padre Hurtado', 'buin', 'Colina'])[n_nationkey % 6 + 1] END AS name
  FROM nation)
"""


def _wanted(spark, sf):
    k = F.col("n_nationkey")
    names = F.array(
        *[F.lit(n) for n in ("Ñuñoa", "MAIPÚ", "renca", "Padre Hurtado", "buin", "Colina")]
    )
    return I.table(spark, sf, "nation").select(
        F.when(k % 5 == 0, F.concat(F.lit("nadie "), k.cast("string")))
        .otherwise(F.get(names, (k % 6).cast("int")))
        .alias("name")
    )


@query(
    "src_11_target_list",
    _TARGETS_SQL
    + """
    SELECT comuna AS name, coalesce(domain, '') AS domain, true AS known FROM t
    WHERE lower(comuna) IN (SELECT lower(name) FROM wanted)
    UNION ALL SELECT DISTINCT lower(name), '', false FROM wanted
    WHERE lower(name) NOT IN (SELECT lower(comuna) FROM t)
    """,
)
def src_11(spark, sf):
    chosen, unknown = D.select_targets(readers.target_list(spark), _wanted(spark, sf))
    return chosen.select(
        F.col("comuna").alias("name"),
        F.coalesce("domain", F.lit("")).alias("domain"),
        F.lit(True).alias("known"),
    ).unionByName(
        unknown.select("name", F.lit("").alias("domain"), F.lit(False).alias("known"))
    )


# --- organisations --------------------------------------------------------------------

_ORGS = ["muni{n}.cl", "ministerio{n}.cl", "UChile{n}.cl ", "tienda{n}.com", "nunoa.cl",
         "huachipatofc.cl", "gobernacion{n}.gob.cl", "senado.cl"]
_ORG_SQL = """
WITH o AS (SELECT c_custkey AS k, replace(([{names}])[c_custkey % 8 + 1], '{{n}}', (c_custkey % 100)::VARCHAR) AS domain
  FROM customer)
""".format(names=", ".join(f"'{o}'" for o in _ORGS))
_ENTITY_OF = (
    "(['municipality', 'government', 'university', 'company', 'municipality', "
    "'university', 'municipality', 'government'])[k % 8 + 1]"
)


def _orgs(spark, sf):
    k = F.col("c_custkey")
    name = F.get(F.array(*[F.lit(o) for o in _ORGS]), (k % 8).cast("int"))
    return I.table(spark, sf, "customer").select(
        k.alias("k"),
        F.replace(name, F.lit("{n}"), (k % 100).cast("string")).alias("domain"),
    )


def _municipalities(spark):
    return readers.target_list(spark).filter("domain IS NOT NULL").select("domain")


@query("sca_28_entity", _ORG_SQL + f"SELECT k, {_ENTITY_OF} AS entity FROM o")
def sca_28(spark, sf):
    return D.with_entity(_orgs(spark, sf)).select("k", "entity")


# Municipalities in and outside the regional targets, with other names between.
_PLACES = [
    ("angol.cl", "municipality"), ("caldera.cl", "municipality"), ("nunoa.cl", "municipality"),
    ("rapanui.net", "municipality"), ("web.molina.cl", "municipality"), ("minsal.cl", "government"),
    ("usach.cl", "university"), ("bhp.cl", "company"), ("impa.gob.cl", "municipality"),
    ("angol.com", "company"), ("villarrica.org", "municipality"),
]


@query(
    "sca_28_listed_entity",
    """
    WITH place(i, domain, entity) AS (VALUES {places})
    SELECT c_custkey AS k, domain, entity FROM customer JOIN place ON c_custkey % {n} = i
    """.format(
        n=len(_PLACES), places=", ".join(f"({i}, '{d}', '{e}')" for i, (d, e) in enumerate(_PLACES))
    ),
)
def sca_28_listed(spark, sf):
    name = F.get(F.array(*[F.lit(d) for d, _ in _PLACES]), (F.col("c_custkey") % len(_PLACES)).cast("int"))
    orgs = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), name.alias("domain"))
    return D.with_entity(orgs).select("k", "domain", "entity")


@query(
    "join_1_municipality",
    _ORG_SQL + "SELECT k, domain FROM o WHERE domain = 'nunoa.cl'",
)
def join_1(spark, sf):
    listed = _municipalities(spark)
    return _orgs(spark, sf).join(listed, "domain", "left_semi").select("k", "domain")


@query(
    "job_entity_type",
    _ORG_SQL
    + "SELECT entity, count(*) AS domains FROM "
    + f"(SELECT {_ENTITY_OF} AS entity FROM o) GROUP BY entity",
)
def job_entity_type(spark, sf):
    return (
        D.with_entity(_orgs(spark, sf))
        .groupBy("entity")
        .agg(F.count(F.lit(1)).alias("domains"))
    )


@query(
    "sca_30_domain_norm",
    "SELECT c_custkey AS k, lower(c_mktsegment) || '.cl' AS domain FROM customer",
)
def sca_30(spark, sf):
    raw = F.concat(F.lit("@@"), F.col("c_mktsegment"), F.lit(".CL \t\n"))
    return I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"), urls.domain_norm(raw).alias("domain")
    )


_QUERY_VALUES = ", ".join(
    "('{}', {}, '{}')".format(e, i, t)
    for e, lines in V.SEARCH_QUERIES.items()
    for i, t in enumerate(lines)
)


@query(
    "sca_31_query_texts",
    _ORG_SQL
    + f""", q(entity, pos, t) AS (VALUES {_QUERY_VALUES}),
    e AS (SELECT k, lower(trim(domain)) AS name, {_ENTITY_OF} AS entity FROM o),
    d AS (SELECT DISTINCT name, entity FROM e),
    l AS (SELECT name, k, row_number() OVER (PARTITION BY name ORDER BY k) AS r FROM e)
    SELECT name AS domain, pos, replace(replace(t, '{{domain}}', '@' || name), '{{bare}}', name) AS query
    FROM d JOIN q USING (entity)
    UNION ALL SELECT name, 100 + k, 'site:h' || k || '.cl email correo contacto' FROM l WHERE r <= 3
    """,
)
def sca_31(spark, sf):
    orgs = _orgs(spark, sf).withColumn("domain", urls.domain_norm(F.col("domain")))
    kinds = D.with_entity(orgs.select("domain").distinct(), _municipalities(spark))
    live = orgs.select(
        "domain",
        F.concat(F.lit("https://h"), F.col("k").cast("string"), F.lit(".cl/x")).alias("url"),
        F.col("k").alias("rank"),
    )
    return D.query_texts(kinds, live)


_SLUG_NAMES = ["Ñuñoa", "San José de Maipo", "Curacaví 2", "Lo Prado", "Padre Hurtado"]


@query(
    "sca_32_slug",
    """
    SELECT c_custkey AS k, (['nunoa', 'sanjosedemaipo', 'curacavi2', 'loprado', 'padrehurtado'])
      [c_custkey % 5 + 1] || c_custkey AS slug FROM customer
    """,
)
def sca_32(spark, sf):
    k = F.col("c_custkey")
    name = F.get(F.array(*[F.lit(n) for n in _SLUG_NAMES]), (k % 5).cast("int"))
    return I.table(spark, sf, "customer").select(
        k.alias("k"), text.slug(F.concat(name, F.lit("-"), k.cast("string"))).alias("slug")
    )


@query(
    "join_11_first_candidate",
    """
    SELECT 'Villa ' || c_custkey AS comuna, CASE WHEN c_custkey % 6 = 0 THEN 'propio' || c_custkey || '.cl'
      WHEN c_custkey % 6 IN (1, 3) THEN 'munivilla' || c_custkey || '.cl'
      WHEN c_custkey % 6 = 2 THEN 'villa' || c_custkey || '.cl'
      ELSE 'mvilla' || c_custkey || '.cl' END AS domain
    FROM customer WHERE c_custkey % 6 <> 5
    """,
)
def join_11(spark, sf):
    k = F.col("c_custkey")
    n = k.cast("string")
    customer = I.table(spark, sf, "customer")
    targets = customer.select(
        F.concat(F.lit("Villa "), n).alias("comuna"),
        F.when(k % 6 == 0, F.concat(F.lit("propio"), n, F.lit(".cl"))).alias("domain"),
    )
    prefixes = (
        F.when(k % 6 == 1, F.array(F.lit("muni")))
        .when(k % 6 == 2, F.array(F.lit("")))
        .when(k % 6 == 3, F.array(F.lit("m"), F.lit("im"), F.lit("muni")))
        .when(k % 6 == 4, F.array(F.lit("m")))
    )
    live = customer.select(n.alias("n"), F.explode(prefixes).alias("p")).select(
        F.concat("p", F.lit("villa"), "n", F.lit(".cl")).alias("host")
    )
    return D.resolve_targets(targets, live)


# --- seeds ------------------------------------------------------------------------------

_PROBE_SQL = """
probe AS (SELECT o_orderkey AS k, 'h' || o_orderkey || '.cl' AS host, o_orderkey % 3 > 0 AS resolved,
  CASE o_orderkey % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 503 END AS http_status FROM orders)
"""


@query(
    "flt_11_live_hosts",
    "WITH " + _PROBE_SQL + "SELECT host, 'https://' || host AS url FROM probe WHERE resolved AND http_status < 500",
)
def flt_11(spark, sf):
    k = F.col("o_orderkey")
    probes = I.table(spark, sf, "orders").select(
        F.concat(F.lit("h"), k.cast("string"), F.lit(".cl")).alias("host"),
        (k % 3 > 0).alias("resolved"),
        F.when(k % 4 == 0, 200).when(k % 4 == 1, 404).when(k % 4 == 2, 503).alias("http_status"),
    )
    return D.live_hosts(probes.select("host"), probes)


_FALLBACK_SQL = "WITH " + _CT_SQL + """
, asked AS (SELECT domain, s AS source_order,
    CASE s WHEN 0 THEN length(domain) % 2 = 0 ELSE domain <> 'd7.cl' END AS answered
  FROM (SELECT DISTINCT domain FROM named), (VALUES (0), (1)) v(s)),
found AS (
  SELECT domain, 0 AS source_order, host FROM under WHERE host LIKE 'w%'
  UNION ALL SELECT domain, 1, host FROM under WHERE domain <> 'd4.cl'),
usable AS (SELECT f.* FROM found f JOIN asked a USING (domain, source_order) WHERE a.answered),
chosen AS (SELECT domain, min(source_order) AS source_order FROM usable GROUP BY domain)
SELECT a.domain, bool_or(a.answered) AS answered, any_value(h.n) AS hosts, any_value(h.source_order) AS source_order
FROM asked a LEFT JOIN (SELECT domain, source_order, count(*) AS n FROM usable JOIN chosen
   USING (domain, source_order) GROUP BY ALL) h USING (domain) GROUP BY a.domain
"""


@query("win_7_source_fallback", _FALLBACK_SQL)
def win_7(spark, sf):
    names = readers.packed_names(_records(spark, sf), ["domain", "seq"])
    hosts = D.hosts_under(names, F.col("domain"), ["seq", "pos"], ["domain"])
    first = hosts.filter(F.col("host").startswith("w")).withColumn("source_order", F.lit(0))
    second = hosts.filter("domain <> 'd4.cl'").withColumn("source_order", F.lit(1))
    asked = names.select("domain").distinct().select(
        "domain", F.explode(F.array(F.lit(0), F.lit(1))).alias("source_order")
    ).withColumn(
        "answered",
        F.when(F.col("source_order") == 0, F.length("domain") % 2 == 0).otherwise(
            F.col("domain") != "d7.cl"
        ),
    )
    chosen = D.source_fallback(first.unionByName(second), asked)
    return chosen.groupBy("domain").agg(
        F.bool_or("answered").alias("answered"),
        F.nullif(F.count("host"), F.lit(0)).alias("hosts"),
        F.max("source_order").alias("source_order"),
    )


@query(
    "set_5_base_hosts",
    "WITH " + _CT_SQL
    + """
    , d AS (SELECT DISTINCT domain FROM named),
    ranked AS (SELECT domain, host, row_number() OVER (PARTITION BY domain ORDER BY ord) AS r FROM under)
    SELECT domain, host, r AS rank FROM ranked
    UNION ALL SELECT domain, 'www.' || domain, -2 FROM d
      WHERE NOT EXISTS (SELECT 1 FROM under u WHERE u.domain = d.domain AND u.host = 'www.' || d.domain)
    UNION ALL SELECT domain, domain, -1 FROM d
      WHERE NOT EXISTS (SELECT 1 FROM under u WHERE u.domain = d.domain AND u.host = d.domain)
    """,
)
def set_5(spark, sf):
    names = readers.packed_names(_records(spark, sf), ["domain", "seq"])
    hosts = D.hosts_under(names, F.col("domain"), ["seq", "pos"], ["domain"])
    w = Window.partitionBy("domain").orderBy("seq", "pos")
    ranked = hosts.withColumn("rank", F.row_number().over(w))
    return D.base_hosts(ranked, names.select("domain").distinct())


_STAGE_SQL = """
WITH s AS (
  SELECT 'd' || (o_custkey % 50) || '.cl' AS domain, o_orderkey % 3 AS stage, o_orderkey AS rank,
    rtrim('https://d' || (o_custkey % 50) || '.cl/' || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'p' || (o_orderkey % 90) || '/' END, '/') AS url
  FROM orders),
first AS (SELECT domain, url, min(stage * 1000000000000 + rank) AS ord FROM s GROUP BY domain, url),
ranked AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ord) AS r FROM first)
"""


def _stages(spark, sf):
    k = F.col("o_orderkey")
    domain = F.concat(F.lit("d"), (F.col("o_custkey") % 50).cast("string"), F.lit(".cl"))
    page = F.when(k % 7 == 0, "").otherwise(
        F.concat(F.lit("p"), (k % 90).cast("string"), F.lit("/"))
    )
    rows = I.table(spark, sf, "orders").select(
        domain.alias("domain"),
        F.concat(F.lit("https://"), domain, F.lit("/"), page).alias("url"),
        k.alias("rank"),
    )
    return [rows.filter(F.col("rank") % 3 == s) for s in range(3)]


@query(
    "win_2_seed_cascade",
    _STAGE_SQL + "SELECT domain, url, ord // 1000000000000 AS stage, ord % 1000000000000 AS rank FROM ranked",
)
def win_2(spark, sf):
    return D.seed_cascade(_stages(spark, sf)).select(
        "domain", "url", F.col("stage").cast("bigint").alias("stage"), "rank"
    )


@query("top_2_max_seeds", _STAGE_SQL + "SELECT domain, url FROM ranked WHERE r <= 20")
def top_2(spark, sf):
    return D.seed_cascade(_stages(spark, sf), V.MAX_SEEDS).select("domain", "url")


@query(
    "top_3_caps",
    _STAGE_SQL
    + """
    , l AS (SELECT domain, url, rank, row_number() OVER (PARTITION BY domain ORDER BY rank) AS r
            FROM (SELECT domain, url, min(rank) AS rank FROM s WHERE stage = 0 GROUP BY ALL))
    SELECT domain, url, r <= 3 AS queried FROM l WHERE r <= 10
    """,
)
def top_3(spark, sf):
    live = D.seed_cascade(_stages(spark, sf)[:1]).select("domain", "url", "rank")
    scored = D.first_k(live, ["domain"], ["rank"], V.HOSTS_SCORED)
    asked = D.first_k(live, ["domain"], ["rank"], V.HOSTS_QUERIED).select(
        "domain", "url", F.lit(True).alias("queried")
    )
    return scored.join(asked, ["domain", "url"], "left").select(
        "domain", "url", F.coalesce("queried", F.lit(False)).alias("queried")
    )


@query(
    "flt_16_merge_seed_lists",
    """
    WITH a AS (SELECT 'https://s.cl/' || (o_orderkey % 5000) AS url, 0 AS stage, o_orderkey AS rank
        FROM orders WHERE o_orderkey % 2 = 0
      UNION ALL SELECT 'https://s.cl/' || (o_orderkey % 7000), 1, o_orderkey
        FROM orders WHERE o_orderkey % 2 = 1),
    f AS (SELECT url, min(stage * 1000000000000 + rank) AS ord FROM a GROUP BY url)
    SELECT url, ord // 1000000000000 AS stage, ord % 1000000000000 AS rank FROM f
    """,
)
def flt_16(spark, sf):
    k = F.col("o_orderkey")
    orders = I.table(spark, sf, "orders")
    found = orders.filter(k % 2 == 0).select(
        F.concat(F.lit("https://s.cl/"), (k % 5000).cast("string")).alias("url"), k.alias("rank")
    )
    extra = orders.filter(k % 2 == 1).select(
        F.concat(F.lit(" https://s.cl/"), (k % 7000).cast("string"), F.lit(" ")).alias("url"),
        k.alias("rank"),
    )
    return D.merge_seed_lists(found, extra).select(
        "url", F.col("stage").cast("bigint").alias("stage"), "rank"
    )


# --- whole seed run -------------------------------------------------------------------------

_RUN_SQL = """
WITH dom AS (SELECT c_custkey AS k, 'd' || c_custkey || '.cl' AS domain FROM customer),
host AS (
  SELECT k, domain, h, host FROM (SELECT k, domain, unnest([-2, -1, 1, 2]) AS h,
    unnest(['www.' || domain, domain, 'mail.' || domain, 'web.' || domain]) AS host FROM dom)),
live AS (SELECT domain, k, h, 'https://' || host AS url FROM host WHERE (k + h) % 3 <> 0),
link AS (
  SELECT l.domain, word AS url, score FROM live l, LATERAL (VALUES
    (l.url || '/contacto', 10), (l.url || '/empresa/x', 5)) v(word, score)
  WHERE l.h IN (-2, 1)),
seed AS (
  SELECT domain, url, 0 AS stage, h AS rank, 0 AS score FROM live
  UNION ALL SELECT domain, url, 1, 0, score FROM link
  UNION ALL SELECT domain, 'https://buscado.cl/' || domain, 2, 0, 0 FROM dom)
SELECT domain, url, row_number() OVER (PARTITION BY domain
   ORDER BY stage, rank, score DESC, url DESC) AS place FROM seed
QUALIFY place <= 6
"""


@query("job_seed_ranking", _RUN_SQL)
def job_seed_ranking(spark, sf):
    customer = I.table(spark, sf, "customer", "c_custkey")
    k = F.col("c_custkey")
    domain = F.concat(F.lit("d"), k.cast("string"), F.lit(".cl"))
    domains = customer.select(domain.alias("domain"))
    names = customer.select(
        domain.alias("domain"),
        F.lit(0).alias("source_order"),
        k.alias("seq"),
        F.posexplode(
            F.array(F.concat(F.lit("mail."), domain), F.concat(F.lit("WEB."), domain))
        ).alias("pos", "name"),
    )
    asked = customer.select(
        domain.alias("domain"), F.lit(0).alias("source_order"), F.lit(True).alias("answered")
    )
    places = F.array(
        *[
            F.struct(F.lit(h).alias("h"), F.concat(F.lit(p), domain).alias("host"))
            for h, p in ((-2, "www."), (-1, ""), (1, "mail."), (2, "web."))
        ]
    )
    probes = customer.select(k.alias("k"), F.explode(places).alias("p")).select(
        F.col("p.host").alias("host"),
        ((F.col("k") + F.col("p.h")) % 3 != 0).alias("resolved"),
        F.lit(200).alias("http_status"),
        F.col("p.h").alias("h"),
    )
    home = F.concat(F.lit("https://"), F.col("host"))
    pages = probes.filter("h IN (-2, 1)").select(
        home.alias("url"),
        F.concat(
            F.lit('<a href="/contacto">c</a><a href="/empresa/x/">e</a><a href="/contacto/">c</a>'),
            F.lit('<a href="/noticias">n</a><a href="https://otra.com/contacto?d='), F.col("host"),
            F.lit('">o</a>'),
        ).alias("html"),
    )
    searched = customer.select(
        domain.alias("domain"),
        F.concat(F.lit("https://buscado.cl/"), domain, F.lit("/")).alias("url"),
        F.lit(0).alias("rank"),
    )
    seeds = scan.discover_seeds(
        domains, names, asked, probes.drop("h"), pages, None, searched, max_seeds=6
    )
    w = Window.partitionBy("domain").orderBy("stage", "rank")
    return seeds.select("domain", "url", F.row_number().over(w).cast("bigint").alias("place"))


@query(
    "plan_regional_scan",
    "WITH " + I.CONTACT_SQL
    + """
    , t AS (SELECT k, 'muni' || (k % 4) AS comuna, email, url FROM published),
    d AS (SELECT 'muni' || n AS comuna, CASE n WHEN 0 THEN 'building.cl' WHEN 1 THEN 'machinery.cl'
       WHEN 2 THEN 'munimuni2.cl' END AS domain FROM (VALUES (0), (1), (2)) v(n))
    SELECT comuna, domain, email, arg_min(url, k) AS source, 'unverified' AS status, '' AS error
    FROM t JOIN d USING (comuna) WHERE split_part(email, '@', 2) = domain GROUP BY comuna, domain, email
    """,
)
def plan_regional_scan(spark, sf):
    targets, live, pages = _regional(spark, sf)
    return measures.regional_scan(targets, live, pages, mx=None, verify_mx=False)


def _regional(spark, sf):
    number = F.col("page_id") % 4
    pages = I.contact_pages(spark, sf).withColumn(
        "comuna", F.concat(F.lit("muni"), number.cast("string"))
    )
    names = I.table(spark, sf, "customer").select(
        (F.col("c_custkey") % 4).alias("n")
    ).distinct()
    targets = names.select(
        F.concat(F.lit("muni"), F.col("n").cast("string")).alias("comuna"),
        F.when(F.col("n") == 0, "building.cl").when(F.col("n") == 1, "machinery.cl").alias("domain"),
    )
    live = names.filter("n = 2").select(F.lit("munimuni2.cl").alias("host"))
    return targets, live, pages


@query(
    "plan_regional_verified",
    "WITH " + I.CONTACT_SQL
    + f"""
    , t AS (SELECT k, 'muni' || (k % 4) AS comuna, email, url FROM published),
    d AS (SELECT 'muni' || n AS comuna, CASE n WHEN 0 THEN 'building.cl' WHEN 1 THEN 'machinery.cl'
       WHEN 2 THEN 'munimuni2.cl' END AS domain FROM (VALUES (0), (1), (2)) v(n))
    SELECT comuna, domain, email, arg_min(url, k) AS source,
      CASE WHEN comuna = 'muni1' THEN 'unknown' ELSE 'invalid' END AS status,
      CASE WHEN comuna = 'muni1' THEN '{V.ERR_TIMED_OUT}'
           ELSE '{V.ERR_NO_MX}' || domain || ' does not exist' END AS error
    FROM t JOIN d USING (comuna) WHERE split_part(email, '@', 2) = domain GROUP BY comuna, domain, email
    """,
)
def plan_regional_verified(spark, sf):
    """With mail hosts asked; the second target's verification timed out."""
    targets, live, pages = _regional(spark, sf)
    domain = F.col("domain")
    mx = targets.filter("domain IS NOT NULL").select(
        "domain",
        F.when(domain == "building.cl", "not_found").otherwise("mx").alias("mx_outcome"),
        F.when(domain == "building.cl", F.concat(domain, F.lit(" does not exist"))).alias("mx_detail"),
    )
    late = targets.filter("comuna = 'muni1'").select("comuna")
    return measures.regional_scan(targets, live, pages, mx, timed_out=late)
