"""Queries on page facts, address extraction and payloads."""

from pyspark.sql import functions as F

from pagelens.catalog import inputs as I
from pagelens.catalog.base import query
from pagelens.functions import text, urls
from pagelens.operators import contacts as C
from pagelens.operators.facts import page_facts, visible_text
from pagelens.operators.shared import running_number, unnest
from pagelens.plans import measures, scan

CONTACT = "WITH " + I.CONTACT_SQL


@query(
    "src_1_pages",
    "SELECT page_id, url, page_id AS crawl_seq, length(html)::INT AS n_chars FROM pages",
)
def src_1(spark, sf):
    return I.pages(spark, sf).select(
        "page_id", "url", "crawl_seq", F.length("html").alias("n_chars")
    )


@query(
    "job_page_facts",
    """
    SELECT url, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
           len(regexp_extract_all(html, '<a href="[^"]*"'))::INT AS anchors,
           0 AS hidden_texts, 0 AS payloads FROM pages
    """,
)
def job_page_facts(spark, sf):
    return page_facts(I.pages(spark, sf)).select(
        "url",
        F.col("facts.lang").alias("lang"),
        F.size("facts.anchors").alias("anchors"),
        F.size("facts.hidden_texts").alias("hidden_texts"),
        F.size("facts.payloads").alias("payloads"),
    )


@query(
    "sca_1_visible_text",
    r"""
    SELECT url, trim(regexp_replace(
      regexp_replace(replace(replace(replace(regexp_replace(html,
        '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]+>', ' ', 'gs'),
        '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'),
      '\s+', ' ', 'g')) AS visible_text
    FROM pages
    """,
)
def sca_1(spark, sf):
    tidy = F.trim(F.regexp_replace(visible_text(), r"\s+", " "))
    return page_facts(I.pages(spark, sf)).select("url", tidy.alias("visible_text"))


@query(
    "sca_2_is_hidden",
    CONTACT + "SELECT url, v IN (4, 5, 6, 9, 10) AS has_hidden FROM contact",
)
def sca_2(spark, sf):
    return page_facts(I.contact_pages(spark, sf)).select(
        "url", (F.size("facts.hidden_texts") > 0).alias("has_hidden")
    )


_SHADES = ["#fff", "#FFFFFF", "white", "#000", "black", "red"]


@query(
    "sca_3_same_colour",
    """
    WITH shade AS (
      SELECT o_orderkey AS k,
        [{names}][o_orderkey % 6 + 1] AS ink,
        [{names}][(o_orderkey // 6) % 6 + 1] AS paper FROM orders)
    SELECT k, ink = paper AS same FROM shade
    """.format(names=", ".join(f"'{s}'" for s in ["white", "white", "white", "black", "black", "red"])),
)
def sca_3(spark, sf):
    k = F.col("o_orderkey")
    shades = F.array(*[F.lit(s) for s in _SHADES])
    html = F.concat(
        F.lit('<p style="color: '),
        F.get(shades, (k % 6).cast("int")),
        F.lit(" ; background-color:"),
        F.get(shades, (F.floor(k / 6) % 6).cast("int")),
        F.lit('">texto</p>'),
    )
    made = I.table(spark, sf, "orders", "o_orderkey").select(k.alias("k"), html.alias("html"))
    return page_facts(made).select(
        "k", (F.size("facts.hidden_texts") == 1).alias("same")
    )


@query(
    "sca_5_followable",
    "WITH " + I.RESPONSE_SQL + "SELECT k, v = 5 AND NOT bodiless AS followable FROM response",
)
def sca_5(spark, sf):
    from pagelens.operators.facts import followable

    return page_facts(I.responses(spark, sf)).select(
        "k", F.coalesce(followable(F.col("facts.anchors")), F.lit(False)).alias("followable")
    )


@query(
    "sca_6_page_lang",
    CONTACT
    + "SELECT url, CASE WHEN nk % 3 = 2 THEN 'es' ELSE 'es-cl' END AS lang FROM contact",
)
def sca_6(spark, sf):
    return page_facts(I.contact_pages(spark, sf)).select(
        "url", text.page_lang(F.col("facts.lang")).alias("lang")
    )


@query("job_extract_contacts", CONTACT + "SELECT email, url AS source, hidden FROM published")
def job_extract_contacts(spark, sf):
    return C.extract_contacts(I.contact_pages(spark, sf)).select(
        "email", "source", "hidden"
    )


@query(
    "job_extract_contacts_com",
    r"""
    SELECT DISTINCT lower(e) AS email, url AS source, false AS hidden
    FROM (SELECT url, unnest(regexp_extract_all(html,
            '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.com\b')) AS e FROM pages)
    """,
)
def job_extract_contacts_com(spark, sf):
    return C.extract_contacts(I.pages(spark, sf), tld="com").select(
        "email", "source", "hidden"
    )


@query(
    "sca_7_email_regex",
    r"""
    SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text,
       '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.com\b'))) AS email FROM documents
    """,
)
def sca_7(spark, sf):
    return C.addresses_in_text(
        I.table(spark, sf, "documents", "doc_id"), "doc_id", "text", "com"
    )


@query(
    "sca_8_mailto",
    CONTACT + "SELECT url, addr AS email FROM contact WHERE v IN (1, 6)",
)
def sca_8(spark, sf):
    hrefs = F.transform("facts.anchors", lambda a: a["href"])
    found = text.mailto_in(hrefs, "cl")
    return unnest(page_facts(I.contact_pages(spark, sf)), ["url"], found, "email").drop("pos")


@query(
    "sca_9_deobfuscate",
    CONTACT + "SELECT url, addr AS email FROM contact WHERE v IN (2, 3)",
)
def sca_9(spark, sf):
    found = text.spelled_out_in(visible_text(), "cl")
    return unnest(page_facts(I.contact_pages(spark, sf)), ["url"], found, "email").drop("pos")


@query(
    "sca_9_spelled_out_documents",
    r"""
    WITH spelled AS (
      SELECT doc_id, regexp_replace(regexp_replace(text, '@', ' at ', 'g'), '[.]', ' ', 'g')
             || ' Contacto: doc' || doc_id || ' (at) Sitio.cl' AS text FROM documents),
    words AS (
      SELECT doc_id, unnest(regexp_extract_all(text,
        '(?i)[a-z0-9._%+\-]+(?:\s*(?:\[at\]|\(at\))|\s+at\s)\s*[a-z0-9.\-]+\.cl\b')) AS m
      FROM spelled)
    SELECT doc_id, lower(regexp_replace(m, '(?i)\s*(?:\[at\]|\(at\)|\sat\s)\s*', '@')) AS email
    FROM words
    """,
)
def sca_9_documents(spark, sf):
    """Whole texts, each with one spelled-out address at its end."""
    spaced = F.regexp_replace(F.regexp_replace("text", "@", " at "), "[.]", " ")
    ending = F.concat(
        F.lit(" Contacto: doc"), F.col("doc_id").cast("string"), F.lit(" (at) Sitio.cl")
    )
    found = text.spelled_out_in(F.concat(spaced, ending), "cl")
    docs = I.table(spark, sf, "documents", "doc_id")
    return unnest(docs, ["doc_id"], found, "email").drop("pos")


@query(
    "sca_9_spelled_out_in_place",
    r"""
    WITH words AS (
      SELECT doc_id, unnest(regexp_extract_all(replace(text, '@', ' (at) '),
        '(?i)[a-z0-9._%+\-]+(?:\s*(?:\[at\]|\(at\))|\s+at\s)\s*[a-z0-9.\-]+\.com\b')) AS m
      FROM documents)
    SELECT doc_id, lower(regexp_replace(m, '(?i)\s*(?:\[at\]|\(at\)|\sat\s)\s*', '@')) AS email
    FROM words
    """,
)
def sca_9_in_place(spark, sf):
    """The texts as given, with their own addresses spelled out where they stand."""
    found = text.spelled_out_in(F.replace(F.col("text"), F.lit("@"), F.lit(" (at) ")), "com")
    docs = I.table(spark, sf, "documents", "doc_id")
    return unnest(docs, ["doc_id"], found, "email").drop("pos")


@query(
    "sca_10_find_payloads",
    CONTACT
    + """
    SELECT url, printf('%02x', k % 256) || array_to_string(list_transform(
        range(1, length(addr) + 1),
        lambda i: printf('%02x', xor(ascii(addr[i]), (k % 256)::INT))), '') AS payload
    FROM contact WHERE v IN (7, 8)
    """,
)
def sca_10(spark, sf):
    found = text.payloads_in(F.col("html"))
    return unnest(I.contact_pages(spark, sf), ["url"], found, "payload").drop("pos")


@query(
    "sca_11_decode_payload",
    CONTACT + "SELECT url, addr AS email FROM contact WHERE v IN (7, 8)",
)
def sca_11(spark, sf):
    clear = text.decode_payloads(text.payloads_in(F.col("html")))
    return unnest(I.contact_pages(spark, sf), ["url"], clear, "email").drop("pos")


@query(
    "set_1_route_union",
    CONTACT
    + """
    SELECT url, CASE WHEN v = 11 OR v IN (4, 5, 6, 10) THEN '' ELSE addr END AS visible
    FROM contact
    """,
)
def set_1(spark, sf):
    return C.contact_arrays(I.contact_pages(spark, sf)).select(
        "url", F.array_join("visible", " ").alias("visible")
    )


@query(
    "set_2_except_hidden",
    CONTACT
    + "SELECT url, CASE WHEN v IN (4, 5, 6, 10) THEN addr ELSE '' END AS hidden_only FROM contact",
)
def set_2(spark, sf):
    return C.contact_arrays(I.contact_pages(spark, sf)).select(
        "url", F.array_join("hidden_only", " ").alias("hidden_only")
    )


@query(
    "join_6_visible_minus_hidden",
    CONTACT + "SELECT url, addr AS email FROM contact WHERE v IN (4, 5, 6, 10)",
)
def join_6(spark, sf):
    arrays = C.contact_arrays(I.contact_pages(spark, sf))
    return unnest(arrays, ["url"], F.col("hidden_only"), "email").drop("pos")


@query(
    "agg_9_hidden_only",
    CONTACT
    + """
    SELECT email, count(*) AS pages, bool_and(hidden) AS always_hidden
    FROM published GROUP BY email
    """,
)
def agg_9(spark, sf):
    found = C.extract_contacts(I.contact_pages(spark, sf))
    return found.groupBy("email").agg(
        F.count(F.lit(1)).alias("pages"), F.bool_and("hidden").alias("always_hidden")
    )


# --- payloads the other routes miss -----------------------------------------------------

_YIELD_SQL = """
row_in AS (
  SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 'http 503' ELSE 'ok' END AS outcome,
         CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_orderkey % 5 END AS n,
         o_orderkey % 3 = 0 AS shown, 'o' || o_custkey || '@' AS who
  FROM orders),
yielded AS (
  SELECT k, outcome, n::INT AS payloads, n::INT AS decoded_cl,
         (CASE WHEN shown AND n > 0 THEN n - 1 ELSE n END)::INT AS new_addresses,
         array_to_string(list_slice(list_transform(
           range(CASE WHEN shown AND n > 0 THEN 1 ELSE 0 END, n), lambda i: who || 'd' || i || '.cl'),
           1, 3), ' ') AS sample
  FROM row_in)
"""


def payload_pages(spark, sf):
    """Up to four payloads per order inside a comment, the first also shown."""
    k = F.col("o_orderkey")
    count = (k % 5).cast("int")

    def address(i):
        return F.concat(
            F.lit("o"), F.col("o_custkey").cast("string"), F.lit("@d"),
            i.cast("string"), F.lit(".cl"),
        )

    coded = F.transform(
        F.filter(F.array(*[F.lit(i) for i in range(4)]), lambda i: i < count),
        lambda i: F.concat(
            F.lit('data-cfemail="'), I._xor_hex(address(i), F.lit(91)), F.lit('"')
        ),
    )
    shown = F.when((k % 3 == 0) & (count > 0), address(F.lit(0))).otherwise("nada")
    return I.table(spark, sf, "orders", "o_orderkey").select(
        k.alias("k"),
        F.concat(F.lit("https://o.cl/"), k.cast("string")).alias("url"),
        F.when(k % 10 == 0, "http 503").otherwise("ok").alias("outcome"),
        F.concat(
            F.lit("<html><!-- "), F.array_join(coded, " "), F.lit(" --><p>"), shown,
            F.lit("</p></html>"),
        ).alias("html"),
    )


@query("join_9_new_addresses", "WITH " + _YIELD_SQL + "SELECT * FROM yielded")
def join_9(spark, sf):
    return C.payload_yield(payload_pages(spark, sf)).select(
        "k", "outcome", "payloads", "decoded_cl", "new_addresses", "sample"
    )


@query("set_3_except_known", "WITH " + _YIELD_SQL + "SELECT k, new_addresses FROM yielded")
def set_3(spark, sf):
    return C.payload_yield(payload_pages(spark, sf)).select("k", "new_addresses")


@query(
    "top_8_sample_3",
    "WITH " + _YIELD_SQL + "SELECT k, sample FROM yielded WHERE sample <> ''",
)
def top_8(spark, sf):
    rows = C.payload_yield(payload_pages(spark, sf))
    return rows.filter("sample <> ''").select("k", "sample")


_WILSON = """
 CASE WHEN {n} = 0 THEN 0.0 ELSE greatest(0.0, (({k}::DOUBLE/{n} + 3.8416/(2*{n}))
   - 1.96 * sqrt({k}::DOUBLE/{n} * (1 - {k}::DOUBLE/{n}) / {n} + 3.8416/(4.0*{n}*{n})))
   / (1 + 3.8416/{n})) END"""
_WILSON_HIGH = _WILSON.replace("greatest(0.0", "least(1.0").replace("- 1.96", "+ 1.96")


def wilson_sql(k: str, n: str) -> tuple:
    """SQL text of both interval ends, rounded like the Spark side."""
    return tuple(
        f"round({end.format(k=k, n=n)}, 9)" for end in (_WILSON, _WILSON_HIGH)
    )


_USING, _RECOVERING = wilson_sql("using_", "reachable"), wilson_sql("recovering", "reachable")


@query(
    "agg_17_prevalence",
    "WITH " + _YIELD_SQL + f""",
    c AS (SELECT count(*) AS domains, count(*) FILTER (outcome = 'ok') AS reachable,
            count(*) FILTER (outcome <> 'ok') AS unreachable,
            count(*) FILTER (outcome = 'ok' AND payloads > 0) AS using_,
            count(*) FILTER (outcome = 'ok' AND new_addresses > 0) AS recovering,
            sum(new_addresses) FILTER (outcome = 'ok')::BIGINT AS total_new
          FROM yielded)
    SELECT domains, reachable, unreachable, using_ AS using, recovering, total_new,
           {_USING[0]} AS using_low, {_USING[1]} AS using_high,
           {_RECOVERING[0]} AS recovering_low, {_RECOVERING[1]} AS recovering_high
    FROM c
    """,
)
def agg_17(spark, sf):
    report = measures.payload_measure(payload_pages(spark, sf))["report"]
    ends = [c for c in report.columns if c.endswith(("_low", "_high"))]
    return report.select(
        *[F.round(c, 9).alias(c) if c in ends else F.col(c) for c in report.columns]
    )


# --- scope and order -----------------------------------------------------------------------

_TARGET_SQL = """
WITH a AS (SELECT c_custkey AS k, 'c' || c_custkey || '@' ||
  ['building.cl', 'mail.building.cl', 'notbuilding.cl', 'building.com'][c_custkey % 4 + 1] AS email
  FROM customer)
"""


def _target_emails(spark, sf):
    k = F.col("c_custkey")
    hosts = F.array(
        *[F.lit(h) for h in ("building.cl", "mail.building.cl", "notbuilding.cl", "building.com")]
    )
    return I.table(spark, sf, "customer").select(
        k.alias("k"),
        F.concat(
            F.lit("c"), k.cast("string"), F.lit("@"), F.get(hosts, (k % 4).cast("int"))
        ).alias("email"),
    )


@query("flt_3_target_suffix", _TARGET_SQL + "SELECT * FROM a WHERE k % 4 < 3")
def flt_3(spark, sf):
    return _target_emails(spark, sf).filter(urls.at_suffix(F.col("email"), "building.cl"))


@query("flt_4_target_host", _TARGET_SQL + "SELECT * FROM a WHERE k % 4 < 2")
def flt_4(spark, sf):
    return _target_emails(spark, sf).filter(urls.at_host(F.col("email"), "building.cl"))


@query(
    "sca_25_email_domain",
    _TARGET_SQL + "SELECT k, split_part(email, '@', 2) AS domain FROM a",
)
def sca_25(spark, sf):
    return _target_emails(spark, sf).select(
        "k", urls.email_domain(F.col("email")).alias("domain")
    )


@query(
    "win_1_first_seen",
    CONTACT
    + """
    SELECT email, arg_min(url, k) AS source, arg_min(hidden, k) AS hidden
    FROM published GROUP BY email
    """,
)
def win_1(spark, sf):
    found = C.extract_contacts(I.contact_pages(spark, sf), keep=["crawl_seq"])
    return C.first_seen(found).select("email", "source", "hidden")


@query(
    "win_1_first_seen_hosts",
    r"""
    WITH found AS (
      SELECT page_id, url, lower(unnest(regexp_extract_all(html,
        '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.com\b'))) AS email FROM pages),
    firsts AS (SELECT email, arg_min(url, page_id) AS source FROM found GROUP BY email)
    SELECT regexp_extract(source, '^https?://([^/?#]*)', 1) AS host, count(*) AS addresses
    FROM firsts GROUP BY 1
    """,
)
def win_1_hosts(spark, sf):
    found = C.extract_contacts(I.pages(spark, sf), tld="com", keep=["crawl_seq"])
    return C.first_seen(found).groupBy(
        urls.host(F.col("source")).alias("host")
    ).agg(F.count(F.lit(1)).alias("addresses"))


@query(
    "win_4_running_pages",
    """
    SELECT event_id, event_type AS run,
           row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS page_number
    FROM events
    """,
)
def win_4(spark, sf):
    seen = I.table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("run")
    )
    return running_number(seen, ["run"], "event_id", "page_number", width=1000)


@query(
    "win_5_first_per_target",
    CONTACT
    + """
    SELECT k % 7 AS target, email, arg_min(url, k) AS source
    FROM published GROUP BY 1, 2
    """,
)
def win_5(spark, sf):
    pages = I.contact_pages(spark, sf).withColumn("target", F.col("page_id") % 7)
    found = C.extract_contacts(pages, keep=["target", "crawl_seq"])
    return C.first_seen(found, ["target", "email"]).select("target", "email", "source")


@query(
    "agg_6_distinct_total",
    CONTACT
    + "SELECT count(DISTINCT email) AS addresses, count(*) AS occurrences FROM published",
)
def agg_6_total(spark, sf):
    return C.extract_contacts(I.contact_pages(spark, sf)).agg(
        F.count_distinct("email").alias("addresses"),
        F.count(F.lit(1)).alias("occurrences"),
    )


@query(
    "plan_discoveries",
    CONTACT
    + """
    , firsts AS (
      SELECT email, arg_min(url, k) AS source, arg_min(hidden, k) AS hidden,
             arg_min(k, k) AS k FROM published
      WHERE email LIKE '%building.cl' GROUP BY email)
    SELECT email, source, false AS generated, hidden,
           CASE WHEN c_nationkey % 3 = 2 THEN '' ELSE 'lang-es-cl' END AS evidence
    FROM firsts JOIN customer ON c_custkey = k
    """,
)
def plan_discoveries(spark, sf):
    found = scan.discoveries(I.contact_pages(spark, sf), target="@Building.cl")
    return found.select(
        "email", "source", "generated", "hidden",
        F.array_join("evidence", ",").alias("evidence"),
    )


@query(
    "plan_discoveries_com",
    r"""
    WITH f AS (
      SELECT page_id, url, lower(unnest(regexp_extract_all(html,
        '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.com\b'))) AS email FROM pages)
    SELECT email, arg_min(url, page_id) AS source, false AS generated, false AS hidden
    FROM f GROUP BY email
    """,
)
def plan_discoveries_com(spark, sf):
    """The flagship run over the given pages."""
    return scan.discoveries(I.pages(spark, sf), tld="com").select(
        "email", "source", "generated", "hidden"
    )


@query(
    "job_extract_by_page_counts",
    CONTACT
    + """
    SELECT split_part(email, '@', 2) AS domain, count(*) AS found,
           count(*) FILTER (hidden) AS hidden FROM published GROUP BY 1
    """,
)
def extract_counts(spark, sf):
    found = C.extract_contacts(I.contact_pages(spark, sf))
    return found.groupBy(urls.email_domain(F.col("email")).alias("domain")).agg(
        F.count(F.lit(1)).alias("found"), F.count_if("hidden").alias("hidden")
    )
