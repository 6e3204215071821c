"""Queries on evidence signals, names and candidate addresses."""

from pyspark.sql import functions as F

from pagelens.catalog import inputs as I
from pagelens.catalog.base import query
from pagelens.functions import phones, text, urls
from pagelens.operators import candidates as K, contacts as C, evidence as E
from pagelens.operators.facts import page_facts
from pagelens.plans import scan

CONTACT = "WITH " + I.CONTACT_SQL
TERMS = ["the", "wasser", "leaux", "para", "que les"]


@query(
    "sca_12_lang_es_cl",
    CONTACT + "SELECT url, nk % 3 <> 2 AS fired FROM contact",
)
def sca_12(spark, sf):
    return page_facts(I.contact_pages(spark, sf)).select(
        "url", (text.page_lang(F.col("facts.lang")) == "es-cl").alias("fired")
    )


_RUT_SQL = """
WITH b AS (SELECT c_custkey AS k, 10000000 + c_custkey * 37 AS n FROM customer),
d AS (SELECT k, n, (11 - (
   (n % 10) * 2 + (n // 10 % 10) * 3 + (n // 100 % 10) * 4 + (n // 1000 % 10) * 5
   + (n // 10000 % 10) * 6 + (n // 100000 % 10) * 7 + (n // 1000000 % 10) * 2
   + (n // 10000000 % 10) * 3) % 11) % 11 AS want, k % 11 AS shown FROM b)
SELECT k, want = shown AS fired FROM d
"""


@query("sca_13_rut", _RUT_SQL)
def sca_13(spark, sf):
    k = F.col("c_custkey")
    number = (F.lit(10000000) + k * 37).cast("string")
    dotted = F.concat_ws(
        ".", F.substring(number, 1, 2), F.substring(number, 3, 3), F.substring(number, 6, 3)
    )
    check = F.when(k % 11 == 10, F.when(k % 2 == 0, "K").otherwise("k")).otherwise(
        (k % 11).cast("string")
    )
    body = F.when(k % 2 == 0, dotted).otherwise(number)
    line = F.concat(F.lit("Razon social, R.U.T. "), body, F.lit("-"), check, F.lit(", Chile"))
    return I.table(spark, sf, "customer").select(
        k.alias("k"), text.has_valid_rut(line).alias("fired")
    )


_PHONES = [
    ("Mesa central 22 818 {n}", True),
    ("+56 2 2818 {n}", True),
    ("tel. (76) 245 {n}", False),
    ("+1 604 699 {n}", False),
    ("Spokane, WA 99201-{n}", False),
    ("cel +56 9 8765 {n}", True),
    ("codigo 76.086.428-5 {n}", False),
    ("fono (41) 2-20 {n}", True),
]


@query(
    "sca_14_phone",
    "SELECT c_custkey AS k, ["
    + ", ".join(str(fires).lower() for _, fires in _PHONES)
    + "][c_custkey % 8 + 1] AS fired FROM customer",
)
def sca_14(spark, sf):
    k = F.col("c_custkey")
    last = F.lpad((k % 9000 + 1000).cast("string"), 4, "0")
    shapes = F.array(*[F.lit(t) for t, _ in _PHONES])
    line = F.replace(F.get(shapes, (k % 8).cast("int")), F.lit("{n}"), last)
    return I.table(spark, sf, "customer").select(
        k.alias("k"), text.has_cl_phone(line).alias("fired")
    )


@query(
    "sca_15_lexicon",
    r"""
    SELECT doc_id, regexp_matches(strip_accents(lower(text)),
      '(^|[^\p{L}\p{N}_])(the|wasser|leaux|para|que les)([^\p{L}\p{N}_]|$)') AS fired
    FROM documents
    """,
)
def sca_15(spark, sf):
    return I.table(spark, sf, "documents", "doc_id").select(
        "doc_id", text.has_lexicon(F.col("text"), TERMS).alias("fired")
    )


@query(
    "sca_16_path_cl",
    r"""
    SELECT page_id, len(list_filter(string_split(
        regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)
        || ['', '/cl/', '/es/Chile', '/falabella-cl', '/clima'][page_id % 5 + 1], '/'),
        lambda s: regexp_matches(s, '(?i)^(cl|chile|es-cl)$|-cl$'))) > 0 AS fired
    FROM pages
    """,
)
def sca_16(spark, sf):
    tails = F.array(*[F.lit(t) for t in ("", "/cl/", "/es/Chile", "/falabella-cl", "/clima")])
    url = F.concat(
        F.regexp_replace("url", r"[?#].*$", ""),
        F.get(tails, (F.col("page_id") % 5).cast("int")),
    )
    return I.pages(spark, sf).select(
        "page_id", text.has_country_path(urls.path(url)).alias("fired")
    )


@query(
    "sca_17_deaccent",
    "SELECT doc_id, md5(strip_accents(text)) AS plain FROM documents",
)
def sca_17(spark, sf):
    return I.table(spark, sf, "documents", "doc_id").select(
        "doc_id", F.md5(text.deaccent(F.col("text"))).alias("plain")
    )


# The plan's shapes without look-around, which the SQL engine lacks; enough for
# the given texts, whose foreign numbers have ten national digits.
_PHONE_SQL = (
    r"(^|[^\d\p{L}+])\(?((2\)?[\s.\-]?[1-3]|9[\s.\-]?[2-9]|3[2-5]|4[1-5]|7[1-35]"
    r"|5[1-3578]|6[13-57])\)?([\s.\-]?\d){7}|800\)?([\s.\-]?\d){6}"
    r"|600\)?([\s.\-]?\d){7,8}|1230\)?([\s.\-]?\d){7})(\D|$)"
)

_DIALLED = [
    ("Mesa 22 818 {n}", "22818", "fixed"),
    ("+56 (9) 8765 {n}", "98765", "mobile"),
    ("llame 800 12{n}", "80012", "toll_free"),
    ("600 600 {n} o", "600600", "shared_cost"),
    ("0056 44 208 {n}", "44208", "voip"),
    ("1880 56 41 220 {n}", "41220", "fixed"),
    ("00 44 22 818 {n}", None, None),
    ("36 345 {n} y 76 245 {n}", None, None),
]


@query(
    "sca_14_phone_kinds",
    "SELECT c_custkey AS k, CASE c_custkey % 8 "
    + " ".join(
        f"WHEN {i} THEN "
        + (f"'{digits}' || (c_custkey % 9000 + 1000) || ':{kind}'" if digits else "''")
        for i, (_, digits, kind) in enumerate(_DIALLED)
    )
    + " END AS numbers FROM customer",
)
def sca_14_kinds(spark, sf):
    """Numbers of several kinds, dialled in several ways, with their kind."""
    k = F.col("c_custkey")
    last = (k % 9000 + 1000).cast("string")
    shapes = F.array(*[F.lit(t) for t, *_ in _DIALLED])
    line = F.replace(F.get(shapes, (k % 8).cast("int")), F.lit("{n}"), last)
    found = F.transform(phones.phones_in(line), lambda p: F.concat_ws(":", p["digits"], p["kind"]))
    return I.table(spark, sf, "customer").select(k.alias("k"), F.array_join(found, " ").alias("numbers"))


@query(
    "sca_14_phone_documents",
    f"SELECT doc_id, regexp_matches(text, '{_PHONE_SQL}') AS fired FROM documents",
)
def sca_14_documents(spark, sf):
    return I.table(spark, sf, "documents", "doc_id").select(
        "doc_id", text.has_cl_phone(F.col("text")).alias("fired")
    )


_PAGE_EVIDENCE_SQL = r"""
WITH p AS (
  SELECT page_id, url, html, regexp_replace(regexp_replace(html,
     '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]+>', ' ', 'gs'),
     '&[a-z]+;', ' ', 'g') AS body FROM pages)
SELECT url, array_to_string(list_filter([
   CASE WHEN regexp_matches(strip_accents(lower(body)),
     '(^|[^\p{L}\p{N}_])(the|wasser|leaux|para|que les)([^\p{L}\p{N}_]|$)') THEN 'lexicon' END,
   CASE WHEN len(list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'),
     lambda s: regexp_matches(s, '(?i)^(cl|chile|es-cl)$|-cl$'))) > 0 THEN 'path-cl' END,
   CASE WHEN regexp_matches(body, '{phone}') THEN 'phone-cl' END],
   lambda s: s IS NOT NULL), ',') AS evidence
FROM p
""".replace("{phone}", _PHONE_SQL)


@query("job_page_evidence", _PAGE_EVIDENCE_SQL)
def job_page_evidence(spark, sf):
    """The given pages hold no identifiers of the country."""
    return E.page_evidence(I.pages(spark, sf), TERMS).select(
        "url", F.array_join("evidence", ",").alias("evidence")
    )


@query(
    "agg_13_evidence_set",
    """
    SELECT c_custkey AS k, array_to_string(list_filter([
      CASE WHEN c_custkey % 2 = 0 THEN 'lang-es-cl' END,
      CASE WHEN c_custkey % 3 = 0 THEN 'lexicon' END,
      CASE WHEN c_custkey % 5 = 0 THEN 'path-cl' END,
      CASE WHEN c_custkey % 7 = 0 THEN 'phone-cl' END,
      CASE WHEN c_custkey % 11 = 0 THEN 'rut' END],
      lambda s: s IS NOT NULL), ',') AS evidence
    FROM customer
    """,
)
def agg_13(spark, sf):
    k = F.col("c_custkey")
    body = F.concat_ws(
        " ",
        F.lit("Empresa"),
        F.when(k % 3 == 0, "Región  Metropolitana, COMUNA de"),
        F.when(k % 7 == 0, "22 818 5000"),
        F.when(k % 11 == 0, "76.086.428-5").otherwise("76.086.428-1"),
    )
    url = F.when(k % 5 == 0, "https://a.com/tienda-cl/x").otherwise("https://a.com/x")
    lang = F.when(k % 2 == 0, "ES_CL").otherwise("es")
    return I.table(spark, sf, "customer").select(
        k.alias("k"),
        F.array_join(E.evidence_of(lang, body, url), ",").alias("evidence"),
    )


@query(
    "join_5_attach_evidence",
    CONTACT
    + """
    SELECT email, url AS source, hidden,
           CASE WHEN nk % 3 = 2 THEN '' ELSE 'lang-es-cl' END AS evidence
    FROM published JOIN contact USING (k, url)
    """,
)
def join_5(spark, sf):
    pages = I.contact_pages(spark, sf)
    return E.attach_evidence(C.extract_contacts(pages), pages).select(
        "email", "source", "hidden", F.array_join("evidence", ",").alias("evidence")
    )


# --- names -----------------------------------------------------------------------

_NAME_SQL = r"""
WITH m AS (
  SELECT doc_id, unnest(regexp_extract_all(text,
    '[A-ZÁÉÍÓÚÑÜ][a-záéíóúñü]{2,}\s+[A-ZÁÉÍÓÚÑÜ][a-záéíóúñü]{2,}')) AS pair
  FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-zÁÉÍÓÚÑÜáéíóúñü\s]+', ' . ', 'g') AS text
        FROM documents)),
w AS (SELECT DISTINCT doc_id, regexp_split_to_array(pair, '\s+') AS p FROM m)
"""


def _letters(column: str = "text"):
    """Only letters the name rule knows, so both engines see the same words."""
    return F.regexp_replace(column, r"[^A-Za-zÁÉÍÓÚÑÜáéíóúñü\s]+", " . ")


@query("sca_18_name_pairs", _NAME_SQL + "SELECT doc_id, count(*) AS pairs FROM w GROUP BY doc_id")
def sca_18(spark, sf):
    pairs = text.name_pairs(_letters())
    return (
        I.table(spark, sf, "documents", "doc_id")
        .select("doc_id", F.size(pairs).cast("bigint").alias("pairs"))
        .filter("pairs > 0")
    )


_NAMED_SQL = """
WITH n AS (
  SELECT o_orderkey AS k,
    ['María', 'Soto', 'Andrés', 'Pérez', 'Ñandú', 'Felipe'][o_orderkey % 6 + 1] AS one,
    ['Núñez', 'Camila', 'Pablo', 'Güemes', 'Ibáñez', 'Rodrigo'][o_orderkey // 6 % 6 + 1] AS two
  FROM orders),
o AS (
  SELECT k, CASE WHEN one NOT IN ('María', 'Andrés', 'Felipe')
    AND two IN ('Camila', 'Pablo', 'Rodrigo') THEN [two, one] ELSE [one, two] END AS p FROM n),
s AS (
  SELECT k, p[1] AS first, p[2] AS last,
    strip_accents(lower(p[1])) AS f, strip_accents(lower(p[2])) AS l FROM o)
"""


def _named_pages(spark, sf):
    k = F.col("o_orderkey")
    one = F.get(
        F.array(*[F.lit(n) for n in ("María", "Soto", "Andrés", "Pérez", "Ñandú", "Felipe")]),
        (k % 6).cast("int"),
    )
    two = F.get(
        F.array(*[F.lit(n) for n in ("Núñez", "Camila", "Pablo", "Güemes", "Ibáñez", "Rodrigo")]),
        (F.floor(k / 6) % 6).cast("int"),
    )
    return I.table(spark, sf, "orders", "o_orderkey").select(
        k.alias("k"),
        F.concat(F.lit("https://e.cl/"), k.cast("string")).alias("url"),
        F.concat(F.lit("<p>jefe: "), one, F.lit(" \n"), two, F.lit(".</p>")).alias("html"),
        k.alias("crawl_seq"),
    )


@query("sca_19_name_order", _NAMED_SQL + "SELECT k, first, last FROM s")
def sca_19(spark, sf):
    named = page_facts(_named_pages(spark, sf))
    return named.select(
        "k", F.inline(text.name_pairs(F.col("facts.text")))
    )


@query("sca_20_normalise_name", _NAMED_SQL + "SELECT k, f AS first, l AS last FROM s")
def sca_20(spark, sf):
    return sca_19(spark, sf).select(
        "k",
        text.normalise_name(F.col("first")).alias("first"),
        text.normalise_name(F.col("last")).alias("last"),
    )


@query(
    "sca_21_apply_pattern",
    _NAMED_SQL
    + """
    SELECT k, preset, email FROM (SELECT k, unnest([
      {preset: 'first.last', email: f || '.' || l},
      {preset: 'flast', email: f[1] || l},
      {preset: 'f.last', email: f[1] || '.' || l},
      {preset: 'first_last', email: f || '_' || l},
      {preset: 'last.first', email: l || '.' || f},
      {preset: 'lastf', email: l || f[1]},
      {preset: 'first', email: f}], recursive := true) FROM s)
    """.replace("|| l}", "|| l || '@e.cl'}")
    .replace("|| f}", "|| f || '@e.cl'}")
    .replace("f[1]}", "f[1] || '@e.cl'}")
    .replace("email: f}", "email: f || '@e.cl'}"),
)
def sca_21(spark, sf):
    return K.preset_candidates(sca_19(spark, sf), "e.cl").select("k", "preset", "email")


@query(
    "sca_22_candidate_email",
    _NAMED_SQL
    + """
    SELECT f || '.' || l || '@e.cl' AS email, 'https://e.cl/' || min(k) AS source
    FROM s GROUP BY f, l
    """,
)
def sca_22(spark, sf):
    made = K.candidate_addresses(
        _named_pages(spark, sf), "{first}.{last}", "@E.cl", ["crawl_seq"]
    )
    return C.first_seen(made).select("email", "source")


@query(
    "job_candidate_addresses",
    _NAMED_SQL
    + "SELECT f[1] || l || '@e.cl' AS email, 'https://e.cl/' || k AS source, true AS generated FROM s",
)
def job_candidate_addresses(spark, sf):
    return K.candidate_addresses(_named_pages(spark, sf), "{f}{last}", "e.cl").select(
        "email", "source", "generated"
    )


@query(
    "job_candidates_documents",
    _NAME_SQL
    + """
    , n AS (SELECT doc_id, strip_accents(lower(p[1])) AS f, strip_accents(lower(p[2])) AS l FROM w)
    SELECT DISTINCT doc_id, f || '.' || l || '@e.cl' AS email FROM n
    """,
)
def job_candidates_documents(spark, sf):
    docs = I.table(spark, sf, "documents", "doc_id")
    return K.candidates_of(docs, _letters(), "{first}.{last}", "e.cl", ["doc_id"]).select(
        "doc_id", "email"
    )


@query(
    "flt_14_generation_gate",
    _NAMED_SQL
    + """
    SELECT f || '@e.cl' AS email, 'https://e.cl/' || min(k) AS source, true AS generated, 1 AS run
    FROM s GROUP BY f
    """,
)
def flt_14(spark, sf):
    """A target inside the TLD gets guesses, a foreign one none."""
    pages = _named_pages(spark, sf)
    runs = [
        scan.discoveries(pages, target, "{first}").withColumn("run", F.lit(n))
        for n, target in enumerate(("e.com", "e.cl"))
    ]
    return runs[0].unionByName(runs[1]).select("email", "source", "generated", "run")
