"""Queries on mail hosts, replies and verdicts."""

from pyspark.sql import functions as F

from pagelens.catalog import inputs as I
from pagelens.catalog.base import query
from pagelens.functions import fixed_values as V
from pagelens.operators import estimates as E, results as R, verdicts as D
from pagelens.operators.shared import attach, scratch_path, taken
from pagelens.plans import measures
from pagelens.sources import readers

MAIL = "WITH " + I.MAIL_SQL

CLASSIFIED_SQL = I.MAIL_SQL + """
, joined AS (
  SELECT a.*, coalesce(m.mx_outcome, 'unavailable') AS mx_outcome, m.domain IS NULL AS unseen,
         r.code, r.message, c.catch_all,
         CASE r.message WHEN '5.1.1 no such user' THEN 1 WHEN '5.7.1 policy' THEN 7
              WHEN '5.2.2 full' THEN 22 END AS enhanced
  FROM address a LEFT JOIN mx_verdict m USING (domain)
  LEFT JOIN reply r ON r.o_custkey = a.c_custkey LEFT JOIN catch_all c USING (domain)),
verdict AS (
  SELECT c_custkey, email, syntax_ok, syntax_ok AND mx_outcome = 'mx' AS mx_ok,
    CASE WHEN syntax_ok AND mx_outcome = 'mx' THEN code = 250 END AS smtp_ok,
    CASE WHEN NOT syntax_ok THEN 'invalid'
      WHEN mx_outcome <> 'mx' OR code IS NULL THEN 'unknown'
      WHEN code = 250 AND catch_all THEN 'catch_all' WHEN code = 250 THEN 'valid'
      WHEN code = 550 AND enhanced = 22 THEN 'unknown'
      WHEN code = 550 AND (enhanced IS NULL OR enhanced = 1) THEN 'invalid'
      ELSE 'unknown' END AS status,
    coalesce(syntax_ok AND mx_outcome = 'mx' AND code = 450, false) AS greylisted,
    code, enhanced, catch_all, mx_outcome, unseen
  FROM joined),
told AS (
  SELECT *, CASE WHEN NOT syntax_ok THEN 'Invalid email format'
    WHEN mx_outcome <> 'mx' THEN 'MX lookup failed: '
    WHEN code IS NULL THEN 'SMTP error: no reply recorded'
    WHEN code = 250 AND catch_all
      THEN 'Domain accepts all recipients; 250 is not proof the mailbox exists'
    WHEN code = 250 THEN ''
    WHEN code = 550 AND enhanced = 22 THEN 'SMTP RCPT code 550: mailbox full, so it '
      || 'exists but will not take mail right now'
    WHEN code = 550 AND (enhanced IS NULL OR enhanced = 1) THEN 'SMTP RCPT code 550'
    WHEN code = 550 THEN 'SMTP RCPT code 550: refused over policy, routing or protocol, '
      || 'which says nothing about this address'
    WHEN code = 450 THEN 'SMTP RCPT code 450 (greylisted, worth retrying)'
    ELSE 'SMTP RCPT code ' || code END AS error
  FROM verdict)
"""


def classified(spark, sf, smtp_enabled: bool = True):
    return D.classify_addresses(
        I.addresses(spark, sf),
        D.mx_verdicts(I.mx_observations(spark, sf)),
        I.smtp_replies(spark, sf),
        D.catch_all_verdicts(I.catch_all_probes(spark, sf)),
        smtp_enabled,
    )


@query(
    "job_classify_addresses",
    "WITH " + CLASSIFIED_SQL
    + """
    SELECT email, status, CASE WHEN mx_outcome <> 'mx' AND syntax_ok AND NOT unseen
      THEN 'MX lookup failed: *' ELSE error END AS error,
      syntax_ok, mx_ok, smtp_ok, greylisted FROM told
    """,
)
def job_classify(spark, sf):
    """Reasons of failed lookups are compared by ``win_6_transport_fallback``."""
    rows = classified(spark, sf)
    error = F.regexp_replace("error", "^(MX lookup failed: ).+", "$1*")
    return rows.select(
        "email", "status", error.alias("error"), "syntax_ok", "mx_ok", "smtp_ok", "greylisted"
    )


@query(
    "job_classify_without_smtp",
    "WITH " + CLASSIFIED_SQL
    + """
    SELECT email, CASE WHEN NOT syntax_ok THEN 'invalid' ELSE 'unknown' END AS status,
           CASE WHEN NOT syntax_ok THEN 'Invalid email format' WHEN mx_ok THEN ''
                WHEN unseen THEN 'MX lookup failed: ' ELSE 'MX lookup failed: *' END AS error
    FROM told
    """,
)
def job_classify_without_smtp(spark, sf):
    rows = classified(spark, sf, smtp_enabled=False)
    error = F.regexp_replace("error", "^(MX lookup failed: ).+", "$1*")
    return rows.select("email", "status", error.alias("error"))


@query(
    "agg_19_verdict_counts",
    "WITH " + CLASSIFIED_SQL
    + """
    SELECT count(*) FILTER (status = 'valid') AS valid,
           count(*) FILTER (status = 'catch_all') AS catch_all,
           count(*) FILTER (status = 'unknown') AS unknown,
           count(*) FILTER (status = 'invalid') AS invalid FROM verdict
    """,
)
def agg_19(spark, sf):
    return R.verdict_counts(classified(spark, sf))


@query(
    "join_2_mx_for_email",
    MAIL
    + """
    SELECT email, coalesce(mx_outcome, 'unavailable') AS mx_outcome, mx_host
    FROM address LEFT JOIN mx_verdict USING (domain)
    """,
)
def join_2(spark, sf):
    mails = I.addresses(spark, sf).withColumn(
        "domain", F.concat(F.regexp_extract("email", r"([a-z]+)\.cl$", 1), F.lit(".cl"))
    )
    mails = mails.withColumn("domain", F.regexp_replace("domain", r"^c\d+", ""))
    mx = D.mx_verdicts(I.mx_observations(spark, sf))
    return attach(mails, mx, "domain").select(
        "email", F.coalesce("mx_outcome", F.lit("unavailable")).alias("mx_outcome"), "mx_host"
    )


@query(
    "join_3_catch_all_for_email",
    MAIL
    + """
    SELECT email, catch_all FROM address JOIN catch_all USING (domain)
    JOIN reply ON o_custkey = c_custkey WHERE code = 250 AND syntax_ok
    """,
)
def join_3(spark, sf):
    accepted = I.smtp_replies(spark, sf).filter("code = 250 AND contains(email, '@')")
    keyed = accepted.select("email", F.element_at(F.split("email", "@"), 2).alias("domain"))
    verdicts = D.catch_all_verdicts(I.catch_all_probes(spark, sf))
    return attach(keyed, verdicts, "domain").select("email", "catch_all")


@query(
    "join_4_smtp_reply",
    MAIL
    + """
    SELECT email, code, coalesce(message, '(none)') AS message
    FROM address LEFT JOIN reply ON o_custkey = c_custkey
    """,
)
def join_4(spark, sf):
    joined = attach(
        I.addresses(spark, sf).select("email"), I.smtp_replies(spark, sf), "email"
    )
    return joined.select(
        "email", "code", F.coalesce("message", F.lit("(none)")).alias("message")
    )


@query("agg_12_catch_all_verdict", MAIL + "SELECT * FROM catch_all")
def agg_12(spark, sf):
    return D.catch_all_verdicts(I.catch_all_probes(spark, sf))


@query(
    "agg_11_lowest_preference",
    MAIL
    + """
    SELECT domain, transport_order::INT AS transport_order, exchange AS mx_host FROM (
      SELECT *, row_number() OVER (PARTITION BY domain, transport_order
        ORDER BY preference, exchange) AS r FROM mx_row WHERE outcome = 'mx') WHERE r = 1
    """,
)
def agg_11(spark, sf):
    rows = I.mx_observations(spark, sf).filter("outcome = 'mx'")
    return D.lowest_preference(rows, ["domain", "transport_order"])


_TRANSPORT_SQL = """
WITH obs AS (
  SELECT 'd' || o_custkey || '.cl' AS domain, o_orderkey % 3 AS t, o_orderkey AS k,
    ['unavailable', 'mx', 'unavailable', 'not_found', 'unavailable', 'implicit', 'unavailable']
      [o_orderkey % 7 + 1] AS outcome, (o_orderkey % 4) * 10 AS pref,
    CASE WHEN o_orderkey % 35 = 1 THEN '.' ELSE 'mx' || o_orderkey || '.cl.' END AS exchange
  FROM orders),
per AS (
  SELECT domain, t, bool_or(outcome = 'mx') AS has_mx, bool_or(outcome = 'implicit') AS imp,
    bool_or(outcome = 'not_found') AS neg,
    arg_min(exchange, pref || '|' || exchange) FILTER (outcome = 'mx') AS mx,
    min('timeout ' || t) FILTER (outcome = 'unavailable') AS reason
  FROM obs GROUP BY domain, t),
ans AS (
  SELECT domain, t, reason, CASE WHEN mx = '.' THEN 'not_found' WHEN has_mx THEN 'mx'
      WHEN imp THEN 'implicit' WHEN neg THEN 'not_found' ELSE 'unavailable' END AS outcome,
    CASE WHEN has_mx THEN rtrim(mx, '.') WHEN imp THEN domain END AS host,
    CASE WHEN mx = '.' THEN domain || ' publishes a null MX (RFC 7505): it accepts no mail'
      ELSE domain || ' does not exist' END AS denial
  FROM per),
f AS (
  SELECT domain, arg_min(outcome, t) FILTER (outcome <> 'unavailable') AS o,
    arg_min(coalesce(host, ''), t) FILTER (outcome <> 'unavailable') AS h,
    arg_min(denial, t) FILTER (outcome <> 'unavailable') AS d,
    string_agg(reason, '; ' ORDER BY t) FILTER (outcome = 'unavailable') AS r
  FROM ans GROUP BY domain)
SELECT domain, coalesce(o, 'unavailable') AS mx_outcome,
  CASE WHEN o IN ('mx', 'implicit') THEN h END AS mx_host,
  CASE WHEN o = 'not_found' THEN d WHEN o IS NULL THEN r END AS mx_detail
FROM f
"""


@query("win_6_transport_fallback", _TRANSPORT_SQL)
def win_6(spark, sf):
    k = F.col("o_orderkey")
    kinds = F.array(
        *[
            F.lit(x)
            for x in (
                "unavailable", "mx", "unavailable", "not_found", "unavailable",
                "implicit", "unavailable",
            )
        ]
    )
    rows = I.table(spark, sf, "orders").select(
        F.concat(F.lit("d"), F.col("o_custkey").cast("string"), F.lit(".cl")).alias("domain"),
        F.lit("t").alias("transport"),
        (k % 3).cast("int").alias("transport_order"),
        F.get(kinds, (k % 7).cast("int")).alias("outcome"),
        ((k % 4) * 10).cast("int").alias("preference"),
        F.when(k % 35 == 1, ".")
        .otherwise(F.concat(F.lit("mx"), k.cast("string"), F.lit(".cl.")))
        .alias("exchange"),
        F.when(
            F.get(kinds, (k % 7).cast("int")) == "unavailable",
            F.concat(F.lit("timeout "), (k % 3).cast("string")),
        ).alias("detail"),
    )
    return D.mx_verdicts(rows)


@query(
    "sca_27_implicit_mx",
    """
    SELECT 'd' || s_suppkey || '.cl' AS domain,
      CASE WHEN s_suppkey % 5 = 0 THEN 'unavailable' WHEN s_suppkey % 3 = 0 THEN 'mx'
           WHEN s_suppkey % 2 = 0 THEN 'implicit' ELSE 'not_found' END AS outcome,
      CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 2 <> 0
        THEN 'd' || s_suppkey || '.cl has no MX and no A record' END AS detail
    FROM supplier
    """,
)
def sca_27(spark, sf):
    s = F.col("s_suppkey")
    observed = I.table(spark, sf, "supplier").select(
        F.concat(F.lit("d"), s.cast("string"), F.lit(".cl")).alias("domain"),
        (s % 3 == 0).alias("has_mx"),
        (s % 2 == 0).alias("has_a"),
        (s % 5 == 0).alias("failed"),
    )
    return D.implicit_mx(observed).select("domain", "outcome", "detail")


@query(
    "src_6_doh_answers",
    """
    SELECT * FROM (
      SELECT 'd' || o_orderkey || '.cl' AS domain, 'not_found' AS outcome,
        NULL AS preference, NULL AS exchange,
        'd' || o_orderkey || '.cl does not exist' AS detail
      FROM orders WHERE o_orderkey % 4 = 0
      UNION ALL SELECT 'd' || o_orderkey || '.cl', 'unavailable', NULL, NULL,
        'DoH returned no MX records for d' || o_orderkey || '.cl'
      FROM orders WHERE o_orderkey % 4 IN (1, 2)
      UNION ALL SELECT 'd' || o_orderkey || '.cl', 'mx', n * 10,
        'mx' || n || '.d' || o_orderkey || '.cl', NULL
      FROM orders, (VALUES (1), (2)) v(n) WHERE o_orderkey % 4 = 3)
    """,
)
def src_6(spark, sf):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("d"), k.cast("string"), F.lit(".cl"))
    two = F.concat(
        F.lit('{"Status":0,"Answer":[{"type":15,"data":"10 mx1.'), name,
        F.lit('."},{"type":1,"data":"10.0.0.1"},{"type":15,"data":"20 mx2.'), name,
        F.lit('."}]}'),
    )
    answer = (
        F.when(k % 4 == 0, '{"Status":3}')
        .when(k % 4 == 1, '{"Status":0}')
        .when(k % 4 == 2, '{"Status":0,"Answer":[{"type":5,"data":"x."}]}')
        .otherwise(two)
    )
    path = scratch_path(spark, "src6")
    I.table(spark, sf, "orders").select(
        name.alias("domain"), answer.alias("answer")
    ).write.json(path)
    return taken(D.doh_observations(readers.read_doh_answers(spark, path)), path)


_REPLY_SQL = """
WITH r AS (
  SELECT o_orderkey AS k, [400, 421, 450, 451, 452, 499, 500, 550, 252][o_orderkey % 9 + 1] AS code,
    ['450 4.2.0 GreyListed', 'too busy', 'come back 5.7.1', '552 5.2.2 full', 'x5.1.1',
     '5.1.10 a 4.7.1', 'Deferred', ''][o_orderkey // 9 % 8 + 1] AS message
  FROM orders)
"""
_CODES = (400, 421, 450, 451, 452, 499, 500, 550, 252)
_MESSAGES = (
    "450 4.2.0 GreyListed", "too busy", "come back 5.7.1", "552 5.2.2 full", "x5.1.1",
    "5.1.10 a 4.7.1", "Deferred", "",
)


def _replies(spark, sf):
    k = F.col("o_orderkey")
    return I.table(spark, sf, "orders").select(
        k.alias("k"),
        F.get(F.array(*[F.lit(c) for c in _CODES]), (k % 9).cast("int")).alias("code"),
        F.get(
            F.array(*[F.lit(m) for m in _MESSAGES]), (F.floor(k / 9) % 8).cast("int")
        ).alias("message"),
    )


@query(
    "sca_23_enhanced_code",
    _REPLY_SQL
    + r"""
    SELECT k, try_cast(nullif(regexp_extract(message, '\b[245]\.(\d+)\.(\d+)\b', 1), '') AS INT) AS subject,
              try_cast(nullif(regexp_extract(message, '\b[245]\.(\d+)\.(\d+)\b', 2), '') AS INT) AS detail
    FROM r
    """,
)
def sca_23(spark, sf):
    code = D.enhanced_code(F.col("message"))
    return _replies(spark, sf).select(
        "k", code["subject"].alias("subject"), code["detail"].alias("detail")
    )


@query(
    "sca_24_greylisted",
    _REPLY_SQL
    + """
    SELECT k, code BETWEEN 400 AND 499 AND code <> 421 AND (code IN (450, 451)
      OR regexp_matches(lower(message), 'greylist|grey list|graylist|try again|try later|deferred|come back'))
      AS greylisted FROM r
    """,
)
def sca_24(spark, sf):
    return _replies(spark, sf).select(
        "k", D.looks_greylisted(F.col("code"), F.col("message")).alias("greylisted")
    )


@query(
    "flt_17_unverified_status",
    MAIL
    + f"""
    SELECT email, 'unverified' AS status, '' AS error, 'off' AS mode FROM address
    UNION ALL SELECT email, CASE WHEN c_custkey % 5 = 0 THEN 'unknown'
        WHEN NOT syntax_ok THEN 'invalid' ELSE 'unknown' END,
      CASE WHEN c_custkey % 5 = 0 THEN 'verification timed out'
        WHEN NOT syntax_ok THEN 'Invalid email format'
        WHEN mx_outcome = 'mx' THEN '' ELSE '{V.ERR_MX_LOOKUP}' END, 'on'
    FROM address LEFT JOIN mx_verdict USING (domain)
    """,
)
def flt_17(spark, sf):
    mails = I.addresses(spark, sf)
    off = D.unverified(mails, verify_mx=False)
    judged = D.classify_addresses(
        mails, D.mx_verdicts(I.mx_observations(spark, sf)), smtp_enabled=False
    )
    late = D.unverified(judged, F.col("c_custkey") % 5 == 0)
    # The host's own words after the reason differ by transport.
    reason = F.when(
        F.col("error").startswith(V.ERR_MX_LOOKUP), V.ERR_MX_LOOKUP
    ).otherwise(F.col("error"))
    on = late.withColumn("error", reason)
    return off.select("email", "status", "error", F.lit("off").alias("mode")).unionByName(
        on.select("email", "status", "error", F.lit("on").alias("mode"))
    )


_CATCH_ALL_SQL = MAIL + """
    SELECT domain AS host, CASE WHEN coalesce(mx_outcome, 'unavailable') <> 'mx' THEN 'unreachable'
      WHEN catch_all THEN 'catch-all' ELSE 'selective' END AS outcome,
      CASE WHEN mx_outcome = 'mx' THEN mx_host ELSE '' END AS detail
    FROM catch_all LEFT JOIN mx_verdict USING (domain)
    """


def _catch_all_inputs(spark, sf):
    domains = I.catch_all_probes(spark, sf).select("domain").distinct().withColumn(
        "seq", F.xxhash64("domain")
    )
    return (
        domains,
        D.mx_verdicts(I.mx_observations(spark, sf)),
        D.catch_all_verdicts(I.catch_all_probes(spark, sf)),
    )


@query("agg_20_catch_all_outcome", _CATCH_ALL_SQL)
def agg_20(spark, sf):
    rows = E.catch_all_outcomes(*_catch_all_inputs(spark, sf))
    return rows.select("host", "outcome", "detail")


@query("plan_catch_all_measure", _CATCH_ALL_SQL)
def plan_catch_all_measure(spark, sf):
    run = measures.catch_all_measure(*_catch_all_inputs(spark, sf))
    return run["rows"].select("host", "outcome", "detail")
