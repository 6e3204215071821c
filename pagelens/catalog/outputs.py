"""Queries on result tables, writers and run history.

Writer queries write to the shared folder and return what a reader gets back.
"""

from pyspark.sql import functions as F

from pagelens import schemas
from pagelens.catalog import inputs as I
from pagelens.catalog.base import query
from pagelens.functions import fixed_values as V, text
from pagelens.operators import results as R, sessions as S
from pagelens.operators.shared import scratch_path, taken
from pagelens.sources import writers

RESULT = "WITH " + I.RESULT_SQL
SESSION = "WITH " + I.SESSION_SQL + "," + I.RESULT_SQL


# --- results -------------------------------------------------------------------


@query(
    "agg_1_summarize",
    RESULT
    + """
    , k(status) AS (VALUES ('valid'), ('catch_all'), ('unknown'), ('invalid')),
    c AS (SELECT CASE WHEN session_id % 2 = 0 THEN status ELSE 'unknown' END AS status FROM result)
    SELECT coalesce(k.status, c.status) AS status, count(c.status) AS n
    FROM k FULL JOIN c ON k.status = c.status GROUP BY 1
    UNION ALL SELECT 'total', count(*) FROM result
    """,
)
def agg_1(spark, sf):
    """Every second session lost its statuses; those count as unknown."""
    rows = I.results(spark, sf).withColumn(
        "status", F.when(F.col("session_id") % 2 == 0, F.col("status"))
    )
    return R.summarize(rows)


@query(
    "agg_1_summarize_one_status",
    """
    SELECT * FROM (VALUES ('valid', 0), ('catch_all', 0), ('unknown', 0)) v(status, n)
    UNION ALL SELECT 'invalid', count(*) FROM events
    UNION ALL SELECT 'total', count(*) FROM events
    """,
)
def agg_1_one(spark, sf):
    return R.summarize(I.results(spark, sf).withColumn("status", F.lit("invalid")))


@query(
    "agg_2_short_summary",
    RESULT
    + """
    SELECT count(*) AS total, count(*) FILTER (status = 'valid') AS valid,
      count(*) FILTER (status = 'unknown') AS unknown, count(*) FILTER (status = 'invalid') AS invalid
    FROM result
    """,
)
def agg_2(spark, sf):
    return R.short_summary(I.results(spark, sf))


@query("flt_12_search_results_text", RESULT + "SELECT id, email, source FROM result WHERE contains(email, 'u1@c') OR contains(source, 'u1@c')")
def flt_12(spark, sf):
    return R.search(I.results(spark, sf), "U1@C").select("id", "email", "source")


@query("flt_13_valid_projection", RESULT + "SELECT email FROM result WHERE status = 'valid'")
def flt_13(spark, sf):
    return R.valid_addresses(I.results(spark, sf))


@query(
    "flt_15_answered",
    """
    SELECT event_id AS id, ['ok', 'none', 'http 500', 'error'][event_id % 4 + 1] AS outcome
    FROM events WHERE event_id % 4 < 2
    """,
)
def flt_15(spark, sf):
    from pagelens.operators.estimates import is_answered

    kinds = F.array(*[F.lit(o) for o in ("ok", "none", "http 500", "error")])
    rows = I.table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.get(kinds, (F.col("event_id") % 4).cast("int")).alias("outcome"),
    )
    return rows.filter(is_answered())


@query("top_6_sortable_results", RESULT + "SELECT id, source, status FROM result")
def top_6(spark, sf):
    return R.sort_results(I.results(spark, sf), "source", True).select("id", "source", "status")


@query(
    "sca_26_normalize_record",
    RESULT
    + """
    SELECT email, source, status, coalesce(error, '') AS error, generated, hidden,
      evidence IS NULL AS not_looked FROM result
    """,
)
def sca_26(spark, sf):
    rows = R.normalize_records(I.results(spark, sf))
    return rows.withColumn("not_looked", F.col("evidence").isNull()).drop("evidence")


@query(
    "sca_33_status_labels",
    RESULT
    + """
    SELECT id, CASE status WHEN 'valid' THEN 'Válido' WHEN 'catch_all' THEN 'Acepta todo'
      WHEN 'unknown' THEN 'Desconocido' WHEN 'invalid' THEN 'Inválido' ELSE status END AS label
    FROM result
    """,
)
def sca_33(spark, sf):
    return I.results(spark, sf).select(
        "id", text.label(F.col("status"), V.ROW_LABELS).alias("label")
    )


@query(
    "sca_34_html_escape",
    """
    SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'),
      '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped FROM pages
    """,
)
def sca_34(spark, sf):
    return I.pages(spark, sf).select(
        "page_id", F.md5(text.escape_html(F.col("html"))).alias("escaped")
    )


@query(
    "sca_35_export_stamp",
    "SELECT event_id AS id, true AS well_formed, true AS recent FROM events",
)
def sca_35(spark, sf):
    """The clock cannot be compared; its shape and closeness can."""
    stamp = R.export_stamp()
    return I.table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.rlike(stamp, F.lit(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:\d\d)$")).alias("well_formed"),
        (F.abs(F.unix_timestamp(F.to_timestamp(stamp)) - F.unix_timestamp()) < 600).alias("recent"),
    )


# --- writers -----------------------------------------------------------------------


@query(
    "snk_1_valid_csv",
    RESULT
    + """
    SELECT email, source, status, coalesce(error, '') AS error FROM result
    WHERE status = 'valid' AND NOT coalesce(hidden, false)
    """,
)
def snk_1(spark, sf):
    path = scratch_path(spark, "snk1") + ".csv"
    writers.write_valid_csv(I.results(spark, sf), path)
    back = spark.read.option("header", True).option("escape", '"').schema(schemas.EXPORT).csv(path)
    return taken(back.withColumn("error", F.coalesce("error", F.lit(""))), path)


_RECORD_SQL = RESULT + """
SELECT email, source, status, coalesce(error, '') AS error, generated, hidden, evidence FROM result
"""


@query("snk_2_record_json", _RECORD_SQL)
def snk_2(spark, sf):
    path = scratch_path(spark, "snk2")
    writers.write_records_json(I.results(spark, sf), path)
    back = spark.read.schema(schemas.RESULTS).json(path)
    return taken(
        back.withColumn("evidence", F.array_join("evidence", ", ")),
        path,
        writers.summary_path(path),
    )


@query(
    "snk_2_run_summary",
    RESULT
    + """
    , c AS (SELECT status, count(*) AS n FROM result GROUP BY status
            UNION ALL SELECT unnest(['valid', 'catch_all', 'unknown', 'invalid']), 0
            UNION ALL SELECT 'total', count(*) FROM result)
    SELECT 'pagelens' AS tool, '1' AS version, status, sum(n)::BIGINT AS n FROM c GROUP BY status
    """,
)
def snk_2_summary(spark, sf):
    """The metadata of an export, read back: every status, foreseen or not."""
    path = scratch_path(spark, "snk2s") + ".json"
    writers.write_results(I.results(spark, sf), path)
    kind = "tool STRING, version STRING, exported_at STRING, summary MAP<STRING, BIGINT>"
    back = spark.read.schema(kind).json(writers.summary_path(path))
    rows = back.select("tool", "version", F.explode("summary").alias("status", "n"))
    return taken(rows, path, writers.summary_path(path))


_REPORT_SQL = RESULT + """
SELECT email, source, true AS linked, status AS row_class,
  CASE status WHEN 'valid' THEN 'Válido' WHEN 'catch_all' THEN 'Acepta todo'
    WHEN 'unknown' THEN 'Desconocido' WHEN 'invalid' THEN 'Inválido' ELSE status END AS status,
  CASE WHEN evidence IS NULL THEN '' WHEN evidence = '' THEN 'sin evidencia' ELSE evidence END AS evidence,
  CASE WHEN generated THEN 'generado' ELSE '' END AS generated_mark,
  CASE WHEN hidden THEN 'oculto' ELSE '' END AS hidden_mark,
  coalesce('e&lt;' || (id % 3) || '&gt;&amp;&quot;', '') AS error
FROM result WHERE id % 4 <> 0
UNION ALL SELECT email, source, true, status,
  CASE status WHEN 'valid' THEN 'Válido' WHEN 'catch_all' THEN 'Acepta todo'
    WHEN 'unknown' THEN 'Desconocido' WHEN 'invalid' THEN 'Inválido' ELSE status END,
  CASE WHEN evidence IS NULL THEN '' WHEN evidence = '' THEN 'sin evidencia' ELSE evidence END,
  CASE WHEN generated THEN 'generado' ELSE '' END, CASE WHEN hidden THEN 'oculto' ELSE '' END, ''
FROM result WHERE id % 4 = 0
"""


@query("snk_3_report_rows", _REPORT_SQL)
def snk_3(spark, sf):
    return R.report_rows(I.results(spark, sf))


@query(
    "snk_4_tsv_rows",
    RESULT + "SELECT email || chr(9) || status || chr(9) || source AS value FROM result",
)
def snk_4(spark, sf):
    path = scratch_path(spark, "snk4")
    writers.write_tsv(I.results(spark, sf), path)
    return taken(spark.read.text(path), path)


@query(
    "snk_5_write_results",
    RESULT
    + """
    SELECT fmt, count(*) AS written FROM (
      SELECT 'csv' AS fmt FROM result WHERE status = 'valid' AND NOT coalesce(hidden, false)
      UNION ALL SELECT 'json' FROM result UNION ALL SELECT 'html' FROM result) GROUP BY fmt
    """,
)
def snk_5(spark, sf):
    base = scratch_path(spark, "snk5")
    rows = I.results(spark, sf)
    for extension in ("csv", "json", "htm"):
        writers.write_results(rows, f"{base}/out.{extension}")
    read = [
        spark.read.option("header", True).schema(schemas.EXPORT).csv(f"{base}/out.csv").select(F.lit("csv").alias("fmt")),
        spark.read.schema("email STRING").json(f"{base}/out.json").select(F.lit("json").alias("fmt")),
        spark.read.schema("email STRING").json(f"{base}/out.htm").select(F.lit("html").alias("fmt")),
    ]
    every = read[0].unionByName(read[1]).unionByName(read[2])
    return taken(every.groupBy("fmt").agg(F.count(F.lit(1)).alias("written")), base)


@query(
    "snk_6_per_target_append",
    RESULT + "SELECT split_part(email, '@', 2) AS domain, email, source, status FROM result",
)
def snk_6(spark, sf):
    path = scratch_path(spark, "snk6")
    rows = I.results(spark, sf).select(
        F.element_at(F.split("email", "@"), 2).alias("domain"), "email", "source", "status", "id"
    )
    for half in (0, 1):
        writers.append_by_target(rows.filter(F.col("id") % 2 == half).drop("id"), path)
    back = spark.read.schema("email STRING, source STRING, status STRING, domain STRING")
    return taken(back.parquet(path), path)


@query(
    "snk_6_repeated_append",
    RESULT + "SELECT split_part(email, '@', 2) AS domain, email, source, status FROM result",
)
def snk_6_repeated(spark, sf):
    """One write is repeated; a third was broken off before it was on record."""
    path = scratch_path(spark, "snk6r")
    rows = I.results(spark, sf).select(
        F.element_at(F.split("email", "@"), 2).alias("domain"), "email", "source", "status", "id"
    )
    for write_id, half in (("even", 0), ("odd", 1), ("even", 0)):
        some = rows.filter(F.col("id") % 2 == half).drop("id")
        writers.append_by_target(some, path, write_id=write_id)
    rows.drop("id").withColumn("write_id", F.lit("broken")).write.mode("append").partitionBy(
        "domain", "write_id"
    ).parquet(path)
    schema = "email STRING, source STRING, status STRING, domain STRING"
    return taken(
        writers.read_appended(spark, path, schema), path, writers.committed_path(path)
    )


@query(
    "snk_7_measure_csv",
    """
    SELECT 'h' || event_id AS host, 's' || user_id || '.cl' AS sibling, event_type AS outcome,
      '"' || event_type || '", x' AS detail, value AS seconds FROM events
    """,
)
def snk_7(spark, sf):
    path = scratch_path(spark, "snk7")
    kind = F.col("event_type")
    rows = I.table(spark, sf, "events").select(
        F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("host"),
        F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit(".cl")).alias("sibling"),
        kind.alias("outcome"),
        F.concat(F.lit('"'), kind, F.lit('", x')).alias("detail"),
        F.col("value").alias("seconds"),
    )
    writers.write_measures(rows, path)
    back = spark.read.option("header", True).option("escape", '"')
    return taken(back.schema(schemas.PROBE_ROWS).csv(path), path)


# --- history ---------------------------------------------------------------------------


@query(
    "snk_8_new_session",
    """
    SELECT o_custkey AS id, '@' || (o_custkey % 9) || '.cl' AS target_domain,
      string_agg('https://s.cl/' || o_orderkey, ',' ORDER BY o_orderkey) AS seed_urls,
      0 AS total_found, 0 AS total_valid
    FROM orders GROUP BY o_custkey
    """,
)
def snk_8(spark, sf):
    seeds = I.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"),
        F.concat(F.lit("https://s.cl/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.col("o_orderkey").alias("rank"),
    )
    rows = S.session_rows(I.sessions(spark, sf).select("id", "target_domain"), seeds)
    path = scratch_path(spark, "snk8")
    writers.append_table(rows, path)
    return taken(spark.read.schema(schemas.SESSIONS).parquet(path).drop("created_at"), path)


@query(
    "snk_8_session_seeds",
    """
    SELECT o_custkey AS session_id, o_orderkey AS rank, 'https://s.cl/' || o_orderkey AS url
    FROM orders
    """,
)
def snk_8_seeds(spark, sf):
    """Seeds of a session as rows: no list is gathered, however long."""
    seeds = I.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"),
        F.concat(F.lit("https://s.cl/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.col("o_orderkey").alias("rank"),
    )
    path = scratch_path(spark, "snk8s")
    writers.append_table(S.seed_rows(seeds), path)
    return taken(spark.read.parquet(path), path)


@query(
    "snk_9_save_emails",
    RESULT
    + """
    SELECT session_id, email, source AS source_url,
      CASE WHEN id % 3 = 0 THEN 'unknown' ELSE status END AS status FROM result
    """,
)
def snk_9(spark, sf):
    rows = I.results(spark, sf).withColumn(
        "status", F.when(F.col("id") % 3 != 0, F.col("status"))
    )
    path = scratch_path(spark, "snk9")
    writers.append_table(S.email_rows(rows), path)
    back = spark.read.schema(
        "session_id BIGINT, email STRING, source_url STRING, status STRING"
    )
    return taken(back.parquet(path), path)


@query(
    "snk_10_update_status",
    RESULT
    + """
    , u AS (SELECT session_id, email, arg_max('s' || (id % 7), id) AS fresh FROM result
            WHERE session_id % 3 = 0 AND status = 'signup' GROUP BY ALL)
    SELECT r.id, r.session_id, r.email, coalesce(u.fresh, r.status) AS status
    FROM result r LEFT JOIN u USING (session_id, email)
    """,
)
def snk_10(spark, sf):
    emails = I.session_emails(spark, sf)
    updates = emails.filter("session_id % 3 = 0 AND status = 'signup'").select(
        "session_id",
        "email",
        F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("status"),
        F.col("id").alias("seq"),
    )
    return S.update_status(emails, updates).drop("source_url")


@query(
    "snk_10_stored_update",
    RESULT
    + """
    , u AS (SELECT session_id, email, arg_max('s' || (id % 7), id) AS fresh FROM result
            WHERE session_id % 100 = 3 AND status = 'signup' GROUP BY ALL)
    SELECT r.id, r.session_id, r.email, coalesce(u.fresh, r.status) AS status
    FROM result r LEFT JOIN u USING (session_id, email)
    """,
)
def snk_10_stored(spark, sf):
    """A stored table, two equal updates; only the folders named are written."""
    path = scratch_path(spark, "snk10")
    emails = I.session_emails(spark, sf)
    writers.append_table(writers.in_folders(emails, "session_id", 20), path, "folder")
    updates = emails.filter("session_id % 100 = 3 AND status = 'signup'").select(
        "session_id",
        "email",
        F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("status"),
        F.col("id").alias("seq"),
    )
    for _ in range(2):
        writers.update_status_at(spark, path, updates, wide=20)
    back = spark.read.schema(f"{schemas.SESSION_EMAILS}, folder BIGINT").parquet(path)
    return taken(back.drop("source_url", "folder"), path)


_TOTALS_SQL = """
SELECT session_id, count(*) AS total_found, count(*) FILTER (status = 'valid') AS total_valid
FROM result GROUP BY session_id
"""


@query("agg_3_session_totals", RESULT + _TOTALS_SQL)
def agg_3(spark, sf):
    return S.session_totals(I.session_emails(spark, sf))


@query(
    "snk_11_update_totals",
    SESSION
    + f"""
    , t AS ({_TOTALS_SQL})
    SELECT id, target_domain, coalesce(total_found, 0) AS total_found, coalesce(total_valid, 0) AS total_valid
    FROM session LEFT JOIN t ON t.session_id = id
    """,
)
def snk_11(spark, sf):
    updated = S.update_totals(I.sessions(spark, sf), I.session_emails(spark, sf))
    return updated.select("id", "target_domain", "total_found", "total_valid")


@query(
    "snk_11_stored_totals",
    SESSION
    + f"""
    , t AS ({_TOTALS_SQL})
    SELECT id, target_domain, CASE WHEN id % 10 = 1 THEN coalesce(total_found, 0) ELSE 0 END AS total_found,
      CASE WHEN id % 10 = 1 THEN coalesce(total_valid, 0) ELSE 0 END AS total_valid
    FROM session LEFT JOIN t ON t.session_id = id
    """,
)
def snk_11_stored(spark, sf):
    """Totals of every tenth session, written to the stored table."""
    path = scratch_path(spark, "snk11")
    sessions = I.sessions(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp"))
    writers.append_table(writers.in_folders(sessions, "id", 10), path, "folder")
    emails = I.session_emails(spark, sf).filter("session_id % 10 = 1")
    writers.update_totals_at(spark, path, emails, wide=10)
    back = spark.read.schema(f"{schemas.SESSIONS}, folder BIGINT").parquet(path)
    return taken(back.select("id", "target_domain", "total_found", "total_valid"), path)


@query(
    "src_9_load_session",
    RESULT + "SELECT email, source, status FROM result WHERE session_id = 7",
)
def src_9(spark, sf):
    return S.load_session(I.session_emails(spark, sf), 7)


@query(
    "top_5_list_sessions",
    SESSION + "SELECT id, strftime(created_at, '%Y-%m-%d') AS created, target_domain FROM session ORDER BY id DESC LIMIT 10",
)
def top_5(spark, sf):
    return S.list_sessions(I.sessions(spark, sf)).select(
        "id", F.date_format("created_at", "yyyy-MM-dd").alias("created"), "target_domain"
    )


@query(
    "win_3_keep_last_10",
    SESSION
    + """
    SELECT id, target_domain, (SELECT count(*) FROM result) AS emails_left FROM session
    ORDER BY id DESC LIMIT 10
    """,
)
def win_3(spark, sf):
    """Address rows of pruned sessions stay, so their count is unchanged."""
    left = I.session_emails(spark, sf).agg(F.count(F.lit(1))).scalar()
    kept = S.prune_sessions(I.sessions(spark, sf)).select("id", "target_domain")
    return kept.withColumn("emails_left", left)


@query(
    "join_12_session_emails",
    SESSION
    + """
    SELECT r.id, session_id, email, status, target_domain FROM result r JOIN session s ON s.id = session_id
    """,
)
def join_12(spark, sf):
    joined = S.session_emails(I.sessions(spark, sf), I.session_emails(spark, sf))
    return joined.select("id", "session_id", "email", "status", "target_domain")
