"""Queries that run a stream to its end and return what it wrote."""

from pyspark.sql import functions as F

from pagelens.catalog import inputs as I
from pagelens.catalog.base import query
from pagelens.operators import verdicts as D
from pagelens.operators.shared import scratch_path, taken
from pagelens.streaming import discoveries as S, keyed

CONTACT = "WITH " + I.CONTACT_SQL
_ARRIVING = "page_id BIGINT, url STRING, html STRING, crawl_seq BIGINT"


def _arrivals(spark, sf, base):
    """The derived pages written as eight files, then read as a stream."""
    path = f"{base}/arrivals"
    I.contact_pages(spark, sf).repartition(8, "page_id").write.parquet(path)
    return S.stream_pages(spark, path, _ARRIVING, files_per_batch=3)


def _finish(stream, spark, base, schema, partition=None):
    S.write_batches(stream, f"{base}/out", f"{base}/state", partition).awaitTermination()
    return taken(spark.read.schema(schema).parquet(f"{base}/out"), base)


@query("str_1_stream_discoveries", CONTACT + "SELECT email, url AS source, hidden FROM published")
def str_1(spark, sf):
    base = scratch_path(spark, "str1")
    found = S.stream_contacts(_arrivals(spark, sf, base)).select("email", "source", "hidden")
    return _finish(found, spark, base, "email STRING, source STRING, hidden BOOLEAN")


@query("str_2_seen_state", CONTACT + "SELECT DISTINCT email FROM published")
def str_2(spark, sf):
    base = scratch_path(spark, "str2")
    once = S.emit_once(S.stream_contacts(_arrivals(spark, sf, base)).select("email"))
    return _finish(once, spark, base, "email STRING")


def _mail_tables(spark, sf):
    """Mail hosts, replies and catch-all verdicts of the pages' domains."""
    domains = I.catch_all_probes(spark, sf).select("domain").distinct()
    mx = domains.select(
        "domain", F.lit("mx").alias("mx_outcome"), F.lit(None).cast("string").alias("mx_detail")
    )
    host = F.regexp_extract("url", r"www\.([^/]*)", 1)
    replies = I.contact_pages(spark, sf).select(
        F.concat(F.lit("s"), (F.col("page_id") % 50).cast("string"), F.lit("@"), host).alias("email"),
        F.lit(250).alias("code"),
        F.lit("ok").alias("message"),
        F.lit(None).cast("string").alias("error"),
    ).distinct()
    return mx, replies, D.catch_all_verdicts(I.catch_all_probes(spark, sf))


_JUDGED = """CASE WHEN length(split_part(email, '@', 2)) % 2 = 0 THEN 'catch_all' ELSE 'valid' END"""


@query(
    "str_3_catch_all_state",
    CONTACT + f"SELECT DISTINCT email, {_JUDGED} AS status FROM published",
)
def str_3(spark, sf):
    base = scratch_path(spark, "str3")
    once = S.emit_once(S.stream_contacts(_arrivals(spark, sf, base)).select("email"))
    judged = S.classify_stream(once, *_mail_tables(spark, sf)).select("email", "status")
    return _finish(judged, spark, base, "email STRING, status STRING")


@query(
    "str_3_streamed_probes",
    CONTACT
    + f"SELECT email, url AS source, hidden, {_JUDGED} = 'catch_all' AS catch_all FROM published",
)
def str_3_probes(spark, sf):
    """Probes arrive between the pages; the verdict is that of the batch."""
    base = scratch_path(spark, "str3p")
    path = f"{base}/arrivals"
    size = I.table(spark, sf, "customer").count()
    I.contact_pages(spark, sf).repartition(4, "page_id").write.parquet(path)
    keyed.end_of_run(spark, path, _ARRIVING)
    asked = f"{base}/probes"
    answers = "domain STRING, probe_no INT, code INT, crawl_seq BIGINT"
    I.catch_all_probes(spark, sf).select(
        "domain", "probe_no", "code", F.col("probe_no").cast("bigint").alias("crawl_seq")
    ).repartition(2, "domain", "probe_no").write.parquet(asked)
    spark.range(1).select(
        F.lit("").alias("domain"), F.lit(0).alias("probe_no"), F.lit(0).alias("code"),
        F.lit(keyed.END_PLACE).alias("crawl_seq"),
    ).write.mode("append").parquet(asked)
    # Everything may come in any order here, so nothing is ever late.
    pages = keyed.in_order(S.stream_pages(spark, path, _ARRIVING, files_per_batch=2), size + 10)
    probes = keyed.in_order(
        spark.readStream.schema(answers).option("maxFilesPerTrigger", 1).parquet(asked), size + 10
    )
    contacts = S.stream_contacts(pages, keep=["at"])
    judged = keyed.catch_all_stream(contacts, probes, size + 10, salts=4)
    kept = judged.select("email", "source", "hidden", "catch_all")
    return _finish(kept, spark, base, "email STRING, source STRING, hidden BOOLEAN, catch_all BOOLEAN")


@query(
    "win_1_streamed_first_seen",
    CONTACT + "SELECT email, arg_min(url, k) AS source, arg_min(hidden, k) AS hidden FROM published GROUP BY email",
)
def win_1_streamed(spark, sf):
    """Pages arrive in any order; the first in crawl order gives the flags."""
    base = scratch_path(spark, "win1")
    path = f"{base}/arrivals"
    size = I.table(spark, sf, "customer").count()
    I.contact_pages(spark, sf).repartition(6, "page_id").write.parquet(path)
    keyed.end_of_run(spark, path, _ARRIVING)
    pages = keyed.in_order(S.stream_pages(spark, path, _ARRIVING, files_per_batch=3), size + 10)
    contacts = S.stream_contacts(pages, keep=["crawl_seq", "at"])
    first = keyed.first_seen_stream(contacts).select("email", "source", "hidden")
    return _finish(first, spark, base, "email STRING, source STRING, hidden BOOLEAN")


_COUNTED = "pages_read pages_blocked pages_failed found verified valid invalid unknown catch_all".split()


@query(
    "str_4_progress",
    CONTACT
    + ","
    + I.RESPONSE_SQL
    + f"""
    SELECT 3 AS batches, (SELECT count(*) FROM contact) + count(*) FILTER (outcome = 'read') AS pages_read,
      count(*) FILTER (outcome = 'blocked') AS pages_blocked, count(*) FILTER (outcome = 'failed') AS pages_failed,
      (SELECT count(*) FROM published) AS found, (SELECT count(*) FROM published) AS verified,
      (SELECT count(*) FROM published WHERE {_JUDGED} = 'valid') AS valid, 0 AS invalid, 0 AS unknown,
      (SELECT count(*) FROM published WHERE {_JUDGED} = 'catch_all') AS catch_all
    FROM judged
    """,
)
def str_4(spark, sf):
    """Counts noted batch by batch, of pages and of recorded responses."""
    base = scratch_path(spark, "str4")
    plain = I.contact_pages(spark, sf).select(
        "url", "html", "crawl_seq", F.lit(200).alias("status"),
        F.create_map().cast("map<string,string>").alias("headers"),
    )
    arriving = plain.unionByName(I.responses(spark, sf).select(plain.columns))
    arriving.repartition(8, "url").write.parquet(f"{base}/arrivals")
    schema = "url STRING, html STRING, crawl_seq BIGINT, status INT, headers MAP<STRING,STRING>"
    pages = S.stream_pages(spark, f"{base}/arrivals", schema, files_per_batch=3)
    tables = _mail_tables(spark, sf)
    S.write_counted(
        pages, lambda c: S.classify_stream(c, *tables), f"{base}/out", f"{base}/counts", f"{base}/state"
    ).awaitTermination()
    counted = S.batch_counts(spark, f"{base}/counts").agg(
        F.count(F.lit(1)).cast("int").alias("batches"), *[F.sum(c).alias(c) for c in _COUNTED]
    )
    return taken(counted, base)


@query("str_5_stop", CONTACT + "SELECT email, url AS source FROM published")
def str_5(spark, sf):
    """Stopped as soon as possible, then resumed from the same checkpoint."""
    base = scratch_path(spark, "str5")
    path, state = f"{base}/out", f"{base}/state"
    found = S.stream_contacts(_arrivals(spark, sf, base)).select("email", "source")
    S.stop_when(S.write_batches(found, path, state), lambda: True, poll_seconds=0.2)
    S.write_batches(found, path, state).awaitTermination()
    return taken(spark.read.schema("email STRING, source STRING").parquet(path), base)


@query(
    "str_6_incremental_sink",
    CONTACT + "SELECT split_part(email, '@', 2) AS domain, email, url AS source FROM published",
)
def str_6(spark, sf):
    base = scratch_path(spark, "str6")
    found = S.stream_contacts(_arrivals(spark, sf, base)).select(
        "email", "source", F.element_at(F.split("email", "@"), 2).alias("domain")
    )
    return _finish(
        found, spark, base, "email STRING, source STRING, domain STRING", "domain"
    )
