"""Explicit schemas of the tables that pass between jobs (DDL text)."""

from pyspark.sql import types as T


PAGES = "page_id BIGINT, url STRING, html STRING, crawl_seq BIGINT"
RESPONSES = (
    "url STRING, status INT, headers MAP<STRING,STRING>, html STRING"
)
CONTACTS = "email STRING, source STRING, hidden BOOLEAN"
DISCOVERIES = (
    "email STRING, source STRING, generated BOOLEAN, "
    "evidence ARRAY<STRING>, hidden BOOLEAN"
)
RESULTS = (
    "email STRING, source STRING, status STRING, error STRING, "
    "evidence ARRAY<STRING>, generated BOOLEAN, hidden BOOLEAN"
)
EXPORT = "email STRING, source STRING, status STRING, error STRING"
MX_OBSERVATIONS = (
    "domain STRING, transport STRING, transport_order INT, outcome STRING, "
    "preference INT, exchange STRING, detail STRING"
)
SMTP_REPLIES = "email STRING, code INT, message STRING, error STRING"
CATCH_ALL_PROBES = "domain STRING, probe_no INT, code INT"
CT_CRTSH = "name_value STRING"
CT_CERTSPOTTER = "dns_names ARRAY<STRING>"
DOH_ANSWER = (
    "Status INT, Answer ARRAY<STRUCT<type: INT, data: STRING>>"
)
HOST_PROBES = "host STRING, resolved BOOLEAN, http_status INT"
SESSIONS = (
    "id BIGINT, created_at TIMESTAMP, target_domain STRING, "
    "seed_urls STRING, total_found INT, total_valid INT"
)
SESSION_EMAILS = (
    "id BIGINT, session_id BIGINT, email STRING, source_url STRING, "
    "status STRING"
)
PROBE_ROWS = (
    "host STRING, sibling STRING, outcome STRING, detail STRING, "
    "seconds DOUBLE"
)
KEYSERVER_ROWS = (
    "domain STRING, entity STRING, server STRING, outcome STRING, "
    "`count` INT, addresses STRING"
)
PREVALENCE_ROWS = (
    "domain STRING, outcome STRING, payloads INT, decoded_cl INT, "
    "new_addresses INT, sample STRING"
)
FACTS = (
    T.StructType()
    .add("lang", T.StringType())
    .add("text", T.StringType())
    .add("visible_text", T.StringType())
    .add("hidden_texts", T.ArrayType(T.StringType()))
    .add(
        "anchors",
        T.ArrayType(
            T.StructType()
            .add("href", T.StringType())
            .add("url", T.StringType())
            .add("hidden", T.BooleanType())
            .add("pos", T.IntegerType())
        ),
    )
    .add(
        "payloads",
        T.ArrayType(
            T.StructType()
            .add("hex", T.StringType())
            .add("hidden", T.BooleanType())
        ),
    )
)
