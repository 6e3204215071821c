from pyspark.sql import functions as F

from pagelens import schemas
from pagelens.operators import verdicts as D
from pagelens.plans.verify import verify_list

MX = [("a.cl", "mx", None), ("todo.cl", "mx", None), ("no.cl", "not_found", "no.cl does not exist"),
      ("mal.cl", "unavailable", "timeout; DoH"), ("ip.cl", "implicit", None)]
REPLIES = [
    # address, code, message, failure, status, error starts with, smtp_ok, greylisted
    ("v@a.cl", 250, "ok", None, "valid", "", True, False),
    ("i@ip.cl", 250, "ok", None, "valid", "", True, False),
    ("c@todo.cl", 250, "ok", None, "catch_all", "Domain accepts all", True, False),
    ("u1@a.cl", 550, "5.1.1 no such user", None, "invalid", "SMTP RCPT code 550", False, False),
    ("u2@a.cl", 550, "5.7.1 blocked", None, "unknown", "SMTP RCPT code 550: refused", False, False),
    ("u3@a.cl", 550, "5.4.1 routing", None, "unknown", "SMTP RCPT code 550: refused", False, False),
    ("u4@a.cl", 550, "no", None, "invalid", "SMTP RCPT code 550", False, False),
    ("u5@a.cl", 552, "5.2.2 over quota", None, "unknown", "SMTP RCPT code 552: mailbox full", False, False),
    ("u6@a.cl", 550, None, None, "invalid", "SMTP RCPT code 550", False, False),
    ("u7@a.cl", 553, "5.2.1 disabled", None, "invalid", "SMTP RCPT code 553", False, False),
    ("g1@a.cl", 450, "4.2.0", None, "unknown", "SMTP RCPT code 450 (greylisted", False, True),
    ("g2@a.cl", 421, "try again", None, "unknown", "SMTP RCPT code 421", False, False),
    ("g3@a.cl", 452, "Temporarily Deferred", None, "unknown", "SMTP RCPT code 452 (greylisted", False, True),
    ("g4@a.cl", 452, "full", None, "unknown", "SMTP RCPT code 452", False, False),
    ("w@a.cl", 252, "cannot", None, "unknown", "SMTP RCPT code 252", False, False),
    ("e@a.cl", None, None, "refused", "unknown", "SMTP error: refused", None, False),
    ("sin@a.cl", None, None, None, "unknown", "SMTP error: ", None, False),
    ("x@no.cl", 250, "ok", None, "invalid", "No MX record: no.cl does not exist", None, False),
    ("x@mal.cl", 250, "ok", None, "unknown", "MX lookup failed: timeout; DoH", None, False),
    ("x@nunca.cl", 250, "ok", None, "unknown", "MX lookup failed: ", None, False),
    ("no-es", None, None, None, "invalid", "Invalid email format", None, False),
    ("a@b@a.cl", None, None, None, "invalid", "Invalid email format", None, False),
    ("a@a.com", None, None, None, "invalid", "Invalid email format", None, False),
    ("V@A.CL", None, None, None, "unknown", "", None, False),
]


def judged(spark, smtp_enabled=True):
    addresses = spark.createDataFrame([(r[0], "s") for r in REPLIES], "email STRING, source STRING")
    mx = spark.createDataFrame(MX, "domain STRING, mx_outcome STRING, mx_detail STRING")
    replies = spark.createDataFrame(
        [(r[0], r[1], r[2], r[3]) for r in REPLIES if r[1] is not None or r[3] is not None],
        schemas.SMTP_REPLIES,
    )
    probes = spark.createDataFrame(
        [("todo.cl", 1, 250), ("todo.cl", 2, 250), ("a.cl", 1, 250), ("a.cl", 2, 550),
         ("ip.cl", 1, 250)],
        schemas.CATCH_ALL_PROBES,
    )
    out = D.classify_addresses(
        addresses, mx, replies, D.catch_all_verdicts(probes), smtp_enabled
    )
    return {r.email: r for r in out.collect()}


def test_decision_table(spark):
    got = judged(spark)
    for email, _, _, _, status, error, smtp_ok, grey in REPLIES[:-1]:
        row = got[email]
        assert (row.status, row.smtp_ok, row.greylisted) == (status, smtp_ok, grey), email
        assert row.error.startswith(error) and (error or row.error == ""), email
    assert got["g2@a.cl"].error == "SMTP RCPT code 421"
    assert not got["x@no.cl"].mx_ok and got["v@a.cl"].mx_ok


def test_without_smtp_nothing_is_valid(spark):
    got = judged(spark, smtp_enabled=False)
    assert {r.status for r in got.values()} == {"unknown", "invalid"}
    assert got["v@a.cl"].error == "" and got["v@a.cl"].smtp_ok is None
    assert got["x@no.cl"].status == "invalid"


def test_catch_all_needs_every_probe(spark):
    probes = spark.createDataFrame(
        [("si.cl", 1, 250), ("si.cl", 2, 250), ("no.cl", 1, 250), ("no.cl", 2, 550),
         ("mal.cl", 1, 250), ("mal.cl", 2, None), ("uno.cl", 1, 250)],
        schemas.CATCH_ALL_PROBES,
    )
    got = dict(D.catch_all_verdicts(probes).collect())
    assert got == {"si.cl": True, "no.cl": False, "mal.cl": False, "uno.cl": False}


def observed(*rows):
    return [(d, t, o, out, p, x, why) for d, t, o, out, p, x, why in rows]


def test_transport_order(spark):
    rows = [
        ("a.cl", "system", 0, "unavailable", None, None, "timeout"),
        ("a.cl", "public", 1, "mx", 20, "b.", None),
        ("a.cl", "public", 1, "mx", 10, "z.a.cl.", None),
        ("a.cl", "public", 1, "mx", 10, "y.a.cl.", None),
        ("a.cl", "doh", 2, "mx", 0, "never.", None),
        ("gone.cl", "system", 0, "not_found", None, None, "gone.cl does not exist"),
        ("gone.cl", "public", 1, "mx", 0, "never.", None),
        ("null.cl", "system", 0, "mx", 0, ".", None),
        ("down.cl", "doh", 2, "unavailable", None, None, "DoH 500"),
        ("down.cl", "system", 0, "unavailable", None, None, "timeout"),
        ("ip.cl", "system", 0, "implicit", None, None, None),
    ]
    table = spark.createDataFrame(rows, schemas.MX_OBSERVATIONS)
    got = {r.domain: (r.mx_outcome, r.mx_host, r.mx_detail) for r in D.mx_verdicts(table).collect()}
    assert got == {
        "a.cl": ("mx", "y.a.cl", None),
        "gone.cl": ("not_found", None, "gone.cl does not exist"),
        "null.cl": (
            "not_found", None, "null.cl publishes a null MX (RFC 7505): it accepts no mail"
        ),
        "down.cl": ("unavailable", None, "timeout; DoH 500"),
        "ip.cl": ("implicit", "ip.cl", None),
    }


def test_doh_answers(spark):
    answers = [
        ("a.cl", '{"Status":0,"Answer":[{"type":15,"data":"10 mx.a.cl."},{"type":5,"data":"c."}]}'),
        ("b.cl", '{"Status":3}'),
        ("c.cl", '{"Status":0,"Answer":[{"type":1,"data":"1.2.3.4"}]}'),
        ("d.cl", '{"Status":0,"Answer":[{"type":15,"data":"0 ."}]}'),
        ("e.cl", "no es json"),
    ]
    table = D.doh_observations(spark.createDataFrame(answers, "domain STRING, answer STRING"))
    got = {r.domain: (r.outcome, r.preference, r.exchange) for r in table.collect()}
    assert got == {
        "a.cl": ("mx", 10, "mx.a.cl"),
        "b.cl": ("not_found", None, None),
        "c.cl": ("unavailable", None, None),
        "d.cl": ("mx", 0, ""),
        "e.cl": ("unavailable", None, None),
    }


def test_verify_list_has_no_evidence_field(spark):
    lines = spark.createDataFrame(
        [("v@a.cl",), ("# nota",), ("",), ("x@a.cl\tunknown\thttps://s.cl/",)], "value STRING"
    )
    mx = spark.createDataFrame(
        [("a.cl", "system", 0, "mx", 10, "mx.a.cl.", None)], schemas.MX_OBSERVATIONS
    )
    run = verify_list(lines, mx, smtp_enabled=False)
    assert "evidence" not in run["results"].columns
    assert sorted(r.value for r in run["lines"].collect()) == [
        "v@a.cl\tunknown\t",
        "x@a.cl\tunknown\thttps://s.cl/",
    ]


def test_one_domain_with_most_addresses(spark):
    """A hot domain is split over the salts and no row is lost or doubled."""
    addresses = spark.range(20_000).select(
        F.concat(
            F.lit("u"), F.col("id").cast("string"), F.lit("@"),
            F.when(F.col("id") % 3 == 0, F.concat(F.lit("d"), F.col("id").cast("string")))
            .otherwise("hot"),
            F.lit(".cl"),
        ).alias("email"),
        F.lit("s").alias("source"),
    )
    mx = spark.createDataFrame([("hot.cl", "mx", None)], "domain STRING, mx_outcome STRING, mx_detail STRING")
    out = D.classify_addresses(addresses, mx, smtp_enabled=False)
    assert out.count() == 20_000
    assert out.filter("mx_ok").count() == 13_333
