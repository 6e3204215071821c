import math
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pagelens import schemas
from pagelens.operators import estimates as E
from pagelens.operators.shared import running_number

# Published 95% intervals, percent.
GOLDEN = [
    (84, 178, 39.994, 54.507), (58, 178, 26.130, 39.774), (6, 8, 40.927, 92.852),
    (4, 38, 4.170, 24.131), (15, 16, 71.671, 98.888), (10, 77, 7.210, 22.282),
    (9, 77, 6.272, 20.745), (6, 16, 18.481, 61.359), (4, 59, 2.668, 16.176),
    (0, 0, 0.0, 0.0), (0, 5, 0.0, 43.449), (5, 5, 56.551, 100.0),
]


def test_published_intervals(spark):
    rows = spark.createDataFrame([(k, n) for k, n, _, _ in GOLDEN], "k BIGINT, n BIGINT")
    got = {(r.k, r.n): (r.low * 100, r.high * 100) for r in E.with_wilson(rows, "k", "n").collect()}
    for k, n, low, high in GOLDEN:
        assert got[(k, n)] == pytest.approx((low, high), abs=6e-4)


def by_position(values):
    values = sorted(values)
    n = len(values)
    return values[n // 2], values[min(n - 1, int(n * 0.95))]


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_quantiles_by_position(spark, accuracy):
    """Accuracy 50 makes groups above 100 rows take the bracketed way."""
    rng = random.Random(7)
    groups = {
        "uno": [3.5],
        "dos": [1.0, 2.0],
        "iguales": [4.0] * 500,
        "hot": [rng.lognormvariate(0, 3) for _ in range(6000)],
        "pocos": [float(rng.randrange(12)) for _ in range(3000)],
        "cola": [1.0] * 960 + [1e9] * 40,
        **{f"g{n}": [rng.random() for _ in range(n)] for n in range(3, 24)},
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    table = spark.createDataFrame(rows, "g STRING, v DOUBLE").repartition(6)
    got = {r.g: (r.median, r.p95) for r in E.latency_quantiles(table, ["g"], "v", accuracy).collect()}
    assert got == {g: by_position(vs) for g, vs in groups.items()}


def longest_suffix(host, rules):
    parts = host.lower().strip(".").split(".")
    size = max([1] + [n for n in range(1, len(parts) + 1) if ".".join(parts[-n:]) in rules])
    return None if size >= len(parts) else parts[-size - 1]


label = st.sampled_from(["a", "b", "co", "uk", "com", "Www"])


@settings(max_examples=5, deadline=None)
@given(hosts=st.lists(st.lists(label, min_size=1, max_size=5).map(".".join), min_size=20, max_size=40))
def test_base_label_of_any_host(spark, hosts):
    rules = {"uk", "co.uk", "com", "b.co.uk"}
    hosts = [*hosts, ".com.", "www.bhp.com"]
    table = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "seq INT, host STRING")
    psl = spark.createDataFrame([(r,) for r in rules], "suffix STRING")
    got = {r.seq: r.base for r in E.base_labels(table, psl).collect()}
    assert got == {i: longest_suffix(h, rules) for i, h in enumerate(hosts)}


def test_siblings_are_asked_once(spark):
    hosts = spark.createDataFrame(
        [(0, "www.bhp.com"), (1, "chile.bhp.com"), (2, "co.uk"), (3, "x.co.uk")], "seq INT, host STRING"
    )
    psl = spark.createDataFrame([("com",), ("co.uk",)], "suffix STRING")
    seen = spark.createDataFrame(
        [("bhp.cl", "mail-capable", "mx.bhp.cl", 1.5)],
        "sibling STRING, outcome STRING, detail STRING, seconds DOUBLE",
    )
    rows = E.sibling_outcomes(hosts, psl, seen).orderBy("seq").collect()
    assert [(r.sibling, r.outcome, r.detail) for r in rows] == [
        ("bhp.cl", "mail-capable", "mx.bhp.cl"),
        ("bhp.cl", "mail-capable", "mx.bhp.cl (cached)"),
        ("", "no-base", "host is a public suffix"),
        ("x.cl", "unreachable", ""),
    ]
    report = E.outcome_report(spark.createDataFrame(rows), "mail-capable", "no-mail").first()
    assert (report.rows, report.distinct_domains, report.yes, report.answered, report.non_response) == (
        4, 2, 1, 1, 1
    )


def test_gate(spark):
    rows = [("a.cl", "company", "ubuntu", "ok", 2, "x@a.cl y@a.cl"), ("a.cl", "company", "mit", "ok", 1, "x@a.cl"),
            ("b.cl", "company", "ubuntu", "none", 0, ""), ("b.cl", "company", "mit", "error: Timeout", 0, "")]
    table = spark.createDataFrame(rows, schemas.KEYSERVER_ROWS)
    totals = E.keyserver_totals(table)
    row = totals.first()
    assert (row.requests, row.answered, row.non_response, row.addresses) == (4, 3, 1, 2)
    verdicts = spark.createDataFrame([("valid",), ("unknown",), ("invalid",)], "status STRING")
    gate = E.yield_gate(totals, verdicts).first()
    assert gate.point == pytest.approx(2 / 3 * 2 / 3) and not gate.clears_gate
    nobody = E.yield_gate(totals, verdicts.limit(0)).first()
    assert nobody.point is None and nobody.low == 0.0


def test_non_answers_are_not_zeros(spark):
    rows = [("a.cl", "ok", 2, 1, 1, "x"), ("b.cl", "ok", 0, 0, 0, ""), ("c.cl", "http 500", 0, 0, 0, "")]
    row = E.prevalence(spark.createDataFrame(rows, schemas.PREVALENCE_ROWS)).first()
    assert (row.domains, row.reachable, row.unreachable, row.using, row.recovering, row.total_new) == (
        3, 2, 1, 1, 1, 1
    )
    assert not math.isnan(row.using_low)


def test_running_number_over_sparse_and_hot_runs(spark):
    rng = random.Random(3)
    rows = [("hot", s) for s in rng.sample(range(100_000), 4000)] + [("b", 5), ("b", -7), ("c", 0)]
    table = spark.createDataFrame(rows, "run STRING, seq BIGINT").repartition(5)
    got = {(r.run, r.seq): r.n for r in running_number(table, ["run"], "seq", "n", width=97).collect()}
    for run in ("hot", "b", "c"):
        ordered = sorted(s for r, s in rows if r == run)
        assert [got[(run, s)] for s in ordered] == list(range(1, len(ordered) + 1))


def test_sample_is_reproducible_and_depends_on_the_seed(spark):
    rows = spark.range(500).select(F.col("id").alias("k"))
    draw = lambda seed, parts: [r.k for r in E.seeded_sample(rows.repartition(parts), "k", seed, 20).collect()]
    assert draw(1, 2) == draw(1, 7)
    assert draw(1, 2) != draw(2, 2)
    assert len(set(draw(1, 3))) == 20
