import json

import pytest
from pyspark.sql import functions as F

from pagelens import schemas
from pagelens.operators import results as R, sessions as S
from pagelens.sources import readers, writers

ROWS = [
    ("v@a.cl", "https://a.cl/", "valid", "", ["rut"], False, False),
    ("u@a.cl", "https://a.cl/", "unknown", "timeout", [], True, False),
    ("i@a.cl", "", "invalid", None, None, None, None),
    ("c@a.cl", "javascript:x", "catch_all", "<b>&'\"", ["lexicon", "rut"], None, None),
    ("h@a.cl", "http://a.cl/?a=1&b=2", "valid", "", [], False, True),
    ("n@a.cl", None, "valid", "", None, None, None),
]


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(ROWS, schemas.RESULTS)


def test_summary_keeps_zero_and_unknown_statuses(results, spark):
    counts = dict(R.summarize(results).collect())
    assert counts == {"total": 6, "valid": 3, "catch_all": 1, "unknown": 1, "invalid": 1}
    odd = spark.createDataFrame([("a", "rebotado"), ("b", None)], "email STRING, status STRING")
    assert dict(R.summarize(odd).collect()) == {
        "total": 2, "valid": 0, "catch_all": 0, "unknown": 1, "invalid": 0, "rebotado": 1
    }
    assert dict(R.summarize(odd.limit(0)).collect())["total"] == 0


def test_csv_holds_valid_and_visible_only(results, spark, tmp_path):
    path = str(tmp_path / "lista.csv")
    writers.write_results(results, path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["email", "source", "status", "error"]
    assert sorted(r.email for r in back.collect()) == ["n@a.cl", "v@a.cl"]


def test_json_keeps_absent_apart_from_empty(results, tmp_path):
    path = tmp_path / "todo.json"
    writers.write_results(results, str(path))
    lines = [json.loads(x) for f in path.glob("part-*") for x in f.read_text().splitlines()]
    by = {r["email"]: r for r in lines}
    assert by["u@a.cl"]["evidence"] == [] and "evidence" not in by["i@a.cl"]
    assert by["i@a.cl"]["error"] == "" and by["n@a.cl"]["source"] == ""
    assert "hidden" not in by["c@a.cl"] and by["h@a.cl"]["hidden"] is True


def test_report_cells(results):
    by = {r.email: r for r in R.report_rows(results).collect()}
    assert by["v@a.cl"].evidence == "rut" and by["v@a.cl"].linked
    assert by["u@a.cl"].evidence == "sin evidencia" and by["u@a.cl"].generated_mark == "generado"
    assert by["i@a.cl"].evidence == "" and by["i@a.cl"].status == "Inválido"
    assert by["c@a.cl"].error == "&lt;b&gt;&amp;&#x27;&quot;" and not by["c@a.cl"].linked
    assert by["c@a.cl"].status == "Acepta todo" and by["c@a.cl"].row_class == "catch_all"
    assert by["h@a.cl"].hidden_mark == "oculto" and by["h@a.cl"].source == "http://a.cl/?a=1&amp;b=2"


@pytest.mark.parametrize(
    "path, fmt", [("a.csv", "csv"), ("a.JSON", "json"), ("d/a.html", "html"), ("a.htm", "html")]
)
def test_format_from_extension(path, fmt):
    assert writers.resolve_format(path) == fmt


@pytest.mark.parametrize("path, fmt", [("a.xlsx", None), ("a", None), ("a.csv", "pdf")])
def test_unknown_format_fails_before_work(path, fmt):
    with pytest.raises(ValueError):
        writers.write_results(None, path, fmt)


def test_forced_format_wins():
    assert writers.resolve_format("a.txt", "json") == "json"
    assert writers.resolve_format(None) is None


def test_search_and_valid_projection(results):
    assert [r.email for r in R.search(results, "A=1").collect()] == ["h@a.cl"]
    assert sorted(r.email for r in R.valid_addresses(results).collect()) == [
        "h@a.cl", "n@a.cl", "v@a.cl"
    ]


def test_lists(spark, tmp_path):
    file = tmp_path / "lista.txt"
    file.write_text(
        "# nota\n\n  a@b.cl  \nc@d.cl\tvalid\thttps://s.cl/\ne@f.cl\tvalid\n \t x\n", encoding="utf-8"
    )
    rows = [(r.email, r.source) for r in readers.read_address_list(spark, str(file)).collect()]
    assert rows == [("a@b.cl", ""), ("c@d.cl", "https://s.cl/"), ("e@f.cl", ""), ("x", "")]
    listed = readers.read_line_list(spark, str(file), "url").orderBy("rank").collect()
    assert [r.url for r in listed] == ["a@b.cl", "c@d.cl\tvalid\thttps://s.cl/", "e@f.cl\tvalid", "x"]


def test_certificate_files(spark, tmp_path):
    packed = tmp_path / "a.cl.json"
    packed.write_text('[{"name_value":"a.cl\\nwww.a.cl"},{"name_value":"*.a.cl"}]')
    names = readers.read_ct_crtsh(spark, str(packed)).orderBy("seq", "pos").collect()
    assert [(r.domain, r.source_order, r.pos, r.name) for r in names] == [
        ("a.cl", 0, 0, "a.cl"), ("a.cl", 0, 1, "www.a.cl"), ("a.cl", 0, 0, "*.a.cl")
    ]
    listed = tmp_path / "spot.json"
    listed.write_text('[{"dns_names":["a.cl","b.cl"]},{"id":1,"domain":"x.cl"}]')
    assert readers.read_ct_certspotter(spark, str(listed)).count() == 2
    lines = tmp_path / "many.json"
    lines.write_text("".join(f'{{"domain":"d.cl","name_value":"h{i}.d.cl"}}\n' for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        split = readers.read_ct_crtsh(spark, str(lines), lines=True)
        assert split.rdd.getNumPartitions() > 3
        rows = split.orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.name for r in rows] == [f"h{i}.d.cl" for i in range(3000)]


def test_files_feed_seed_discovery(spark, pages, tmp_path):
    """From saved answers to seeds without any column added by hand."""
    from pagelens.plans import scan

    crt, spot = tmp_path / "crt", tmp_path / "spot"
    crt.mkdir(), spot.mkdir()
    (crt / "a.cl.json").write_text("[]")
    (spot / "a.cl.json").write_text('[{"dns_names":["mail.a.cl"]}]')
    (crt / "b.cl.json").write_text('[{"name_value":"x.b.cl\\n*.b.cl"}]')
    names = readers.read_ct_crtsh(spark, str(crt)).unionByName(
        readers.read_ct_certspotter(spark, str(spot))
    )
    asked = readers.read_ct_asked(spark, str(crt), 0).unionByName(
        readers.read_ct_asked(spark, str(spot), 1)
    )
    assert sorted((r.domain, r.source_order) for r in asked.collect()) == [
        ("a.cl", 0), ("a.cl", 1), ("b.cl", 0)
    ]
    probes = spark.createDataFrame(
        [("mail.a.cl", True, 200), ("x.b.cl", True, 404)],
        "host STRING, resolved BOOLEAN, http_status INT",
    )
    domains = spark.createDataFrame([("a.cl",), ("b.cl",)], "domain STRING")
    seeds = scan.discover_seeds(domains, names, asked, probes, pages(("https://a.cl/", "<p>x</p>")))
    found = {(r.domain, r.url) for r in seeds.collect()}
    assert found == {("a.cl", "https://mail.a.cl"), ("b.cl", "https://x.b.cl")}


def test_suffix_rules_and_doh_files(spark, tmp_path):
    rules = tmp_path / "psl.dat"
    rules.write_text("// nota\n\ncom\nco.uk \n")
    assert [r.suffix for r in readers.read_suffix_rules(spark, str(rules)).collect()] == ["com", "co.uk"]
    answers = tmp_path / "doh.json"
    answers.write_text('{"domain":"a.cl","answer":"{\\"Status\\":3}"}\n')
    assert readers.read_doh_answers(spark, str(answers)).first().domain == "a.cl"


def test_targets(spark):
    targets = readers.target_list(spark)
    assert targets.count() == 53
    assert [r.comuna for r in targets.filter("domain IS NULL").collect()] == ["Padre Hurtado"]


def test_append_by_target_adds_to_what_is_there(spark, tmp_path):
    path = str(tmp_path / "targets")
    rows = spark.createDataFrame([("a.cl", "x@a.cl"), ("b.cl", "y@b.cl")], "domain STRING, email STRING")
    writers.append_by_target(rows, path)
    writers.append_by_target(rows.filter("domain = 'a.cl'"), path)
    assert spark.read.parquet(path).groupBy("domain").count().orderBy("domain").collect() == [
        ("a.cl", 2), ("b.cl", 1)
    ]


# --- history -------------------------------------------------------------------


@pytest.fixture(scope="module")
def emails(spark):
    return spark.createDataFrame(
        [(1, 1, "a@x.cl", "s", "unknown"), (2, 1, "b@x.cl", "s", "valid"),
         (3, 2, "a@x.cl", "s", "unknown"), (4, 3, "c@x.cl", "s", "catch_all")],
        schemas.SESSION_EMAILS,
    )


def heads(spark, n):
    rows = [(i, None, f"@{i}.cl", "", 0, 0) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, schemas.SESSIONS)


def test_update_is_scoped_to_its_session(emails, spark):
    updates = spark.createDataFrame(
        [(1, "a@x.cl", "invalid", 1), (1, "a@x.cl", "valid", 2)],
        "session_id BIGINT, email STRING, status STRING, seq INT",
    )
    got = {(r.session_id, r.email): r.status for r in S.update_status(emails, updates).collect()}
    assert got == {(1, "a@x.cl"): "valid", (1, "b@x.cl"): "valid",
                   (2, "a@x.cl"): "unknown", (3, "c@x.cl"): "catch_all"}


def test_totals_count_valid_only(emails, spark):
    rows = {r.id: (r.total_found, r.total_valid) for r in S.update_totals(heads(spark, 4), emails).collect()}
    assert rows == {1: (2, 1), 2: (1, 0), 3: (1, 0), 4: (0, 0)}


def test_pruning_keeps_ten_and_leaves_addresses(emails, spark):
    kept = S.prune_sessions(heads(spark, 13))
    assert sorted(r.id for r in kept.collect()) == list(range(4, 14))
    assert [r.id for r in S.list_sessions(heads(spark, 13)).collect()] == list(range(13, 3, -1))
    assert emails.count() == 4
    assert S.session_emails(kept, emails).count() == 0
    assert S.load_session(emails, 1).count() == 2


def test_session_row_joins_its_seeds(spark):
    target = spark.createDataFrame([(1, "@a.cl"), (2, "(verify)")], "id BIGINT, target_domain STRING")
    seeds = spark.createDataFrame(
        [(1, "https://b.cl", 1), (1, "https://a.cl", 0)], "id BIGINT, url STRING, rank INT"
    )
    got = {r.id: r.seed_urls for r in S.session_rows(target, seeds).collect()}
    assert got == {1: "https://a.cl,https://b.cl", 2: ""}


def test_saved_rows_default_to_unknown(spark):
    rows = spark.createDataFrame([("a@x.cl", "s", None)], "email STRING, source STRING, status STRING")
    assert S.email_rows(rows, 5).first() == (5, "a@x.cl", "s", "unknown")


def test_export_metadata_lies_beside_the_records(spark, results, tmp_path):
    odd = results.withColumn("status", F.when(F.col("status") == "invalid", "rebotado").otherwise(F.col("status")))
    path = str(tmp_path / "todo.json")
    writers.write_results(odd, path)
    head = spark.read.schema(
        "tool STRING, exported_at STRING, summary MAP<STRING, BIGINT>"
    ).json(writers.summary_path(path)).first()
    assert head.tool == "pagelens" and head.exported_at
    assert head.summary["catch_all"] == 1 and head.summary["rebotado"] == 1
    assert head.summary["invalid"] == 0 and head.summary["total"] == 6


def test_seed_rows_keep_every_seed(spark):
    seeds = spark.range(2000).selectExpr("1L AS id", "concat('u', id) AS url", "id AS rank")
    assert S.seed_rows(seeds).count() == 2000
    few = S.seed_rows(seeds, 3).collect()
    assert sorted(r.url for r in few) == ["u0", "u1", "u2"]


@pytest.mark.parametrize("k", [3, 1500])
def test_first_k_with_rank(spark, k):
    from pagelens.operators.discovery import first_k

    rows = spark.range(4000).selectExpr("id % 2 AS key", "id AS v")
    got = first_k(rows, ["key"], ["v"], k, into="r").collect()
    assert len(got) == 2 * k and all(r.v == 2 * (r.r - 1) + r.key for r in got)


def test_exports_without_a_path_carry_the_day(spark):
    from pagelens.sources import writers

    assert writers.default_path(spark, "s3a://b/out/", day="2026-08-01") == "s3a://b/out/pagelens-2026-08-01.csv"
    path = writers.default_path(spark, "/tmp/out", "html", "run")
    today = spark.sql("SELECT CAST(current_date() AS STRING)").first()[0]
    assert path == f"/tmp/out/run-{today}.html" and writers.infer_format(path) == "html"
    with pytest.raises(ValueError):
        writers.default_path(spark, "/tmp/out", "xml")
