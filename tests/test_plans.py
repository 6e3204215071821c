"""Plan shapes that have to hold at scale, and how code reaches workers."""

import pickle
import re
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagelens.catalog import inputs as I
from pagelens.functions import markup
from pagelens.operators import contacts as C, estimates as E, facts, results as R
from pagelens.operators.shared import attach, first_by, shared_folder, spread
from pagelens.plans import scan

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def raw_pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet").withColumn("crawl_seq", F.col("page_id"))


def exchanges(text):
    return [line for line in text.splitlines() if "Exchange" in line and "Broadcast" not in line]


def test_discovery_is_one_parse_and_one_shuffle_of_addresses(spark):
    text = plan(scan.discoveries(raw_pages(spark), tld="com"))
    assert text.count("ArrowEvalPython") == 1
    assert len(exchanges(text)) == 1
    after = text[: text.index("ArrowEvalPython")]
    assert "html#" not in after.split("Exchange")[0]


def test_guesses_come_from_the_same_parse(spark):
    text = plan(scan.discoveries(raw_pages(spark), "a.cl", "{first}.{last}"))
    assert text.count("ArrowEvalPython") == 1 and len(exchanges(text)) == 1


def test_unlikely_pages_are_dropped_before_the_parse(spark):
    text = plan(C.extract_contacts(raw_pages(spark)))
    below = text[text.index("ArrowEvalPython"):]
    assert "Contains(lower(html" in below and "Filter" in below


def test_only_needed_columns_are_read(spark):
    text = plan(C.extract_contacts(raw_pages(spark)))
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", text).group(1)
    assert schema == "struct<url:string,html:string>"


def test_filters_reach_the_scan(spark):
    emails = spark.read.parquet(f"{SF}/events.parquet").filter(F.col("user_id") == 7)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(user_id,7\)", plan(emails))


def test_summaries_combine_before_the_shuffle(spark):
    for df in (R.short_summary(I.results(spark, SF)), R.verdict_counts(I.results(spark, SF))):
        text = plan(df)
        assert text.count("HashAggregate") == 2 and len(exchanges(text)) == 1


def test_first_seen_combines_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id", F.lit("x").alias("v"))
    text = plan(first_by(rows, ["k"], ["id"]))
    assert text.count("Aggregate") >= 2 and "Window" not in text


def test_top_k_is_not_a_global_sort(spark):
    text = plan(E.seeded_sample(I.table(spark, SF, "customer"), "c_custkey", 1, 10))
    assert "TakeOrderedAndProject" in text and not exchanges(text)


def test_first_k_per_key_is_cut_before_the_shuffle(spark):
    from pagelens.operators.discovery import first_k

    text = plan(first_k(I.table(spark, SF, "orders"), ["o_custkey"], ["o_orderkey"], 3))
    assert text.count("WindowGroupLimit") == 2


def test_no_cartesian_product_and_no_forced_broadcast_of_data(spark):
    from pagelens.catalog.mail import classified

    text = plan(classified(spark, SF))
    assert "CartesianProduct" not in text


def test_attach_keeps_rows_and_splits_a_hot_key(spark):
    facts_ = spark.range(10_000).select(F.lit("hot").alias("k"), "id").repartition(7)
    lookup = spark.createDataFrame([("hot", 1)], "k STRING, v INT")
    assert attach(facts_, lookup, "k").agg(F.count("v"), F.countDistinct("id")).first() == (10_000, 10_000)
    none = attach(facts_, lookup.filter("k = 'x'"), "k")
    assert none.filter("v IS NULL").count() == 10_000


@pytest.mark.parametrize("salts", [1, 8])
def test_filters_pass_an_attached_lookup(spark, salts):
    facts_ = spark.read.parquet(f"{SF}/events.parquet")
    lookup = spark.range(100).selectExpr("id AS user_id", "id AS v")
    text = plan(attach(facts_, lookup, "user_id", "inner", salts).filter("event_id = 7"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_id,7\)", text)


def test_salted_lookup_keeps_rows(spark):
    facts_ = spark.range(5000).select((F.col("id") % 3).alias("k"), "id")
    lookup = spark.createDataFrame([(0, 1), (1, 2)], "k BIGINT, v INT")
    assert attach(facts_, lookup, "k", salts=8).agg(F.count("v"), F.count("id")).first() == (3334, 5000)


@pytest.fixture
def parsed(spark, monkeypatch, tmp_path):
    """Names of the pages handed to the tokenizer, one file a call."""
    import uuid

    folder, true = str(tmp_path), markup._facts_with_links

    def facts_of(html, url=None):
        def count(html, url):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.write("\n".join(u for h, u in zip(html.to_pylist(), url.to_pylist()) if h is not None))
            return true(html, url)

        return F.arrow_udf(count, markup.FACTS).asNondeterministic()(html, F.lit("x") if url is None else url)

    monkeypatch.setattr(markup, "facts_of", facts_of)

    def seen():
        return sum(len(f.read_text().split()) for f in tmp_path.iterdir())

    return seen


def test_scan_parses_each_page_once(spark, pages, parsed):
    table = pages(*[(f"https://a.cl/{i}", f"<p>p{i}@a.cl</p><a href='/{i + 1}'>n</a>") for i in range(6)])
    seeds = spark.createDataFrame([("https://a.cl/0", 0)], "url STRING, rank INT")
    mx = spark.createDataFrame([("a.cl", "mx", None)], "domain STRING, mx_outcome STRING, mx_detail STRING")
    run = scan.scan(table, seeds, mx, smtp_enabled=False)
    assert run["results"].count() == 4 and run["walls"].count() == 1 and run["walk"].count() == 4
    assert parsed() == 6


def test_evidence_parses_pages_twice(spark, pages, parsed):
    from pagelens.operators import evidence

    table = pages(*[(f"https://a.cl/{i}", f"<p>p{i}@a.cl</p>") for i in range(5)])
    assert evidence.attach_evidence(C.extract_contacts(table), table).count() == 5
    assert parsed() <= 10


def test_spread_widens_only_narrow_scans(spark):
    one = spark.read.parquet(f"{SF}/pages.parquet")
    assert spread(one, "url").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, 64)
    assert spread(wide).rdd.getNumPartitions() == 64


def test_shared_folder_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    assert named is None or folder == named
    assert shared_folder(spark) == folder or named is None


def test_worker_needs_no_copy_of_the_package():
    code = pickle.dumps(cloudpickle.dumps(markup._facts))
    script = (
        "import pickle, sys, pyarrow as pa\n"
        "f = pickle.loads(pickle.loads(sys.stdin.buffer.read()))\n"
        "print(f(pa.array(['<p hidden>a</p>b', None])).to_pylist()[0]['visible_text'])\n"
        "assert not any(m == 'pagelens' or m.startswith('pagelens.') for m in sys.modules)\n"
    )
    out = subprocess.run(
        [sys.executable, "-c", script], input=code, cwd="/", capture_output=True, timeout=120
    )
    assert out.stdout.strip() == b"b", out.stderr.decode()


@pytest.mark.parametrize("name", ["localCheckpoint", "crossJoin", "toPandas", "CACHE"])
def test_library_avoids(name):
    from pathlib import Path

    for file in Path(facts.__file__).parents[1].rglob("*.py"):
        assert name not in file.read_text(), file
