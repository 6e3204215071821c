import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagelens.operators import contacts as C
from pagelens.streaming import control, discoveries as S

SCHEMA = "page_id BIGINT, url STRING, html STRING, crawl_seq BIGINT"


@pytest.fixture
def arrivals(spark, tmp_path):
    rows = [(i, f"https://a.cl/{i}", f"<p>u{i % 7}@a.cl</p><p hidden>t{i}@a.cl</p>", i) for i in range(40)]
    path = str(tmp_path / "pages")
    spark.createDataFrame(rows, SCHEMA).repartition(4, "page_id").write.parquet(path)
    return path


def test_stream_equals_batch(spark, arrivals, tmp_path):
    out = str(tmp_path / "out")
    once = S.emit_once(S.stream_contacts(S.stream_pages(spark, arrivals, SCHEMA, 1)))
    S.write_batches(once.select("email"), out, str(tmp_path / "state")).awaitTermination()
    batch = C.first_seen(C.extract_contacts(spark.read.parquet(arrivals), keep=["crawl_seq"]))
    got = [r.email for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted(r.email for r in batch.collect())


def test_state_survives_a_restart(spark, arrivals, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        once = S.emit_once(S.stream_contacts(S.stream_pages(spark, arrivals, SCHEMA)).select("email"))
        S.write_batches(once, out, state).awaitTermination()

    run()
    again = [(99, "https://a.cl/99", "<p>u1@a.cl nuevo@a.cl</p>", 99)]
    spark.createDataFrame(again, SCHEMA).write.mode("append").parquet(arrivals)
    run()
    got = [r.email for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) == 48 and "nuevo@a.cl" in got


def test_bounded_variant_runs(spark, tmp_path):
    path = str(tmp_path / "timed")
    spark.createDataFrame(
        [("a@b.cl", "2026-01-01 00:00:00"), ("a@b.cl", "2026-01-01 00:01:00"), ("c@d.cl", "2026-01-01 00:02:00")],
        "email STRING, at STRING",
    ).select("email", F.to_timestamp("at").alias("at")).write.parquet(path)
    stream = spark.readStream.schema("email STRING, at TIMESTAMP").parquet(path)
    out = str(tmp_path / "out")
    S.write_batches(S.emit_once_within(stream, "at", "10 minutes"), out, str(tmp_path / "s")).awaitTermination()
    assert sorted(r.email for r in spark.read.parquet(out).collect()) == ["a@b.cl", "c@d.cl"]


RESPONSE = SCHEMA + ", status INT, headers MAP<STRING,STRING>"
_WALL = "<html><body><div></div></body></html>"


@pytest.fixture
def responses(spark, tmp_path):
    """40 responses in 4 files: read, walls, failed, each third without address."""
    rows = []
    for i in range(40):
        body = _WALL if i % 5 == 1 else f"<p>u{i}@{'ab'[i % 2]}.cl</p>" if i % 3 else "<p>nada</p>"
        rows.append((i, f"https://a.cl/{i}", body, i, 500 if i % 7 == 3 else 200, {}))
    path = str(tmp_path / "responses")
    spark.createDataFrame(rows, RESPONSE).repartition(4, "page_id").write.parquet(path)
    return path


def _judge(contacts):
    domain = F.element_at(F.split("email", "@"), 2)
    return contacts.withColumn("status", F.when(domain == "a.cl", "valid").otherwise("catch_all"))


def test_counts_of_each_batch_equal_the_batch_run(spark, responses, tmp_path):
    pages = S.stream_pages(spark, responses, RESPONSE, 1)
    out, counts = str(tmp_path / "out"), str(tmp_path / "counts")
    S.write_counted(pages, _judge, out, counts, str(tmp_path / "s")).awaitTermination()
    noted = {r.batch_id: r.asDict() for r in S.batch_counts(spark, counts).collect()}
    assert len(noted) == len(list(Path(responses).glob("*.parquet")))
    whole = S.counted_run(spark.read.parquet(responses), _judge)
    expected = {
        "pages_read": 27, "pages_blocked": 7, "pages_failed": 6,
        "found": whole.count(), "verified": whole.count(),
        "valid": whole.filter("status = 'valid'").count(), "invalid": 0, "unknown": 0,
        "catch_all": whole.filter("status = 'catch_all'").count(),
    }
    for name, value in expected.items():
        assert sum(n[name] for n in noted.values()) == value, name
    for batch_id, n in noted.items():
        rows = spark.read.parquet(f"{out}/batch_id={batch_id}")
        assert rows.count() == n["found"]


def test_a_repeated_batch_replaces_its_counts(spark, responses, tmp_path):
    out, counts, state = (str(tmp_path / n) for n in ("out", "counts", "s"))

    def run():
        pages = S.stream_pages(spark, responses, RESPONSE, 1)
        S.write_counted(pages, _judge, out, counts, state).awaitTermination()
        return sorted(map(tuple, S.batch_counts(spark, counts).collect()))

    once = run()
    # The record that the last batch was done is lost; the batch is run again.
    last = max(control.committed_batches(spark, state))
    for name in (f"{last}", f".{last}.crc"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/commits/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    assert run() == once


def test_progress_carries_the_counts_of_a_plain_stream(spark, responses, tmp_path):
    listener = S.Progress()
    spark.streams.addListener(listener)
    try:
        rows = S.counted_run(S.stream_pages(spark, responses, RESPONSE, 2), _judge)
        query = S.write_batches(rows.select("email", "status"), str(tmp_path / "n"), str(tmp_path / "s"))
        query.awaitTermination()
        until = time.time() + 20
        while len(listener.by_batch(query.id)) < 2 and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    total = listener.total(query.id)
    assert len(listener.by_batch(query.id)) == 2 and total["rows"] == 40
    assert (total["pages_read"], total["pages_blocked"], total["pages_failed"]) == (27, 7, 6)
    assert total["found"] == total["verified"] == spark.read.parquet(str(tmp_path / "n")).count()


def test_stop_keeps_what_was_written_and_resumes(spark, arrivals, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def start():
        found = S.stream_contacts(S.stream_pages(spark, arrivals, SCHEMA, 1)).select("email", "source")
        return S.write_batches(found, out, state)

    S.stop_when(start(), lambda: True, poll_seconds=0.1)
    assert not S.stop_when(start(), lambda: False, poll_seconds=1)
    rows = [(r.email, r.source) for r in spark.read.schema("email STRING, source STRING").parquet(out).collect()]
    assert len(rows) == len(set(rows)) == 80


def test_stop_waits_for_a_batch_on_record(spark, arrivals, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    found = S.stream_contacts(S.stream_pages(spark, arrivals, SCHEMA, 1)).select("email")
    S.stop_when(S.write_batches(found, out, state), lambda: True, poll_seconds=0.01)
    assert control.committed_batches(spark, state)


@pytest.mark.parametrize("left", ["offsets/.0.aa.tmp", "commits/.0.crc", "state/0/junk"])
def test_leftovers_of_a_run_without_a_batch_do_no_harm(spark, arrivals, tmp_path, left):
    out, state = str(tmp_path / "out"), tmp_path / "state"
    (state / left).parent.mkdir(parents=True)
    (state / left).write_text("half")
    found = S.emit_once(S.stream_contacts(S.stream_pages(spark, arrivals, SCHEMA)).select("email"))
    S.write_batches(found, out, str(state)).awaitTermination()
    assert spark.read.parquet(out).count() == 47


def test_runs_broken_off_anywhere_give_each_address_once(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("pages", "out", "state"))
    rows = [(i, f"https://a.cl/{i}", f"<p>u{i % 9}@a.cl t{i}@a.cl</p>", i) for i in range(30)]
    spark.createDataFrame(rows, SCHEMA).repartition(10, "page_id").write.parquet(path)
    moments = random.Random(5)

    def start():
        found = S.emit_once(S.stream_contacts(S.stream_pages(spark, path, SCHEMA, 1)).select("email"))
        return S.write_batches(found, out, state)

    for _ in range(10):
        query = start()
        query.awaitTermination(moments.choice([0.001, 0.05, 0.3, 0.8]))
        query.stop()
    start().awaitTermination()
    got = [r.email for r in spark.read.schema("email STRING").parquet(out).collect()]
    assert sorted(got) == sorted({e for i in range(30) for e in (f"u{i % 9}@a.cl", f"t{i}@a.cl")})
