"""Streams that keep crawl order, and verdicts from probes that arrive too."""

import os
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagelens.operators import contacts as C
from pagelens.operators.verdicts import catch_all_verdicts
from pagelens.streaming import discoveries as S, keyed

SCHEMA = "page_id BIGINT, url STRING, html STRING, crawl_seq BIGINT"
KEPT = ["email", "source", "hidden", "crawl_seq", "pos"]


def _pages():
    rows = []
    for i in range(60):
        shown = f"<p>u{i % 7}@a.cl</p>" if i % 3 else f"<p hidden>u{i % 7}@a.cl</p>"
        rows.append((i, f"https://a.cl/{i}", f"{shown}<p>p{i}@b.cl</p>", i))
    return rows


def _arrive(spark, path, rows, places):
    """One file for each ten rows, in an order of arrival given by ``places``."""
    for begin in range(0, len(rows), 10):
        some = [rows[p] for p in places[begin : begin + 10]]
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _first_seen(spark, path, out, state, disorder):
    pages = keyed.in_order(S.stream_pages(spark, path, SCHEMA, 1), disorder)
    contacts = S.stream_contacts(pages, keep=["crawl_seq", "at"])
    S.write_batches(keyed.first_seen_stream(contacts).select(KEPT), out, state).awaitTermination()


def test_crawl_order_is_kept_whatever_arrives_first(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("pages", "out", "state"))
    rows = _pages()
    # Neighbouring tens swapped: out of order by fewer than twenty places.
    places = [p for t in (1, 0, 3, 2, 5, 4) for p in range(t * 10, t * 10 + 10)]
    _arrive(spark, path, rows[:], places)
    keyed.end_of_run(spark, path, SCHEMA)
    _first_seen(spark, path, out, state, 25)
    got = sorted(map(tuple, spark.read.parquet(out).select(KEPT).collect()))
    batch = C.first_seen(C.extract_contacts(spark.createDataFrame(rows, SCHEMA), keep=["crawl_seq"]))
    assert got == sorted(map(tuple, batch.select(KEPT).collect()))
    # The first page of u0 hides it, and arrives after one that shows it.
    assert ("u0@a.cl", "https://a.cl/0", True, 0) in [r[:4] for r in got]


def test_addresses_leave_once_and_state_survives_a_restart(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("pages", "out", "state"))
    rows = _pages()
    _arrive(spark, path, rows, list(range(29, -1, -1)))
    _first_seen(spark, path, out, state, 5)
    early = spark.read.schema("email STRING").parquet(out).count()
    _arrive(spark, path, rows, list(range(30, 60)))
    keyed.end_of_run(spark, path, SCHEMA)
    _first_seen(spark, path, out, state, 5)
    got = [r.email for r in spark.read.parquet(out).collect()]
    assert 0 < early < len(got) == len(set(got))


def _probe_rows():
    """Domains by their answers: accepted, refused first or last, one, none."""
    answers = {"ok.cl": [250, 250], "no.cl": [550, 250], "half.cl": [250, 451], "one.cl": [250], "null.cl": [250, None]}
    probes = [(d, c) for d, codes in answers.items() for c in codes]
    asked = [(f"{u}@{d}", "s", False) for d in [*answers, "none.cl"] for u in "abcdef"]
    return probes, asked


@pytest.mark.parametrize("salts, probes_first", [(1, True), (3, False)])
def test_streamed_probes_give_the_verdicts_of_the_batch(spark, tmp_path, salts, probes_first):
    probes, asked = _probe_rows()
    answer_schema, ask_schema = "domain STRING, code INT, crawl_seq BIGINT", "email STRING, source STRING, hidden BOOLEAN, crawl_seq BIGINT"
    ap, qp, out, state = (str(tmp_path / n) for n in ("answers", "asked", "out", "state"))
    half = len(asked) // 2

    def put(path, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    def run():
        def at(path, schema):
            return keyed.in_order(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), 10)

        judged = keyed.catch_all_stream(at(qp, ask_schema), at(ap, answer_schema), 20, salts=salts)
        S.write_batches(judged, out, state).awaitTermination()

    put(qp, [(*a, i) for i, a in enumerate(asked[:half])], ask_schema)
    first, rest = (probes, [("x.cl", 250)]) if probes_first else (probes[::2], probes[1::2])
    put(ap, [(*p, 1) for p in first], answer_schema)
    run()
    # Restarted: the rest of both sides, then the end of the run on both.
    put(ap, [(*p, 2) for p in rest], answer_schema)
    put(qp, [(*a, i) for i, a in enumerate(asked[half:])], ask_schema)
    put(qp, [("z@end.cl", "s", False, keyed.END_PLACE)], ask_schema)
    put(ap, [("end.cl", 250, keyed.END_PLACE)], answer_schema)
    run()
    got = {r.email: r.catch_all for r in spark.read.parquet(out).filter("domain <> 'end.cl'").collect()}
    known = {r.domain: r.catch_all for r in catch_all_verdicts(spark.createDataFrame(probes, "domain STRING, code INT")).collect()}
    assert got == {e: known.get(e.split("@")[1], False) for e, _, _ in asked}
    assert spark.read.parquet(out).count() == len(asked) + spark.read.parquet(out).filter("domain = 'end.cl'").count()


def test_keyed_state_does_not_need_the_sessions_own_store(spark, tmp_path):
    """A session that names another store, or none, starts these streams too."""
    path, out, state = (str(tmp_path / n) for n in ("pages", "out", "state"))
    name = "spark.sql.streaming.stateStore.providerClass"
    other = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    _arrive(spark, path, _pages(), list(range(60)))
    keyed.end_of_run(spark, path, SCHEMA)
    before = spark.conf.get(name)
    spark.conf.set(name, other)
    try:
        _first_seen(spark, path, out, state, 5)
        assert spark.conf.get(name) == other
    finally:
        spark.conf.set(name, before)
    assert spark.read.parquet(out).count() == 67


def test_workers_need_no_copy_of_the_processors(tmp_path):
    """Read back by a Python that cannot import the package, as workers do."""
    for processor in (keyed._FirstSeen(), keyed._CatchAll(2, 5)):
        (tmp_path / "task").write_bytes(cloudpickle.dumps(processor))
        code = "import pickle, sys; import pyspark.cloudpickle; pickle.load(open('task', 'rb')); assert 'pagelens' not in sys.modules"
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
