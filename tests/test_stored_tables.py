"""Appends that can be repeated and rewrites that touch their folders only."""

from pathlib import Path

import pytest

from pagelens.schemas import SESSION_EMAILS, SESSIONS
from pagelens.sources import writers

ROWS = "email STRING, source STRING, domain STRING"


def _rows(spark, domain, *names):
    return spark.createDataFrame([(f"{n}@{domain}", "s", domain) for n in names], ROWS)


def _read(spark, path):
    return sorted(r.email for r in writers.read_appended(spark, path, ROWS).collect())


def test_an_append_run_twice_leaves_each_row_once(spark, tmp_path):
    path = str(tmp_path / "out")
    first = _rows(spark, "a.cl", "x", "y").unionByName(_rows(spark, "b.cl", "z"))
    for _ in range(2):
        writers.append_by_target(first, path, write_id="one")
    writers.append_by_target(_rows(spark, "a.cl", "w"), path, write_id="two")
    assert _read(spark, path) == ["w@a.cl", "x@a.cl", "y@a.cl", "z@b.cl"]


def test_a_write_broken_off_is_not_read_and_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "out")
    writers.append_by_target(_rows(spark, "a.cl", "x"), path, write_id="007")
    # Half of the second write is there, its record is not.
    half = _rows(spark, "a.cl", "y", "lost")
    half.selectExpr("*", "'two' AS write_id").write.mode("append").partitionBy("domain", "write_id").parquet(path)
    assert _read(spark, path) == ["x@a.cl"]
    writers.append_by_target(_rows(spark, "a.cl", "y").unionByName(_rows(spark, "b.cl", "z")), path, write_id="two")
    assert _read(spark, path) == ["x@a.cl", "y@a.cl", "z@b.cl"]


def _emails(spark, path, sessions=30):
    rows = [(i, i % sessions, f"e{i}@a.cl", "u", "unknown") for i in range(90)]
    table = spark.createDataFrame(rows, SESSION_EMAILS)
    writers.append_table(writers.in_folders(table, "session_id", 10), path, "folder")


def _files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def _statuses(spark, path):
    rows = spark.read.schema(f"{SESSION_EMAILS}, folder BIGINT").parquet(path).collect()
    return sorted((r.id, r.status) for r in rows)


@pytest.mark.parametrize("named", [10_000, 0])
def test_only_named_folders_are_rewritten(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(writers, "NAMED_FOLDERS", named)
    path = str(tmp_path / "emails")
    _emails(spark, path)
    before = _files(path)
    updates = spark.createDataFrame([(12, "e12@a.cl", "valid"), (12, "none", "valid")], "session_id BIGINT, email STRING, status STRING")
    for _ in range(2):
        writers.update_status_at(spark, path, updates, wide=10)
        assert _statuses(spark, path) == [(i, "valid" if i == 12 else "unknown") for i in range(90)]
    after = _files(path)
    for folder in ("folder=0", "folder=2"):
        kept = {p for p in before if folder in p}
        assert kept and all(after.get(p) == before[p] for p in kept)
    assert not {p for p in before if "folder=1" in p} & set(after)
    assert not Path(writers.pending_path(path)).exists()


def test_no_update_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "emails")
    _emails(spark, path)
    before = _files(path)
    none = spark.createDataFrame([], "session_id BIGINT, email STRING, status STRING")
    writers.update_status_at(spark, path, none, wide=10)
    assert _files(path) == before


def test_a_rewrite_broken_off_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "emails")
    _emails(spark, path)
    updates = spark.createDataFrame([(12, "e12@a.cl", "valid")], "session_id BIGINT, email STRING, status STRING")
    finish = writers.finish_rewrite
    calls = []

    def broken(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("lost")
        finish(*args)

    monkeypatch.setattr(writers, "finish_rewrite", broken)
    with pytest.raises(RuntimeError):
        writers.update_status_at(spark, path, updates, wide=10)
    monkeypatch.setattr(writers, "finish_rewrite", finish)
    later = spark.createDataFrame([(25, "e25@a.cl", "invalid")], "session_id BIGINT, email STRING, status STRING")
    writers.update_status_at(spark, path, later, wide=10)
    got = dict(_statuses(spark, path))
    assert len(got) == 90 and got[12] == "valid" and got[25] == "invalid"


def test_folders_that_were_not_all_ready_are_dropped(spark, tmp_path):
    path = str(tmp_path / "emails")
    _emails(spark, path)
    before = _statuses(spark, path)
    waiting = Path(writers.pending_path(path)) / "folder=1"
    waiting.mkdir(parents=True)
    (waiting / "part-0.parquet").write_bytes(b"half")
    writers.finish_rewrite(spark, path, "folder", f"{SESSION_EMAILS}, folder BIGINT")
    assert _statuses(spark, path) == before and not waiting.exists()


def test_totals_are_written_to_sessions_with_addresses(spark, tmp_path):
    path, emails = str(tmp_path / "sessions"), str(tmp_path / "emails")
    _emails(spark, emails)
    rows = [(i, None, "a.cl", "", 0, 0) for i in range(40)]
    table = spark.createDataFrame(rows, SESSIONS)
    writers.append_table(writers.in_folders(table, "id", 10), path, "folder")
    some = spark.read.schema(f"{SESSION_EMAILS}, folder BIGINT").parquet(emails).filter("session_id < 5")
    writers.update_totals_at(spark, path, some, wide=10)
    back = spark.read.schema(f"{SESSIONS}, folder BIGINT").parquet(path).collect()
    assert sorted((r.id, r.total_found) for r in back) == [(i, 3 if i < 5 else 0) for i in range(40)]


def test_folders_do_not_grow_with_the_sessions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "FOLDERS", 4)
    path, emails = str(tmp_path / "sessions"), str(tmp_path / "emails")
    rows = [(i, None, "a.cl", "", 0, 0) for i in range(400)]
    table = spark.createDataFrame(rows, SESSIONS).repartition(8)
    writers.append_table(writers.in_folders(table, "id", 10), path, "folder")
    found = [(i, i, f"e{i}@a.cl", "u", "valid") for i in (1, 2, 43, 395)]
    spark.createDataFrame(found, SESSION_EMAILS).write.parquet(emails)
    before = _files(path)
    # One file for each folder, whatever the number of tasks.
    assert len(before) == 4
    writers.update_totals_at(spark, path, spark.read.parquet(emails), wide=10)
    after = _files(path)
    assert len(after) == 4 and len(set(before) & set(after)) == 2
    back = spark.read.schema(f"{SESSIONS}, folder BIGINT").parquet(path).collect()
    assert sorted((r.id, r.total_valid) for r in back) == [(i, int(i in (1, 2, 43, 395))) for i in range(400)]
