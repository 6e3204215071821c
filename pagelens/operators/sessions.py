"""Run history: two tables, rewritten as DataFrames rather than in place."""

from pyspark.sql import DataFrame, functions as F

from pagelens.functions.fixed_values import SESSIONS_KEPT
from pagelens.operators.discovery import first_k
from pagelens.operators.shared import attach


def session_rows(target: DataFrame, seeds: DataFrame) -> DataFrame:
    """SNK-8: a session per ``id, target_domain`` with its comma-joined seeds.

    ``seeds`` is ``id, url, rank``. The text of a session is one cell, as long
    as its own list; ``seed_rows`` keeps long lists as rows instead.
    """
    listed = (
        seeds.groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "url"))).alias("s"))
        .select(
            "id",
            F.array_join(F.transform("s", lambda x: x["url"]), ",").alias("seed_urls"),
        )
    )
    return target.join(listed, "id", "left").select(
        "id",
        F.current_timestamp().alias("created_at"),
        "target_domain",
        F.coalesce("seed_urls", F.lit("")).alias("seed_urls"),
        F.lit(0).alias("total_found"),
        F.lit(0).alias("total_valid"),
    )


def seed_rows(seeds: DataFrame, most: int | None = None) -> DataFrame:
    """SNK-8: ``session_id, rank, url``, one row per seed of a session."""
    rows = seeds if most is None else first_k(seeds, ["id"], ["rank", "url"], most)
    return rows.select(F.col("id").alias("session_id"), "rank", "url")


def email_rows(results: DataFrame, session_id: int | None = None) -> DataFrame:
    """SNK-9: address rows of a session; a missing status is ``unknown``.

    Without ``session_id`` the results carry a ``session_id`` column.
    """
    status = F.col("status") if "status" in results.columns else F.lit(None)
    session = F.col("session_id") if session_id is None else F.lit(session_id)
    return results.select(
        session.cast("bigint").alias("session_id"),
        "email",
        F.col("source").alias("source_url"),
        F.coalesce(status, F.lit("unknown")).alias("status"),
    )


def update_status(emails: DataFrame, updates: DataFrame) -> DataFrame:
    """SNK-10: new status by (session, address), others unchanged.

    ``updates`` may repeat a key; ``seq`` decides, the latest wins.
    """
    order = F.col("seq") if "seq" in updates.columns else F.lit(0)
    latest = updates.groupBy("session_id", "email").agg(
        F.max_by("status", order).alias("__new")
    )
    return (
        attach(emails, latest, ["session_id", "email"], salts=1)
        .withColumn("status", F.coalesce("__new", "status"))
        .drop("__new")
        .select(*emails.columns)
    )


def session_totals(emails: DataFrame) -> DataFrame:
    """AGG-3: addresses per session and those verified valid."""
    return emails.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_found"),
        F.count_if(F.col("status") == "valid").alias("total_valid"),
    )


def update_totals(sessions: DataFrame, emails: DataFrame) -> DataFrame:
    """SNK-11: totals written to the sessions that have addresses."""
    totals = session_totals(emails).select(
        F.col("session_id").alias("id"),
        F.col("total_found").alias("__found"),
        F.col("total_valid").alias("__valid"),
    )
    return (
        sessions.join(totals, "id", "left")
        .withColumn("total_found", F.coalesce("__found", "total_found"))
        .withColumn("total_valid", F.coalesce("__valid", "total_valid"))
        .select(*sessions.columns)
    )


def load_session(emails: DataFrame, session_id: int) -> DataFrame:
    """SRC-9: addresses of one session; the filter reaches the scan."""
    return emails.filter(F.col("session_id") == session_id).select(
        "email", F.col("source_url").alias("source"), "status"
    )


def list_sessions(sessions: DataFrame, limit: int = SESSIONS_KEPT) -> DataFrame:
    """TOP-5: the latest sessions, a top-k by id."""
    return (
        sessions.orderBy(F.desc("id"))
        .limit(limit)
        .select("id", "created_at", "target_domain", "total_found", "total_valid")
    )


def prune_sessions(sessions: DataFrame, keep: int = SESSIONS_KEPT) -> DataFrame:
    """WIN-3: the ``keep`` highest ids stay. Address rows are not touched."""
    kept = sessions.select("id").orderBy(F.desc("id")).limit(keep)
    return sessions.join(F.broadcast(kept), "id", "left_semi")


def session_emails(sessions: DataFrame, emails: DataFrame) -> DataFrame:
    """JOIN-12: address rows with their session; orphans are dropped."""
    heads = sessions.select(F.col("id").alias("session_id"), "target_domain", "created_at")
    return attach(emails, heads, "session_id", "inner")
