"""Measurement runs: a frame of domains, observations, an interval."""

from pyspark.sql import DataFrame, functions as F

from pagelens.operators import discovery as D, estimates as E
from pagelens.operators.contacts import extract_contacts, first_seen, payload_yield
from pagelens.functions import urls
from pagelens.operators.shared import attach
from pagelens.operators.verdicts import classify_addresses, unverified


def sibling_measure(hosts, suffixes, observed, tld: str = "cl") -> dict:
    """Share of hosts whose sibling domain accepts mail."""
    rows = E.sibling_outcomes(hosts, suffixes, observed, tld)
    return {
        "rows": rows,
        "report": E.outcome_report(rows, "mail-capable", "no-mail"),
        "counts": E.outcome_counts(rows),
    }


def catch_all_measure(domains, mx, verdicts) -> dict:
    rows = E.catch_all_outcomes(domains, mx, verdicts)
    return {
        "rows": rows,
        "report": E.outcome_report(rows, "catch-all", "selective"),
    }


def keyserver_measure(rows, verdicts) -> dict:
    totals = E.keyserver_totals(rows)
    return {
        "totals": totals,
        "servers": E.per_server(rows),
        "entities": E.by_entity(rows),
        "gate": E.yield_gate(totals, verdicts),
    }


def payload_measure(pages: DataFrame, tld: str = "cl") -> dict:
    rows = payload_yield(pages, tld)
    return {"rows": rows, "report": E.prevalence(rows)}


def regional_scan(
    targets: DataFrame,
    live: DataFrame,
    pages: DataFrame,
    mx: DataFrame,
    tld: str = "cl",
    verify_mx: bool = True,
    timed_out: DataFrame | None = None,
) -> DataFrame:
    """``comuna, domain, email, source, status, error`` of every target.

    ``pages`` carries the ``comuna`` it was collected for and ``crawl_seq``.
    ``timed_out`` lists, in ``comuna``, targets whose verification did not
    finish.
    """
    resolved = D.resolve_targets(targets, live)
    found = extract_contacts(pages, tld, keep=["comuna", "crawl_seq"])
    mine = attach(found, resolved, "comuna", "inner").filter(
        urls.at_host(F.col("email"), F.col("domain"))
    )
    firsts = first_seen(mine, ["comuna", "email"]).select(
        "comuna", F.col("domain").alias("target"), "email", "source"
    )
    if verify_mx:
        judged = classify_addresses(firsts, mx, smtp_enabled=False, tld=tld)
        if timed_out is not None:
            late = timed_out.select("comuna", F.lit(True).alias("__late")).distinct()
            judged = unverified(attach(judged, late, "comuna"), F.col("__late"))
    else:
        judged = unverified(firsts, verify_mx=False)
    return judged.select(
        "comuna", F.col("target").alias("domain"), "email", "source", "status", "error"
    )
