"""JOB extract_contacts: published addresses and whether a reader saw them."""

from pyspark.sql import Column, DataFrame, functions as F

from pagelens.functions import text, urls
from pagelens.operators.candidates import candidate_emails, generation_wanted
from pagelens.operators.evidence import evidence_of
from pagelens.operators.facts import page_facts, visible_text
from pagelens.operators.shared import first_by, unnest


def _routes(body: Column, hidden: bool | None, tld: str) -> Column:
    """SET-1: union of the written, spelled-out, mailto and payload routes."""

    def side(item: Column) -> Column:
        return item["hidden"] if hidden else ~item["hidden"]

    anchors = F.filter(F.col("facts.anchors"), side)
    hrefs = F.transform(anchors, lambda a: a["href"])
    linked = F.transform(
        F.filter(
            hrefs,
            lambda h: F.contains(F.lower(h), F.lit("email-protection#"))
            & ~F.lower(h).startswith("mailto:"),
        ),
        lambda h: F.substr(h, F.locate("#", h) + 1),
    )
    spans = F.transform(
        F.filter(F.col("facts.payloads"), side), lambda p: p["hex"]
    )
    return F.concat(
        body,
        text.mailto_in(hrefs, tld),
        text.decoded_in(F.concat(linked, spans), tld),
    )


def contact_arrays(pages: DataFrame, tld: str = "cl") -> DataFrame:
    """Per page the sorted visible addresses and those only hidden.

    JOIN-6 / SET-2 / AGG-9 need no shuffle: all occurrences of an address on
    a page are in the page's own row.
    """
    seen = _routes(text.written_in(visible_text(), tld), False, tld)
    unseen = _routes(
        F.flatten(F.transform(F.col("facts.hidden_texts"), lambda t: text.written_in(t, tld))),
        True,
        tld,
    )
    return (
        page_facts(pages)
        .withColumn("visible", F.array_sort(F.array_distinct(seen)))
        .withColumn(
            "hidden_only",
            F.array_sort(F.array_except(F.array_distinct(unseen), F.col("visible"))),
        )
    )


def _entries(emails: Column, hidden: bool, generated: bool) -> Column:
    return F.transform(
        emails,
        lambda e: F.struct(
            e.alias("email"),
            F.lit(hidden).alias("hidden"),
            F.lit(generated).alias("generated"),
        ),
    )


def entries_of(tld: str, pattern: str = "", target: str | None = None) -> Column:
    """Entries of a page with contact arrays: written, hidden, then guessed.

    With a target only its addresses stay, before anything else is tested.
    """
    parts = [
        _entries(F.col("visible"), False, False),
        _entries(F.col("hidden_only"), True, False),
    ]
    if generation_wanted(pattern, target, tld):
        guesses = candidate_emails(F.col("facts.text"), pattern, target)
        parts.append(_entries(guesses, False, True))
    rows = F.concat(*parts)
    if target is None:
        return rows
    return F.filter(rows, lambda e: urls.at_suffix(e["email"], target))


def entry_evidence(entries: Column) -> Column:
    """Evidence, tested only on pages that have an entry."""
    found = evidence_of(F.col("facts.lang"), F.col("facts.text"), F.col("url"))
    return F.when(F.size(entries) > 0, found)


def unnest_entries(table: DataFrame, keep: list, evidence: bool = True) -> DataFrame:
    """One row per entry of ``source, entries`` and the page's evidence."""
    shown = ["evidence"] if evidence else []
    return unnest(table, [*keep, "source", *shown], F.col("entries"), "row").select(
        *keep, "row.email", "source", "row.hidden", "row.generated", "pos", *shown
    )


def _exploded(
    arrays: DataFrame, rows: Column, keep: list, evidence: bool = False
) -> DataFrame:
    extra = [entry_evidence(F.col("entries")).alias("evidence")] if evidence else []
    listed = arrays.withColumn("entries", rows).select(
        *keep, F.col("url").alias("source"), "entries", *extra
    )
    return unnest_entries(listed, keep, evidence)


def extract_contacts(
    pages: DataFrame,
    tld: str = "cl",
    keep: list | None = None,
    evidence: bool = False,
    target: str | None = None,
) -> DataFrame:
    """``email, source, hidden`` plus ``pos`` and the ``keep`` columns.

    Visible addresses of a page come first, each group in address order. Pages
    that cannot hold an address are dropped before they are parsed. With
    ``evidence`` the page's signals come from the same parse (JOIN-5 without
    a join: no page text is shuffled).
    """
    keep = [c for c in (keep or []) if c in pages.columns]
    likely = pages.filter(text.may_hold_email(F.col("html"), tld))
    rows = entries_of(tld, target=target)
    return _exploded(contact_arrays(likely, tld), rows, keep, evidence).drop("generated")


def contacts_and_candidates(
    pages: DataFrame, pattern: str, domain: str, tld: str, keep: list
) -> DataFrame:
    """Scraped addresses, then guesses, with evidence, from one parse.

    Only addresses of ``domain`` are kept.
    """
    rows = entries_of(tld, pattern, domain)
    return _exploded(contact_arrays(pages, tld), rows, keep, evidence=True)


def addresses_in_text(
    docs: DataFrame, key: str, body: str, tld: str = "cl"
) -> DataFrame:
    """SCA-7 over plain text: distinct ``email`` per ``key``."""
    found = F.array_distinct(text.emails_in(F.col(body), tld))
    return unnest(docs, [key], found, "email").drop("pos")


def first_seen(contacts: DataFrame, keys: list | None = None) -> DataFrame:
    """WIN-1 / WIN-5: the first occurrence of each address keeps its flags."""
    known = ("crawl_seq", "depth", "path", "generated", "pos")
    order = [c for c in known if c in contacts.columns]
    return first_by(contacts, keys or ["email"], order)


def payload_yield(pages: DataFrame, tld: str = "cl") -> DataFrame:
    """JOIN-9 / SET-3: what decoding payloads adds to the other routes.

    One row per page: payload count, decoded addresses under ``tld``, those
    not already extracted, and the first three of them as text (TOP-8).
    """
    ok = F.col("outcome") == "ok"
    suffix = "." + tld
    decoded = F.filter(
        text.decode_payloads(F.col("__hex")),
        lambda e: F.endswith(F.lower(e), F.lit(suffix)),
    )
    judged = pages if "outcome" in pages.columns else pages.withColumn(
        "outcome", F.lit("ok")
    )
    judged = judged.withColumn("html", F.when(ok, F.col("html")).otherwise(""))
    return (
        contact_arrays(judged, tld)
        .withColumn("__hex", text.payloads_in(F.col("html")))
        .withColumn("__decoded", F.array_distinct(decoded))
        .withColumn(
            "__new",
            F.array_except(F.col("__decoded"), F.concat("visible", "hidden_only")),
        )
        .withColumn("payloads", F.size("__hex"))
        .withColumn("decoded_cl", F.size("__decoded"))
        .withColumn("new_addresses", F.size("__new"))
        .withColumn(
            "sample", F.array_join(F.slice(F.array_sort("__new"), 1, 3), " ")
        )
        .drop("__hex", "__decoded", "__new", "visible", "hidden_only", "facts")
    )
