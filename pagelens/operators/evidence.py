"""JOB page_evidence: signals on the page an address was found on."""

from pyspark.sql import Column, DataFrame, functions as F

from pagelens.functions import text, urls
from pagelens.operators.facts import page_facts
from pagelens.operators.shared import attach, cut, small


def evidence_of(lang: Column, body: Column, url: Column, terms=None) -> Column:
    """AGG-13: sorted names of the signals that fired, empty when none did."""
    signals = {
        "lang-es-cl": text.page_lang(lang) == "es-cl",
        "lexicon": text.has_lexicon(body, terms),
        "path-cl": text.has_country_path(urls.path(url)),
        "phone-cl": text.has_cl_phone(body),
        "rut": text.has_valid_rut(body),
    }
    fired = F.array(*[F.when(test, name) for name, test in signals.items()])
    return F.array_sort(F.array_compact(fired))


def page_evidence(pages: DataFrame, terms: list | None = None) -> DataFrame:
    """``url, evidence`` per page; the claim is about the page only."""
    return page_facts(pages).select(
        "url",
        evidence_of(
            F.col("facts.lang"), F.col("facts.text"), F.col("url"), terms
        ).alias("evidence"),
    )


def attach_evidence(contacts: DataFrame, pages: DataFrame) -> DataFrame:
    """JOIN-5: evidence for contacts that were not extracted with it.

    A counted small set of source pages is broadcast, so the other pages are
    dropped at the scan and only sources are parsed. Beyond that every page is
    judged where it lies and only ``url, evidence`` is shuffled, never page
    text. Contacts whose page is absent keep NULL evidence: nobody looked.
    Contacts are checkpointed first, as they are read three times.
    """
    contacts = cut(contacts)
    sources = contacts.select(F.col("source").alias("url")).distinct()
    if small(sources):
        pages = pages.join(F.broadcast(sources), "url", "left_semi")
    judged = page_evidence(pages).withColumnRenamed("url", "source")
    return attach(contacts, judged, "source")
