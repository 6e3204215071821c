"""Verification of an address list: read, classify, hand back rows."""

from pyspark.sql import DataFrame

from pagelens.operators.results import tsv_lines
from pagelens.operators.verdicts import classify_addresses, mx_verdicts, catch_all_verdicts
from pagelens.sources.readers import addresses_of


def verify_list(
    lines: DataFrame,
    observations: DataFrame,
    replies: DataFrame | None = None,
    probes: DataFrame | None = None,
    smtp_enabled: bool = True,
    tld: str = "cl",
) -> dict:
    """``results`` of every listed address and their ``lines``.

    Listed addresses have no page, so their records carry no evidence field.
    """
    results = classify_addresses(
        addresses_of(lines),
        mx_verdicts(observations),
        replies,
        catch_all_verdicts(probes) if probes is not None else None,
        smtp_enabled,
        tld,
    )
    return {"results": results, "lines": tsv_lines(results)}
