"""JOB candidate_addresses: guesses from names on a page, always marked."""

from pyspark.sql import Column, DataFrame, functions as F

from pagelens.functions import fixed_values as V, text
from pagelens.operators.facts import page_facts
from pagelens.operators.shared import unnest


def _locals(pairs: Column, pattern: str) -> Column:
    """SCA-20..22: local parts of the usable pairs, distinct in order."""
    plain = F.transform(
        pairs,
        lambda p: F.struct(
            text.normalise_name(p["first"]).alias("first"),
            text.normalise_name(p["last"]).alias("last"),
        ),
    )
    usable = F.filter(
        plain, lambda p: (F.length(p["first"]) > 0) & (F.length(p["last"]) > 0)
    )
    parts = F.transform(
        usable, lambda p: text.apply_pattern(p["first"], p["last"], pattern)
    )
    return F.array_distinct(F.filter(parts, lambda v: F.length(v) > 0))


def candidate_emails(body: Column, pattern: str, domain: str) -> Column:
    """SCA-22: distinct candidate addresses of one text, in reading order."""
    bare = domain.lstrip("@").lower()
    parts = _locals(text.name_pairs(body), pattern)
    return F.transform(parts, lambda v: F.concat(v, F.lit("@" + bare)))


def candidates_of(
    rows: DataFrame, body: Column, pattern: str, domain: str, keep: list
) -> DataFrame:
    """Candidates from any text column, with the ``keep`` columns."""
    made = unnest(rows, keep, candidate_emails(body, pattern, domain), "email")
    return made.select(*keep, "email", F.lit(True).alias("generated"), "pos")


def candidate_addresses(
    pages: DataFrame, pattern: str, domain: str, keep: list | None = None
) -> DataFrame:
    """``email, source, generated`` from the names in the page text."""
    keep = [c for c in (keep or []) if c in pages.columns]
    found = candidates_of(
        page_facts(pages).withColumn("source", F.col("url")),
        F.col("facts.text"),
        pattern,
        domain,
        [*keep, "source"],
    )
    return found


def generation_wanted(pattern: str | None, target: str | None, tld: str = "cl") -> bool:
    """FLT-14: guesses are made only for a named target inside the TLD."""
    return bool(pattern and target and target.endswith("." + tld))


def preset_candidates(pairs: DataFrame, domain: str) -> DataFrame:
    """SCA-21: every preset applied to ``first, last`` rows."""
    presets = F.array(
        *[
            F.struct(F.lit(name).alias("preset"), F.lit(p).alias("pattern"))
            for name, p in V.PATTERN_PRESETS
        ]
    )
    first, last = F.col("__first"), F.col("__last")
    local = text.apply_pattern(first, last, F.col("p.pattern"))
    return (
        pairs.withColumn("__first", text.normalise_name(F.col("first")))
        .withColumn("__last", text.normalise_name(F.col("last")))
        .filter((F.length("__first") > 0) & (F.length("__last") > 0))
        .withColumn("p", F.explode(presets))
        .withColumn("email", F.concat(local, F.lit("@" + domain)))
        .withColumn("preset", F.col("p.preset"))
        .drop("p", "__first", "__last")
    )
