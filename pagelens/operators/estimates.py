"""Measurement reports: counts, proportions with intervals, quantiles."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagelens.functions import fixed_values as V, stats
from pagelens.operators.shared import attach, first_by, unnest, zero

ANSWERS = ("ok", "none")


def with_wilson(
    counts: DataFrame, k: str, n: str, low: str = "low", high: str = "high"
) -> DataFrame:
    """AGG-15: add the interval of ``k`` out of ``n``."""
    lo, hi = stats.wilson(F.col(k), F.col(n))
    return counts.withColumn(low, lo).withColumn(high, hi)


def is_answered() -> Column:
    """FLT-15: a non-response is never an empty answer."""
    return F.col("outcome").isin(*ANSWERS)


# --- sibling domains ------------------------------------------------------------


def base_labels(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """JOIN-7: add ``base``, the label before the longest matching suffix.

    A host without a listed suffix has one of length one; a host that is
    itself a suffix has no base. Every suffix of each distinct host is looked
    up by equality.
    """
    parts = F.split(F.regexp_replace(F.lower("host"), r"^\.+|\.+$", ""), r"\.")
    named = hosts.select("host").distinct().withColumn("__parts", parts)
    size = F.size("__parts")
    every = F.transform(
        F.sequence(F.lit(1), size), lambda n: F.array_join(F.slice("__parts", -n, n), ".")
    )
    tails = unnest(named, ["host"], every, "suffix").withColumn("len", F.col("pos") + 1)
    rules = suffixes.select("suffix", F.lit(True).alias("__rule")).distinct()
    longest = (
        attach(tails, rules, "suffix")
        .groupBy("host")
        .agg(
            F.greatest(
                F.lit(1), F.coalesce(F.max(F.when(F.col("__rule"), F.col("len"))), F.lit(1))
            ).alias("__len")
        )
    )
    bases = named.join(longest, "host").select(
        "host",
        F.when(
            F.col("__len") < size,
            F.get("__parts", size - F.col("__len") - 1),
        ).alias("base"),
    )
    return attach(hosts, bases, "host", salts=1)


def sibling_outcomes(
    hosts: DataFrame, suffixes: DataFrame, observed: DataFrame, tld: str = "cl"
) -> DataFrame:
    """JOIN-8: each host's sibling domain and its outcome.

    ``hosts`` is ``seq, host``; ``observed`` is ``sibling, outcome, detail,
    seconds``. A sibling is looked up once; later hosts reuse the answer and
    say so in the detail.
    """
    named = base_labels(hosts, suffixes).withColumn(
        "sibling", F.concat("base", F.lit("." + tld))
    )
    firsts = named.filter("base IS NOT NULL").groupBy("sibling").agg(
        F.min("seq").alias("__first")
    )
    answers = firsts.join(observed, "sibling", "left")
    joined = attach(named, answers, "sibling", salts=1)
    none = F.col("base").isNull()
    later = F.col("seq") > F.col("__first")
    detail = F.coalesce("detail", F.lit(""))
    return joined.select(
        "seq",
        "host",
        F.coalesce("sibling", F.lit("")).alias("sibling"),
        F.when(none, "no-base").otherwise(F.coalesce("outcome", F.lit("unreachable"))).alias("outcome"),
        F.when(none, "host is a public suffix")
        .when(later, F.concat(detail, F.lit(" (cached)")))
        .otherwise(detail)
        .alias("detail"),
        F.when(none, 0.0).otherwise(F.coalesce("seconds", F.lit(0.0))).alias("seconds"),
    )


def distinct_siblings(probes: DataFrame) -> DataFrame:
    """First row per sibling; rows without one are left out."""
    return first_by(probes.filter(F.col("sibling") != ""), ["sibling"], ["seq"])


def outcome_counts(probes: DataFrame) -> DataFrame:
    """AGG-14: rows by outcome."""
    return probes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def outcome_report(probes: DataFrame, positive: str, negative: str) -> DataFrame:
    """AGG-14 / AGG-20: one row of counts and the interval of the positives."""
    outcome = F.col("outcome")
    rows = probes.agg(F.count(F.lit(1))).scalar()
    counted = distinct_siblings(probes).agg(
        F.count(F.lit(1)).alias("distinct_domains"),
        F.count_if(outcome == positive).alias("yes"),
        F.count_if(outcome == negative).alias("no"),
        F.count_if(outcome == "unreachable").alias("non_response"),
    )
    both = counted.withColumn("answered", F.col("yes") + F.col("no"))
    return with_wilson(both, "yes", "answered").withColumn("rows", rows)


def catch_all_outcomes(
    domains: DataFrame, mx: DataFrame, verdicts: DataFrame
) -> DataFrame:
    """AGG-20: ``catch-all``, ``selective`` or ``unreachable`` per domain.

    ``domains`` is ``seq, domain``; a domain whose mail host or probes were
    not observed is unreachable.
    """
    seen = mx.select("domain", "mx_outcome", "mx_host").join(verdicts, "domain", "left")
    reached = F.col("mx_outcome").isin("mx", "implicit") & F.col("catch_all").isNotNull()
    return attach(domains, seen, "domain").select(
        "seq",
        F.col("domain").alias("host"),
        F.col("domain").alias("sibling"),
        F.when(~F.coalesce(reached, F.lit(False)), "unreachable")
        .when(F.col("catch_all"), "catch-all")
        .otherwise("selective")
        .alias("outcome"),
        F.coalesce("mx_host", F.lit("")).alias("detail"),
    )


def latency_quantiles(
    timings: DataFrame, keys: list, value: str, accuracy: int = 10000
) -> DataFrame:
    """AGG-16: upper median and p95 by position, exact at any group size.

    A sketch brackets each wanted position; equal values are counted together
    and only values inside a bracket are ranked. The sketch's error bound
    guarantees that the bracket holds the position (small groups are ranked
    whole), so a group with a third of all rows ranks only a few values.
    """
    spread = 2.0 / accuracy
    tails = [0.5 - spread, 0.5 + spread, 0.95 - spread, 0.95 + spread]
    brackets = timings.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.percentile_approx(value, tails, accuracy).alias("q"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
    )
    n = F.col("n")
    small = n <= 2 * accuracy

    def wanted_at(stat: str, pos: Column, tail: int) -> Column:
        low, high = F.col("q")[tail], F.col("q")[tail + 1]
        return F.struct(
            F.lit(stat).alias("stat"),
            pos.alias("pos"),
            F.when(small, F.col("least")).otherwise(low).alias("lo"),
            F.when(small, F.col("most")).otherwise(high).alias("hi"),
        )

    wanted = F.array(
        wanted_at("median", F.floor(n / 2), 0),
        wanted_at("p95", F.least(n - 1, F.floor(n * F.lit(0.95))), 2),
    )
    counts = timings.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("c")
    )
    held = attach(counts, brackets.select(*keys, F.col("n"), wanted.alias("w")), keys, "inner")
    asked = held.withColumn("w", F.explode("w"))
    group = [*keys, F.col("w.stat").alias("stat")]
    below = asked.filter(F.col(value) < F.col("w.lo")).groupBy(*group).agg(
        F.sum("c").alias("below")
    )
    inside = asked.filter(F.col(value).between(F.col("w.lo"), F.col("w.hi"))).select(
        *group, F.col("w.pos").alias("pos"), F.col(value).alias("v"), "c"
    )
    upto = Window.partitionBy(*keys, "stat").orderBy("v").rowsBetween(
        Window.unboundedPreceding, 0
    )
    placed = (
        inside.withColumn("upto", F.sum("c").over(upto))
        .join(below, [*keys, "stat"], "left")
        .withColumn("end", F.col("upto") + F.coalesce("below", F.lit(0)))
        .filter(F.col("pos").between(F.col("end") - F.col("c"), F.col("end") - 1))
    )
    return placed.groupBy(*keys).agg(
        F.max(F.when(F.col("stat") == "median", F.col("v"))).alias("median"),
        F.max(F.when(F.col("stat") == "p95", F.col("v"))).alias("p95"),
    )


# --- keyserver yield -----------------------------------------------------------------


def found_addresses(rows: DataFrame) -> DataFrame:
    """SET-4: distinct ``domain, address`` over servers."""
    return (
        unnest(rows, ["domain"], F.split("addresses", " "), "address")
        .drop("pos")
        .filter(F.col("address") != "")
        .distinct()
    )


def domain_union(rows: DataFrame) -> DataFrame:
    """AGG-6: distinct addresses per domain, zero when no server had any."""
    counted = found_addresses(rows).groupBy("domain").agg(
        F.count(F.lit(1)).alias("addresses")
    )
    return (
        rows.select("domain").distinct()
        .join(counted, "domain", "left")
        .withColumn("addresses", zero(F.col("addresses")))
    )


def per_server(rows: DataFrame) -> DataFrame:
    """AGG-7: distinct addresses and failed requests by server.

    Addresses are made distinct before they are counted, so a server that
    holds most rows is not one group of raw rows.
    """
    got = (
        unnest(rows, ["server"], F.split("addresses", " "), "address")
        .drop("pos")
        .filter(F.col("address") != "")
        .distinct()
        .groupBy("server")
        .agg(F.count(F.lit(1)).alias("addresses"))
    )
    asked = rows.groupBy("server").agg(
        F.count_if(~F.coalesce(is_answered(), F.lit(False))).alias("failed")
    )
    return asked.join(got, "server", "left").select(
        "server", zero(F.col("addresses")).alias("addresses"), "failed"
    )


def by_entity(rows: DataFrame) -> DataFrame:
    """AGG-8 / JOIN-13: domains, domains with hits, addresses by type."""
    kinds = rows.groupBy("domain").agg(F.min("entity").alias("entity"))
    return (
        domain_union(rows)
        .join(kinds, "domain")
        .groupBy("entity")
        .agg(
            F.count(F.lit(1)).alias("domains"),
            F.count_if(F.col("addresses") > 0).alias("with_addresses"),
            F.sum("addresses").alias("addresses"),
        )
    )


def keyserver_totals(rows: DataFrame) -> DataFrame:
    """One row: requests, answers, non-responses, yields per answer."""
    asked = rows.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.coalesce(is_answered(), F.lit(False))).alias("answered"),
    )
    distinct = found_addresses(rows).select("address").distinct()
    return (
        asked.withColumn("addresses", distinct.agg(F.count(F.lit(1))).scalar())
        .withColumn("non_response", F.col("requests") - F.col("answered"))
        .withColumn("per_request", stats.per(F.col("addresses"), F.col("answered")))
    )


def yield_gate(
    totals: DataFrame, verdicts: DataFrame, gate: float = V.YIELD_GATE
) -> DataFrame:
    """AGG-18: live addresses per answered request against a fixed gate.

    Only a definite invalid counts as dead; the interval is the live share's
    times the yield. Both inputs are one-row or verdict tables.
    """
    judged = verdicts.agg(
        F.struct(
            F.count(F.lit(1)).alias("verified"),
            F.count_if(F.col("status") != "invalid").alias("live"),
        )
    ).scalar()
    row = with_wilson(
        totals.withColumn("__v", judged).select("*", "__v.*"), "live", "verified"
    )
    share = F.col("live").cast("double") / F.nullif(F.col("verified"), F.lit(0))
    rate = F.col("per_request")
    return row.select(
        "requests", "answered", "addresses", "per_request", "verified", "live",
        "low", "high",
        (rate * share).alias("point"),
        (rate * F.col("low")).alias("point_low"),
        (rate * F.col("high")).alias("point_high"),
        (rate * F.col("low") >= gate).alias("clears_gate"),
    )


# --- payload prevalence ----------------------------------------------------------------


def prevalence(rows: DataFrame) -> DataFrame:
    """AGG-17: one row over pages, answered and not, with both intervals."""
    ok = F.col("outcome") == "ok"
    counted = rows.agg(
        F.count(F.lit(1)).alias("domains"),
        F.count_if(ok).alias("reachable"),
        F.count_if(~ok).alias("unreachable"),
        F.count_if(ok & (F.col("payloads") > 0)).alias("using"),
        F.count_if(ok & (F.col("new_addresses") > 0)).alias("recovering"),
        zero(F.sum(F.when(ok, F.col("new_addresses")))).alias("total_new"),
    )
    using = with_wilson(counted, "using", "reachable", "using_low", "using_high")
    return with_wilson(
        using, "recovering", "reachable", "recovering_low", "recovering_high"
    )


def seeded_sample(rows: DataFrame, key: str, seed, n: int) -> DataFrame:
    """TOP-7: reproducible draw of ``n`` rows by a keyed hash, a top-k."""
    draw = F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))
    return rows.orderBy(draw, F.col(key)).limit(n)
