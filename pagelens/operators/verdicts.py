"""JOB classify_addresses: verdicts from recorded DNS and SMTP observations."""

from pyspark.sql import Column, DataFrame, functions as F

from pagelens.functions import fixed_values as V, text, urls
from pagelens.operators.shared import attach

MX_FOUND = ("mx", "implicit")


# --- mail hosts --------------------------------------------------------------


def implicit_mx(observed: DataFrame) -> DataFrame:
    """SCA-27: outcome of a domain from ``has_mx, has_a, failed``.

    Without an MX the domain's own address record makes it its mail host;
    with neither there is nowhere to deliver.
    """
    outcome = (
        F.when(F.col("failed"), "unavailable")
        .when(F.col("has_mx"), "mx")
        .when(F.col("has_a"), "implicit")
        .otherwise("not_found")
    )
    return observed.withColumn("outcome", outcome).withColumn(
        "detail",
        F.when(
            F.col("outcome") == "not_found",
            F.concat("domain", F.lit(V.MX_NO_RECORDS)),
        ),
    )


def doh_observations(answers: DataFrame) -> DataFrame:
    """SRC-6: mail-exchange rows from ``domain, answer`` DNS-over-HTTPS JSON.

    RCODE 3 is a definite negative; an answer without MX data is not.
    """
    parsed = answers.withColumn(
        "a",
        F.from_json(
            "answer", "Status INT, Answer ARRAY<STRUCT<type: INT, data: STRING>>"
        ),
    )
    hosts = F.filter(
        F.transform(
            F.filter(F.col("a.Answer"), lambda r: r["type"] == 15),
            lambda r: F.struct(
                F.try_to_number(F.substring_index(r["data"], " ", 1), F.lit("99999"))
                .cast("int")
                .alias("preference"),
                F.rtrim(
                    F.trim(F.try_element_at(F.split(r["data"], " ", 2), F.lit(2))),
                    F.lit("."),
                ).alias("exchange"),
                (
                    F.length(
                        F.try_element_at(F.split(r["data"], " ", 2), F.lit(2))
                    )
                    > 0
                ).alias("given"),
            ),
        ),
        lambda h: h["given"],
    )
    missing = F.col("a.Status") == 3
    return (
        parsed.withColumn("h", F.explode_outer(F.when(~missing, hosts)))
        .select(
            "domain",
            F.when(missing, "not_found")
            .when(F.col("h").isNull(), "unavailable")
            .otherwise("mx")
            .alias("outcome"),
            F.col("h.preference").alias("preference"),
            F.col("h.exchange").alias("exchange"),
            F.when(missing, F.concat("domain", F.lit(V.MX_DOES_NOT_EXIST)))
            .when(
                F.col("h").isNull(),
                F.concat(F.lit("DoH returned no MX records for "), "domain"),
            )
            .alias("detail"),
        )
    )


def lowest_preference(mx_rows: DataFrame, keys: list) -> DataFrame:
    """AGG-11: the exchange with the least (preference, exchange)."""
    order = F.struct("preference", "exchange")
    return mx_rows.groupBy(*keys).agg(F.min_by("exchange", order).alias("mx_host"))


def transport_answers(observations: DataFrame) -> DataFrame:
    """One answer per domain and transport, map-side combined."""
    is_mx = F.col("outcome") == "mx"
    pick = F.min_by(
        F.when(is_mx, F.col("exchange")),
        F.when(is_mx, F.struct("preference", "exchange")),
    )
    return (
        observations.groupBy("domain", "transport_order")
        .agg(
            pick.alias("mx"),
            F.bool_or(is_mx).alias("has_mx"),
            F.bool_or(F.col("outcome") == "implicit").alias("implicit"),
            F.bool_or(F.col("outcome") == "not_found").alias("negative"),
            F.min(F.when(F.col("outcome") == "not_found", F.col("detail"))).alias("denial"),
            F.min(F.when(F.col("outcome") == "unavailable", F.col("detail"))).alias("reason"),
        )
        .withColumn(
            "mx",
            F.when(F.col("has_mx"), F.rtrim(F.trim("mx"), F.lit("."))).when(
                F.col("implicit"), F.col("domain")
            ),
        )
        .withColumn(
            "outcome",
            F.when(F.col("mx") == "", "not_found")
            .when(F.col("has_mx"), "mx")
            .when(F.col("implicit"), "implicit")
            .when(F.col("negative"), "not_found")
            .otherwise("unavailable"),
        )
        .withColumn(
            "denial",
            F.when(F.col("mx") == "", F.concat("domain", F.lit(V.MX_NULL))).otherwise(
                F.coalesce("denial", F.concat("domain", F.lit(V.MX_DOES_NOT_EXIST)))
            ),
        )
    )


def mx_verdicts(observations: DataFrame) -> DataFrame:
    """WIN-6: the first transport that answered decides; a definite no counts.

    When all failed the reasons are joined in transport order. A domain has
    one row per transport here, so the list is bounded by the transports.
    """
    answered = F.col("outcome") != "unavailable"
    order = F.when(answered, F.col("transport_order"))
    failures = F.array_sort(
        F.collect_list(
            F.when(~answered, F.struct("transport_order", F.coalesce("reason", F.lit("")).alias("reason")))
        )
    )
    first = F.min_by(F.struct("outcome", "mx", "denial"), order)
    return (
        transport_answers(observations)
        .groupBy("domain")
        .agg(first.alias("f"), failures.alias("failures"))
        .select(
            "domain",
            F.coalesce("f.outcome", F.lit("unavailable")).alias("mx_outcome"),
            F.when(F.col("f.outcome").isin(*MX_FOUND), F.col("f.mx")).alias("mx_host"),
            F.when(F.col("f.outcome") == "not_found", F.col("f.denial"))
            .when(
                F.col("f").isNull(),
                F.array_join(F.transform("failures", lambda x: x["reason"]), "; "),
            )
            .alias("mx_detail"),
        )
    )


def catch_all_verdicts(probes: DataFrame) -> DataFrame:
    """AGG-12: every probe must be accepted; any error means not proven."""
    accepted = F.coalesce(F.col("code") == 250, F.lit(False))
    return probes.groupBy("domain").agg(
        (
            F.bool_and(accepted) & (F.count(F.lit(1)) >= V.CATCH_ALL_PROBES)
        ).alias("catch_all")
    )


# --- replies -------------------------------------------------------------------


def enhanced_code(message: Column) -> Column:
    """SCA-23: (subject, detail) of an enhanced status code, else NULL."""
    found = F.rlike(message, F.lit(V.ENHANCED_CODE))

    def part(group: int) -> Column:
        return F.regexp_extract(message, V.ENHANCED_CODE, group).try_cast("int")

    return F.when(
        found, F.struct(part(2).alias("subject"), part(3).alias("detail"))
    )


def looks_greylisted(code: Column, message: Column) -> Column:
    """SCA-24: a deferral worth asking again; 421 is load shedding, not that."""
    hints = "|".join(V.GREYLIST_HINTS)
    hinted = F.rlike(F.lower(F.coalesce(message, F.lit(""))), F.lit(hints))
    return (
        code.between(400, 499) & (code != 421) & (hinted | code.isin(450, 451))
    )


def classify_addresses(
    addresses: DataFrame,
    mx: DataFrame,
    replies: DataFrame | None = None,
    catch_all: DataFrame | None = None,
    smtp_enabled: bool = True,
    tld: str = "cl",
) -> DataFrame:
    """Verdict per address row; extra columns of ``addresses`` pass through.

    ``mx`` is one row per domain (``mx_verdicts``), ``replies`` one row per
    address (``code, message, error``), ``catch_all`` one row per domain. A
    domain with a third of all addresses is split by ``attach``.
    """
    rows = addresses.withColumn("syntax_ok", text.is_email(F.col("email"), tld))
    rows = rows.withColumn(
        "domain", F.when(F.col("syntax_ok"), urls.email_domain(F.col("email")))
    )
    domains = mx.select("domain", "mx_outcome", "mx_detail")
    if smtp_enabled and catch_all is not None:
        domains = domains.join(catch_all, "domain", "left")
    rows = attach(rows, domains, "domain")
    if "catch_all" not in rows.columns:
        rows = rows.withColumn("catch_all", F.lit(False))
    if smtp_enabled and replies is not None:
        rows = attach(
            rows,
            replies.select("email", "code", "message", F.col("error").alias("failure")),
            "email",
            salts=1,
        )
    else:
        rows = (
            rows.withColumn("code", F.lit(None).cast("int"))
            .withColumn("message", F.lit(None).cast("string"))
            .withColumn("failure", F.lit(None).cast("string"))
        )
    return _decide(rows, smtp_enabled).drop(
        "domain", "mx_outcome", "mx_detail", "catch_all", "code", "message", "failure"
    )


def _decide(rows: DataFrame, smtp_enabled: bool) -> DataFrame:
    code = F.col("code")
    found = F.col("mx_outcome").isin(*MX_FOUND)
    rows = rows.withColumn("mx_ok", F.coalesce(F.col("syntax_ok") & found, F.lit(False)))
    reached = F.col("mx_ok") & F.lit(smtp_enabled) & code.isNotNull()
    rows = rows.withColumn(
        "smtp_ok", F.when(reached & F.col("failure").isNull(), code == 250)
    )
    enhanced = enhanced_code(F.col("message"))
    subject, detail = enhanced["subject"], enhanced["detail"]
    full = (subject == 2) & (detail == 2)
    about_mailbox = enhanced.isNull() | subject.isin(1, 2)
    rejected = code.between(500, 599)
    grey = looks_greylisted(code, F.col("message"))
    rcpt = F.concat(F.lit(V.ERR_RCPT), code.cast("string"))
    steps = [
        (~F.col("syntax_ok"), "invalid", F.lit(V.ERR_SYNTAX)),
        (
            F.col("mx_outcome") == "not_found",
            "invalid",
            F.concat(F.lit(V.ERR_NO_MX), F.coalesce("mx_detail", F.lit(""))),
        ),
        (
            ~F.col("mx_ok"),
            "unknown",
            F.concat(F.lit(V.ERR_MX_LOOKUP), F.coalesce("mx_detail", F.lit(""))),
        ),
        (F.lit(not smtp_enabled), "unknown", F.lit("")),
        (
            F.col("smtp_ok").isNull(),
            "unknown",
            F.concat(F.lit(V.ERR_SMTP), F.coalesce("failure", F.lit("no reply recorded"))),
        ),
        (
            F.col("smtp_ok") & F.coalesce("catch_all", F.lit(False)),
            "catch_all",
            F.lit(V.ERR_CATCH_ALL),
        ),
        (F.col("smtp_ok"), "valid", F.lit("")),
        (rejected & F.coalesce(full, F.lit(False)), "unknown", F.concat(rcpt, F.lit(V.ERR_MAILBOX_FULL))),
        (rejected & about_mailbox, "invalid", rcpt),
        (rejected, "unknown", F.concat(rcpt, F.lit(V.ERR_POLICY))),
        (grey, "unknown", F.concat(rcpt, F.lit(V.ERR_GREYLISTED))),
    ]
    status, error = F.lit("unknown"), rcpt
    for test, verdict, reason in reversed(steps):
        status = F.when(test, verdict).otherwise(status)
        error = F.when(test, reason).otherwise(error)
    return (
        rows.withColumn("status", status)
        .withColumn("error", error)
        .withColumn(
            "greylisted",
            F.coalesce(F.col("smtp_ok").isNotNull() & ~F.col("smtp_ok") & grey, F.lit(False)),
        )
    )


def unverified(
    addresses: DataFrame, timed_out: Column | None = None, verify_mx: bool = True
) -> DataFrame:
    """FLT-17: status when verification is off, or when it did not finish."""
    late = F.coalesce(timed_out, F.lit(False)) if timed_out is not None else F.lit(False)
    if not verify_mx:
        return addresses.withColumn("status", F.lit("unverified")).withColumn(
            "error", F.lit("")
        )
    return addresses.withColumn(
        "status", F.when(late, "unknown").otherwise(F.col("status"))
    ).withColumn(
        "error", F.when(late, V.ERR_TIMED_OUT).otherwise(F.col("error"))
    )
