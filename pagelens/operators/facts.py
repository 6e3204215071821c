"""JOB page_facts: one parse per page, and the judgements made from it."""

from pyspark.sql import Column, DataFrame, functions as F

from pagelens.functions import fixed_values as V, markup, text

READ, BLOCKED, FAILED = "read", "blocked", "failed"


def page_facts(pages: DataFrame, links: bool = False) -> DataFrame:
    """Add the ``facts`` struct; a page already parsed is left as it is."""
    if "facts" in pages.columns:
        return pages
    url = F.col("url") if links else None
    return pages.withColumn("facts", markup.facts_of(F.col("html"), url))


def visible_text() -> Column:
    """SCA-1: text outside every subtree hidden from a reader."""
    return F.coalesce(F.col("facts.visible_text"), F.col("facts.text"))


def followable(anchors: Column) -> Column:
    """SCA-5: some link a crawler could follow."""

    def follows(anchor: Column) -> Column:
        href = text.strip(anchor["href"])
        scheme = F.regexp_extract(href, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)
        return (
            (F.length(href) > 0)
            & ~href.startswith("#")
            & F.lower(scheme).isin("", "http", "https")
        )

    return F.exists(anchors, follows)


def wall_vendor(headers: Column, html: Column) -> Column:
    """FLT-10: vendor by response header, else by body, else ``''``.

    Header names are compared without regard to case.
    """
    lowered = F.lower(html)
    names = F.transform(F.map_keys(headers), F.lower)
    vendor = F.lit("")
    for needle, name in reversed(V.WALL_SIGNATURES):
        vendor = F.when(F.contains(lowered, F.lit(needle)), name).otherwise(vendor)
    for header, name in reversed(V.WALL_HEADERS):
        vendor = F.when(F.array_contains(names, header), name).otherwise(vendor)
    return vendor


def with_walls(responses: DataFrame) -> DataFrame:
    """FLT-9: add ``outcome`` and ``wall_vendor``.

    The outcome is ``read``, ``blocked`` (a wall; its vendor is ``''`` where
    unknown) or ``failed`` (no 2xx answer or no body; neither read nor
    blocked). Only short successful bodies are parsed, the rest cannot be
    walls. Tables without ``status`` or ``headers`` count as plain 200 answers.
    """
    if "status" not in responses.columns:
        responses = responses.withColumn("status", F.lit(200))
    if "headers" not in responses.columns:
        responses = responses.withColumn(
            "headers", F.create_map().cast("map<string,string>")
        )
    got = answered(responses)
    suspect = got & (F.length("html") <= V.MAX_WALL_CHARS)
    if "facts" in responses.columns:
        facts = F.col("facts")
    else:
        facts = markup.facts_of(F.when(suspect, F.col("html")))
    wall = (
        suspect
        & (F.length(text.strip(F.col("__facts.text"))) == 0)
        & ~followable(F.col("__facts.anchors"))
    )
    return (
        responses.withColumn("__facts", facts)
        .withColumn(
            "wall_vendor",
            F.when(wall, wall_vendor(F.col("headers"), F.col("html"))),
        )
        .withColumn(
            "outcome",
            F.when(~got, FAILED)
            .when(F.col("wall_vendor").isNotNull(), BLOCKED)
            .otherwise(READ),
        )
        .drop("__facts")
    )


def answered(responses: DataFrame) -> Column:
    """A 2xx answer with a body; without ``status`` a body is enough."""
    body = F.col("html").isNotNull()
    if "status" not in responses.columns:
        return body
    return body & F.coalesce(F.col("status").between(200, 299), F.lit(False))


def with_outcome(judged: DataFrame) -> DataFrame:
    """Tables judged elsewhere without failures have only read and blocked."""
    if "outcome" in judged.columns:
        return judged
    blocked = F.col("wall_vendor").isNotNull()
    return judged.withColumn("outcome", F.when(blocked, BLOCKED).otherwise(READ))


def readable(responses: DataFrame) -> DataFrame:
    return with_walls(responses).filter(F.col("outcome") == READ)


def _counts() -> list[Column]:
    return [
        F.count_if(F.col("outcome") == READ).alias("pages_read"),
        F.count_if(F.col("outcome") == BLOCKED).alias("pages_blocked"),
    ]


def page_counts(judged: DataFrame, run: list | None = None) -> DataFrame:
    """AGG-4: pages read and pages blocked; failed ones are neither."""
    return with_outcome(judged).groupBy(*(run or [])).agg(*_counts())


def wall_report(judged: DataFrame, run: list | None = None) -> DataFrame:
    """AGG-5: what the unreadable pages of a run mean, in one sentence.

    The vendor set is bounded by the fixed vendor list.
    """
    counted = with_outcome(judged).groupBy(*(run or [])).agg(
        *_counts(),
        F.array_join(
            F.array_sort(
                F.collect_set(F.when(F.col("wall_vendor") != "", F.col("wall_vendor")))
            ),
            ", ",
        ).alias("__names"),
    )
    vendors = F.when(F.col("__names") == "", "").otherwise(
        F.concat(F.lit(" ("), F.col("__names"), F.lit(")"))
    )
    plural = F.when(F.col("pages_blocked") > 1, "s").otherwise("")

    def phrase(template: str) -> Column:
        out = F.lit(template)
        for slot, value in (
            ("{n}", F.col("pages_blocked").cast("string")),
            ("{plural}", plural),
            ("{vendors}", vendors),
        ):
            out = F.replace(out, F.lit(slot), value)
        return out

    report = (
        F.when(F.col("pages_blocked") == 0, "")
        .when(F.col("pages_read") > 0, phrase(V.WALLS_PARTIAL))
        .otherwise(phrase(V.WALLS_TOTAL))
    )
    return counted.withColumn("report", report).drop("__names")
