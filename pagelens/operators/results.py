"""Result tables: summaries, export projections and report rows."""

from pyspark.sql import Column, DataFrame, functions as F

from pagelens.functions import fixed_values as V, text
from pagelens.operators.shared import zero

FIELDS = ["email", "source", "status", "error"]


def summarize(results: DataFrame) -> DataFrame:
    """AGG-1: rows ``status, n``; known statuses at least zero, plus total.

    The status set is small after the map-side count, so the rest works on
    one row per status.
    """
    spark = results.sparkSession
    counts = results.groupBy(
        F.coalesce("status", F.lit("unknown")).alias("status")
    ).agg(F.count(F.lit(1)).alias("n"))
    known = spark.range(1).select(
        F.explode(F.array(*[F.lit(s) for s in V.STATUSES])).alias("status"),
        F.lit(0).cast("bigint").alias("n"),
    )
    filled = (
        counts.unionByName(known).groupBy("status").agg(F.sum("n").alias("n"))
    )
    return filled.groupingSets([["status"], []], "status").agg(
        F.sum("n").alias("n")
    ).select(F.coalesce("status", F.lit("total")).alias("status"), "n")


def short_summary(results: DataFrame) -> DataFrame:
    """AGG-2: one row; catch-all addresses are in the total only."""
    status = F.col("status")
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "valid").alias("valid"),
        F.count_if(status == "unknown").alias("unknown"),
        F.count_if(status == "invalid").alias("invalid"),
    )


def normalize_records(results: DataFrame) -> DataFrame:
    """SCA-26: the four fields never NULL, optional ones as they are."""
    optional = [c for c in ("evidence", "generated", "hidden") if c in results.columns]
    return results.select(
        *[F.coalesce(F.col(f), F.lit("")).alias(f) for f in FIELDS], *optional
    )


def mailable(results: DataFrame) -> DataFrame:
    """SNK-1 rows: valid and seen by a reader; missing ``hidden`` is seen."""
    keep = F.col("status") == "valid"
    if "hidden" in results.columns:
        keep = keep & ~F.coalesce("hidden", F.lit(False))
    return results.filter(keep).select(*FIELDS)


def valid_addresses(results: DataFrame) -> DataFrame:
    """FLT-13: valid addresses, hidden ones included."""
    return results.filter(F.col("status") == "valid").select("email")


def search(results: DataFrame, query: str) -> DataFrame:
    """FLT-12: rows whose address or source contains the text."""
    needle = F.lit(query.lower())
    return results.filter(
        F.contains(F.lower("email"), needle) | F.contains(F.lower("source"), needle)
    )


def sort_results(results: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """TOP-6: range sort by any column.

    Address and source break ties, so a status that most rows share is still
    spread over many ranges.
    """
    ties = [c for c in ("email", "source") if c in results.columns and c != column]
    return results.orderBy(F.desc(column) if descending else F.asc(column), *ties)


def report_rows(results: DataFrame) -> DataFrame:
    """SNK-3: cells of the report, escaped, with link and marker flags."""
    rows = normalize_records(results)

    def present(name: str, kind: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast(kind)

    evidence = present("evidence", "array<string>")
    flag = lambda name: F.coalesce(present(name, "boolean"), F.lit(False))
    source = F.col("source")
    return rows.select(
        text.escape_html(F.col("email")).alias("email"),
        text.escape_html(source).alias("source"),
        (source.startswith("http://") | source.startswith("https://")).alias("linked"),
        F.col("status").alias("row_class"),
        text.escape_html(text.label(F.col("status"), V.ROW_LABELS)).alias("status"),
        F.when(evidence.isNull(), "")
        .when(F.size(evidence) == 0, V.NO_EVIDENCE)
        .otherwise(text.escape_html(F.array_join(evidence, ", ")))
        .alias("evidence"),
        F.when(flag("generated"), V.GENERATED_MARK).otherwise("").alias("generated_mark"),
        F.when(flag("hidden"), V.HIDDEN_MARK).otherwise("").alias("hidden_mark"),
        text.escape_html(F.col("error")).alias("error"),
    )


def tsv_lines(results: DataFrame) -> DataFrame:
    """SNK-4: ``email<TAB>status<TAB>source`` lines."""
    cells = [F.coalesce(F.col(c), F.lit("")) for c in ("email", "status", "source")]
    return results.select(F.concat_ws("\t", *cells).alias("value"))


def verdict_counts(results: DataFrame, keys: list | None = None) -> DataFrame:
    """AGG-19: one column per verdict."""
    counted = results.groupBy(*(keys or [])).agg(
        *[
            zero(F.count_if(F.col("status") == s)).alias(s)
            for s in ("valid", "catch_all", "unknown", "invalid")
        ]
    )
    return counted


def export_stamp() -> Column:
    """SCA-35: session-local time to the second with its offset."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")


def run_summary(results: DataFrame, tool: str, version: str) -> DataFrame:
    """SNK-2 metadata: one row of run facts and the count of every status.

    The statuses are few after counting, so they fit a map.
    """
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n"))))
    return summarize(results).agg(counts.alias("summary")).select(
        F.lit(tool).alias("tool"),
        F.lit(version).alias("version"),
        export_stamp().alias("exported_at"),
        "summary",
    )
