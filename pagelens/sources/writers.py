"""Writers: exports, measurement tables and history appends."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelens.functions.fixed_values import OUTPUT_FORMATS
from pagelens.operators import results as R, sessions as S
from pagelens.operators.shared import remove_folder, small
from pagelens.schemas import SESSION_EMAILS, SESSIONS


def infer_format(path: str) -> str:
    """Format implied by the extension; an unknown one fails before any work."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    extension = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if extension not in OUTPUT_FORMATS:
        raise ValueError(
            f"cannot tell the output format of {name!r}; use .csv, .json or "
            ".html, or name the format"
        )
    return OUTPUT_FORMATS[extension]


def write_valid_csv(results: DataFrame, path: str, mode: str = "errorifexists"):
    """SNK-1: the mailable list, four columns with a header."""
    _csv(R.mailable(results), path, mode)


TOOL, VERSION = "pagelens", "1"


def summary_path(path: str) -> str:
    """Where the metadata of an export lies: beside its records."""
    return f"{path.rstrip('/')}.summary"


def write_records_json(results: DataFrame, path: str, mode: str = "errorifexists"):
    """SNK-2: every record, and the run's metadata beside them.

    Absent optional fields are absent keys. ``<path>.summary`` holds one
    object: tool, version, time of export and the count of every status.
    """
    R.normalize_records(results).write.mode(mode).option(
        "ignoreNullFields", True
    ).json(path)
    R.run_summary(results, TOOL, VERSION).coalesce(1).write.mode(mode).json(
        summary_path(path)
    )


def write_report_rows(results: DataFrame, path: str, mode: str = "errorifexists"):
    """SNK-3: report cells as JSON lines."""
    R.report_rows(results).write.mode(mode).json(path)


def write_tsv(results: DataFrame, path: str, mode: str = "errorifexists"):
    """SNK-4: tab-separated lines."""
    R.tsv_lines(results).write.mode(mode).text(path)


_WRITERS = {
    "csv": write_valid_csv,
    "json": write_records_json,
    "html": write_report_rows,
}


def resolve_format(path: str | None, fmt: str | None = None) -> str | None:
    """SNK-5: settle the format first, so a typo costs no cluster time."""
    if path is None:
        return None
    chosen = fmt or infer_format(path)
    if chosen not in _WRITERS:
        raise ValueError(f"unknown output format {chosen!r}; use {', '.join(_WRITERS)}")
    return chosen


def default_path(
    spark: SparkSession, folder: str, fmt: str = "csv", tool: str = TOOL, day=None
) -> str:
    """SCA-35: where an export goes that was given no path.

    ``<tool>-<day>.<format>`` in ``folder``; the day is today's by the clock and
    time zone of the session unless given.
    """
    if fmt not in _WRITERS:
        raise ValueError(f"unknown output format {fmt!r}; use {', '.join(_WRITERS)}")
    if day is None:
        day = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd")).first()[0]
    return f"{folder.rstrip('/')}/{tool}-{day}.{fmt}"


def write_results(
    results: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists"
):
    """SNK-5: write in the format given or implied by the path."""
    _WRITERS[resolve_format(path, fmt)](results, path, mode)


def committed_path(path: str) -> str:
    """Where the writes of an append table that are whole are on record."""
    return f"{path.rstrip('/')}.committed"


def append_by_target(
    rows: DataFrame, path: str, column: str = "domain", write_id: str | None = None
):
    """SNK-6: add rows under their target's own folder.

    Rows are spread by target and address first: each target gets few files
    and a target with most of the rows is written by many tasks.

    With ``write_id`` the append can be repeated: below its target a write has
    a folder of its own, which a second attempt replaces. The write is put on
    record when all of it is there; ``read_appended`` takes no other.
    """
    dealt = (
        rows.withColumn("__part", F.pmod(F.xxhash64("email"), F.lit(16)))
        .repartition(column, "__part")
        .drop("__part")
    )
    if write_id is None:
        dealt.write.mode("append").partitionBy(column).parquet(path)
        return
    dealt.withColumn("write_id", F.lit(write_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(column, "write_id").parquet(path)
    record = rows.sparkSession.range(1).select(
        F.current_timestamp().alias("at"), F.lit(write_id).alias("write_id")
    )
    record.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "write_id"
    ).parquet(committed_path(path))


def read_appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all writes on record; ``schema`` is that of the rows.

    Both partition columns are texts. The folders of a write that was broken
    off are pruned, not read.
    """
    files = spark.read.schema(f"{schema}, write_id STRING").parquet(path)
    whole = spark.read.schema("at TIMESTAMP, write_id STRING").parquet(committed_path(path))
    whole = whole.select("write_id").distinct()
    whole = F.broadcast(whole) if small(whole) else whole
    return files.join(whole, "write_id", "left_semi").drop("write_id")


def write_measures(rows: DataFrame, path: str, mode: str = "errorifexists"):
    """SNK-7: measurement rows with a header."""
    _csv(rows, path, mode)


def append_table(rows: DataFrame, path: str, partition: str | None = None):
    """SNK-8 / SNK-9: one bulk append to a history table.

    Rows are dealt by their folder first, or each task would open a file in
    every folder; large folders are split at run time.
    """
    if partition:
        rows = rows.hint("rebalance", partition)
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


# Sessions that share a folder of a history table.
FOLDER_SESSIONS = 1000
# Folders of a history table, however many sessions it has.
FOLDERS = 1000
# Folders named in the filter of a partial rewrite; more are found by a join.
NAMED_FOLDERS = 10_000


def in_folders(rows: DataFrame, session: str, wide: int = FOLDER_SESSIONS) -> DataFrame:
    """Adds ``folder``, the partition of a history table that a session is in.

    ``wide`` sessions in a row share a folder; after ``FOLDERS`` of them the
    first one is used again. A table of any length then has no more folders,
    each with more rows, and writing it takes time by its rows.
    """
    run = F.floor(F.col(session) / F.lit(wide)).cast("bigint")
    return rows.withColumn("folder", F.pmod(run, F.lit(FOLDERS)).cast("bigint"))


def pending_path(path: str) -> str:
    """Where rewritten folders wait until they are all there."""
    return f"{path.rstrip('/')}.pending"


def finish_rewrite(spark: SparkSession, path: str, partition: str, schema: str) -> None:
    """Puts folders in place that a rewrite had ready when it was broken off.

    Without any, or where they were not all ready, nothing changes.
    """
    waiting = pending_path(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(waiting)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return
    if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{waiting}/_SUCCESS")):
        spark.read.schema(schema).parquet(waiting).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(partition).parquet(path)
    remove_folder(spark, waiting)


def rewrite_folders(
    spark: SparkSession, path: str, partition: str, touched: DataFrame, change, schema: str
) -> None:
    """SNK-10 / SNK-11: rewrites the folders that ``touched`` names, no others.

    ``touched`` has the column ``partition``; ``change`` turns the rows of
    those folders into their new rows. The new rows are first written beside
    the table and then replace their folders, so a rewrite that is broken off
    loses nothing: the next one (or ``finish_rewrite``) puts them in place.
    Folders that are not named keep their files. One writer at a time.
    """
    finish_rewrite(spark, path, partition, schema)
    names = touched.select(partition).filter(F.col(partition).isNotNull()).distinct()
    table = spark.read.schema(schema).parquet(path)
    if small(names, NAMED_FOLDERS):
        found = [row[0] for row in names.collect()]
        if not found:
            return
        chosen = table.filter(F.col(partition).isin(found))
    else:
        chosen = table.join(names, partition, "left_semi")
    waiting = pending_path(path)
    # Sums and the like may have become wider than the table's columns.
    fresh = change(chosen).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields]
    )
    # A folder is one file, or several where its size asks for them.
    fresh.hint("rebalance", partition).write.partitionBy(partition).parquet(waiting)
    finish_rewrite(spark, path, partition, schema)


def update_status_at(
    spark: SparkSession,
    path: str,
    updates: DataFrame,
    schema: str = SESSION_EMAILS,
    wide: int = FOLDER_SESSIONS,
) -> None:
    """SNK-10 on a stored table, appended with ``in_folders``."""
    rewrite_folders(
        spark,
        path,
        "folder",
        in_folders(updates, "session_id", wide),
        lambda rows: S.update_status(rows, updates),
        f"{schema}, folder BIGINT",
    )


def update_totals_at(
    spark: SparkSession,
    path: str,
    emails: DataFrame,
    schema: str = SESSIONS,
    wide: int = FOLDER_SESSIONS,
) -> None:
    """SNK-11 on a stored table: the sessions that have addresses."""
    rewrite_folders(
        spark,
        path,
        "folder",
        in_folders(emails, "session_id", wide),
        lambda rows: S.update_totals(rows, emails),
        f"{schema}, folder BIGINT",
    )


def _csv(rows: DataFrame, path: str, mode: str):
    rows.write.mode(mode).option("header", True).option("emptyValue", "").option(
        "escape", '"'
    ).csv(path)
