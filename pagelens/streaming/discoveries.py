"""Streaming form of the run: pages arrive, new addresses leave.

Arrival order takes the place of crawl order (``keyed`` has the forms that keep
crawl order). State and progress live in the checkpoint location, which belongs
in the shared folder.
"""

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from pagelens.operators import facts
from pagelens.operators.contacts import extract_contacts
from pagelens.operators.verdicts import classify_addresses
from pagelens.streaming.control import make_resumable, state_on_disk, stop_when  # noqa: F401


def stream_pages(
    spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None
) -> DataFrame:
    """SRC-1 as a stream of parquet files; ``schema`` is required."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_contacts(pages: DataFrame, tld: str = "cl", keep: list | None = None) -> DataFrame:
    """STR-1: addresses of each page as it arrives; no state."""
    return extract_contacts(pages, tld, keep)


def emit_once(contacts: DataFrame) -> DataFrame:
    """STR-2: each address once over the whole stream.

    The set of seen addresses grows with the stream, as in a batch run; it is
    partitioned by address and can be kept on disk by the state store.
    """
    return contacts.dropDuplicates(["email"])


def emit_once_within(contacts: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Bounded variant, another contract: once per ``delay`` of event time."""
    return contacts.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(
        ["email"]
    )


def classify_stream(
    contacts: DataFrame,
    mx: DataFrame,
    replies: DataFrame | None = None,
    catch_all: DataFrame | None = None,
    smtp_enabled: bool = True,
    tld: str = "cl",
) -> DataFrame:
    """STR-3: verdicts by stream-static joins against per-domain tables."""
    return classify_addresses(contacts, mx, replies, catch_all, smtp_enabled, tld)


PAGES, ADDRESSES = "pages", "addresses"
_KINDS = ("valid", "invalid", "unknown", "catch_all")


def page_metrics() -> list[Column]:
    """STR-4: what is counted of judged pages."""
    return [
        F.count_if(F.col("outcome") == outcome).alias(f"pages_{outcome}")
        for outcome in (facts.READ, facts.BLOCKED, facts.FAILED)
    ]


def address_metrics() -> list[Column]:
    """STR-4: what is counted of verdicts."""
    kinds = [F.count_if(F.col("status") == kind).alias(kind) for kind in _KINDS]
    return [F.count(F.lit(1)).alias("found"), F.count("status").alias("verified"), *kinds]


def counted_run(
    pages: DataFrame, judge, tld: str = "cl", pages_as=PAGES, addresses_as=ADDRESSES
) -> DataFrame:
    """The run over responses, counted on its way: no second pass.

    ``judge`` turns contacts into rows with ``status``. Pages that are walls or
    failed are counted and go no further. The metrics are those of the query's
    progress (or of an ``Observation`` given in place of a name).
    """
    judged = facts.with_walls(pages).observe(pages_as, *page_metrics())
    contacts = extract_contacts(judged.filter(F.col("outcome") == facts.READ), tld)
    return judge(contacts).observe(addresses_as, *address_metrics())


class Progress(StreamingQueryListener):
    """STR-4: input rows and observed counts of every batch, by query.

    A batch that is run again replaces its counts.
    """

    def __init__(self):
        self._batches: dict = {}

    def onQueryStarted(self, event):
        self._batches.setdefault(str(event.id), {})

    def onQueryProgress(self, event):
        progress = event.progress
        counts = {"rows": progress.numInputRows}
        for metrics in progress.observedMetrics.values():
            counts |= metrics.asDict()
        batches = self._batches.setdefault(str(progress.id), {})
        # A trigger without data repeats the number of the batch before it.
        if progress.numInputRows or progress.batchId not in batches:
            batches[progress.batchId] = counts

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def by_batch(self, query_id) -> dict[int, dict]:
        """Counts of each batch that had rows."""
        found = self._batches.get(str(query_id), {})
        return {b: dict(c) for b, c in sorted(found.items()) if c["rows"]}

    def total(self, query_id) -> dict:
        """The counts of all batches added up."""
        out: dict = {}
        for counts in self.by_batch(query_id).values():
            for name, value in counts.items():
                out[name] = out.get(name, 0) + value
        return out


def write_batches(
    stream: DataFrame, path: str, checkpoint: str, partition: str | None = None
) -> StreamingQuery:
    """STR-1 / STR-6: append what each batch found and stop at the end.

    The file sink commits a batch once, also when it is run again; a run that
    was broken off at any moment is taken up where it was.
    """
    make_resumable(stream.sparkSession, checkpoint)
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    if partition:
        writer = writer.partitionBy(partition)
    with state_on_disk(stream.sparkSession):
        return writer.start()


def write_counted(
    pages: DataFrame, judge, path: str, counts: str, checkpoint: str, tld: str = "cl"
) -> StreamingQuery:
    """STR-4 on record: each batch's rows below ``path``, its counts beside them.

    ``counts`` gets one row for each ``batch_id``: pages read, blocked and
    failed, addresses found and verified, and each status. They are observed
    while the rows are written; a repeated batch replaces its own.
    """

    def run(batch: DataFrame, batch_id: int):
        seen, verified = Observation(), Observation()
        rows = counted_run(batch, judge, tld, seen, verified)
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        noted = {**seen.get, **verified.get}
        schema = ", ".join(f"{name} BIGINT" for name in noted)
        batch.sparkSession.createDataFrame([tuple(noted.values())], schema).coalesce(
            1
        ).write.mode("overwrite").parquet(f"{counts}/batch_id={batch_id}")

    make_resumable(pages.sparkSession, checkpoint)
    return (
        pages.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def batch_counts(spark: SparkSession, counts: str) -> DataFrame:
    """``batch_id`` and the counts that ``write_counted`` noted."""
    return spark.read.parquet(counts)
