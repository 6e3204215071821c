"""STR-5: stopping a run at the end of a batch, and starting it again."""

import time
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagelens.operators.shared import remove_folder
from pagelens.settings import SETTINGS


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system; none where it is missing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    return [found.getPath().getName() for found in files.listStatus(path)]


def planned_batches(spark: SparkSession, checkpoint: str) -> list[int]:
    """Batches whose input is on record, finished or not."""
    return sorted(int(n) for n in _names(spark, f"{checkpoint}/offsets") if n.isdigit())


def committed_batches(spark: SparkSession, checkpoint: str) -> list[int]:
    """Batches whose output is on record."""
    return sorted(int(n) for n in _names(spark, f"{checkpoint}/commits") if n.isdigit())


# What a run that never planned a batch can have left behind.
_UNPLANNED = ("offsets", "commits", "state")


def make_resumable(spark: SparkSession, checkpoint: str) -> None:
    """Clears what a run broken off before its first batch was on record left.

    Such a run has written nothing: output, state and the record of read files
    come after the record of the batch. Half-written records in an otherwise
    empty checkpoint keep Spark from starting there. A checkpoint with any
    batch on record is left alone; Spark goes on from it.
    """
    if planned_batches(spark, checkpoint):
        return
    # Checksums are not listed, so folders that look empty go as well.
    for folder in _UNPLANNED:
        remove_folder(spark, f"{checkpoint}/{folder}")


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_on_disk(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, whatever the session names.

    Keyed state with timers needs it, and seen addresses stay off the heap. A
    query copies the settings at its start, so the session's own come back
    after; one that resumes keeps the store its checkpoint was written with.
    """
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, SETTINGS[_PROVIDER])
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _last_batch(query: StreamingQuery) -> int | None:
    progress = query.lastProgress
    return None if progress is None else progress["batchId"]


def _between_batches(query: StreamingQuery) -> bool:
    """Waiting for data or for the next trigger; not while it starts up."""
    status = query.status
    return not status["isTriggerActive"] and status["message"].startswith("Waiting")


def stop_after_batch(
    query: StreamingQuery, patience: float | None = None, poll_seconds: float = 0.1
) -> bool:
    """Stops once the batch at work is on record; True if that was waited for.

    A batch that goes on for more than ``patience`` seconds is broken off: it
    is not lost, as the next run repeats it.
    """
    before, until = _last_batch(query), patience and time.monotonic() + patience
    while query.isActive and _last_batch(query) == before and not _between_batches(query):
        if until is not None and time.monotonic() >= until:
            query.stop()
            return False
        query.awaitTermination(poll_seconds)
    query.stop()
    return True


def stop_when(
    query: StreamingQuery,
    should_stop,
    poll_seconds: float = 1.0,
    patience: float | None = None,
) -> bool:
    """STR-5: stop on request, at the end of a batch.

    Finished batches stay written, and the same checkpoint resumes after them.
    True when the stop was asked for.
    """
    while not query.awaitTermination(poll_seconds):
        if should_stop():
            stop_after_batch(query, patience)
            return True
    return False
