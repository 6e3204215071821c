"""Memory of Python workers: batches of documents, and what outlives a task."""

import ctypes
import gc

from pyspark.sql import SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
# A row is a whole document here, so fewer go into a batch than by default.
DOCUMENTS = 1000

_held: dict = {}


def document_batches(spark: SparkSession) -> None:
    """Bounds the documents of an Arrow batch where the session does not say."""
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_ROWS):
        spark.conf.set(BATCH_ROWS, str(DOCUMENTS))


def _give_back() -> None:
    """Returns freed memory to the system where the C library can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def hold(name, make=lambda: None):
    """The object of this name, made on first use.

    Workers are reused by tasks of other operators, so whatever another name
    held is dropped: a worker's memory is bounded by the largest one.
    """
    if name not in _held:
        _held.clear()
        _give_back()
        _held[name] = make()
    return _held[name]
