"""Keyed state with event timers: what a stream must wait for before it speaks.

Event time is the order of collection: a millisecond for each ``crawl_seq``. A
watermark trails it by as many places as pages may come out of order; pages
that come later still are dropped by Spark. A finite run ends with
``end_of_run``, a page behind all others that lets the last timers fire.
"""

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagelens.functions import fixed_values as V, urls

# Workers receive this module with the task and need no copy of the package.
register_pickle_by_value(sys.modules[__name__])

# Place of the closing page: behind all others, and a time that pandas can hold.
END_PLACE = 9 * 10**12


def in_order(pages: DataFrame, disorder: int, seq: str = "crawl_seq") -> DataFrame:
    """Adds ``at``, with a watermark that trails it by ``disorder`` places.

    Places count from 0; the first watermark stands there, so times begin at 1.
    """
    return pages.withColumn("at", F.timestamp_millis(F.col(seq) + 1)).withWatermark(
        "at", f"{disorder} milliseconds"
    )


def end_of_run(spark: SparkSession, path: str, schema: str, tld: str = "cl") -> None:
    """Appends the closing page; its body looks like an address and holds none."""
    row = {"html": f".{tld}", "crawl_seq": END_PLACE, "url": ""}
    empty = spark.createDataFrame([], schema)
    values = [
        F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in empty.schema.fields
    ]
    spark.range(1).select(*values).write.mode("append").parquet(path)


# --- WIN-1 ---------------------------------------------------------------------------

_ORDER = ["crawl_seq", "generated", "pos"]
_SEEN = "crawl_seq BIGINT, generated BOOLEAN, pos INT, source STRING, hidden BOOLEAN"


class _FirstSeen(StatefulProcessor):
    """Holds the first occurrence of an address until none can come before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", _SEEN)
        self.emitted = handle.getValueState("emitted", "done BOOLEAN")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.emitted.exists():
            return iter(())
        known = tuple(self.best.get()) if self.best.exists() else None
        best = known
        for frame in rows:
            least = frame.sort_values(_ORDER).iloc[0]
            found = (
                int(least.crawl_seq),
                bool(least.generated),
                int(least.pos),
                str(least.source),
                bool(least.hidden),
            )
            if best is None or found[:3] < best[:3]:
                best = found
        if best != known:
            if known is not None:
                self.handle.deleteTimer(_due(known[0]))
            self.best.update(best)
            self.handle.registerTimer(_due(best[0]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        best = self.best.get()
        self.emitted.update((True,))
        self.best.clear()
        row = dict(zip(("crawl_seq", "generated", "pos", "source", "hidden"), best))
        yield pd.DataFrame([{"email": key[0], **row}])


def _due(seq: int) -> int:
    """With the watermark here, no page of this place is taken any more."""
    return seq + 1


def first_seen_stream(contacts: DataFrame) -> DataFrame:
    """WIN-1: each address once, with the flags of its first page in crawl order.

    ``contacts`` comes from pages with ``in_order`` and keeps ``crawl_seq`` and
    ``at``. An address leaves when the watermark has passed its first page, so
    the order of arrival does not matter within the stated disorder. The state
    of an address that has left is one flag.
    """
    if "generated" not in contacts.columns:
        contacts = contacts.withColumn("generated", F.lit(False))
    rows = contacts.select("email", *_ORDER, "source", "hidden", "at")
    return rows.groupBy("email").transformWithStateInPandas(
        _FirstSeen(), f"email STRING, {_SEEN}", "Append", "EventTime"
    )


# --- STR-3 ---------------------------------------------------------------------------

_ASKED = "email STRING, source STRING, hidden BOOLEAN"


class _CatchAll(StatefulProcessor):
    """One verdict for a domain; addresses wait for it, later ones reuse it."""

    def __init__(self, probes: int, wait: int):
        self.probes, self.wait = probes, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.verdict = handle.getValueState("verdict", "catch_all BOOLEAN")
        self.accepted = handle.getValueState("accepted", "many INT")
        self.waiting = handle.getListState("waiting", _ASKED)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.verdict.get()[0] if self.verdict.exists() else None
        many = self.accepted.get()[0] if self.accepted.exists() else None
        first = many is None and known is None
        many, refused, asked, begin = many or 0, False, [], None
        for frame in rows:
            probe = frame["probe"].astype(bool)
            codes = frame.loc[probe, "code"]
            many += int((codes == 250).sum())
            refused |= bool((codes != 250).any())
            asked.append(frame.loc[~probe, ["email", "source", "hidden"]])
            least = int(frame["at"].min().timestamp() * 1000)
            begin = least if begin is None else min(begin, least)
        asked = pd.concat(asked)
        if known is None:
            if refused:
                known = False
            elif many >= self.probes:
                known = True
            else:
                self.accepted.update((many,))
                if first:
                    self.handle.registerTimer(begin + self.wait)
                if len(asked):
                    self.waiting.appendList(list(asked.itertuples(index=False, name=None)))
                return iter(())
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            asked = pd.concat([self._held(), asked])
            self.verdict.update((known,))
            self.accepted.clear()
        return _judged(key, asked, known)

    def _held(self) -> pd.DataFrame:
        held = [tuple(row) for row in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.clear()
        return pd.DataFrame(held, columns=["email", "source", "hidden"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # Too few answers: not proven.
        self.verdict.update((False,))
        self.accepted.clear()
        return _judged(key, self._held(), False)


def _judged(key, asked: pd.DataFrame, catch_all: bool) -> Iterator[pd.DataFrame]:
    if len(asked):
        yield asked.assign(domain=key[0], catch_all=catch_all)[
            ["domain", "email", "source", "hidden", "catch_all"]
        ]


def catch_all_stream(
    addresses: DataFrame,
    probes: DataFrame,
    wait: int,
    most_probes: int = V.CATCH_ALL_PROBES,
    salts: int = 1,
) -> DataFrame:
    """STR-3 where probes arrive too: each address with its domain's verdict.

    Both sides have ``at`` with a watermark. A domain is not catch-all at the
    first answer other than 250, and catch-all when ``most_probes`` were
    accepted; what is not settled ``wait`` places after the domain was first
    seen is not proven. Addresses wait for the verdict; it is kept, and later
    addresses leave at once. A domain with most of the addresses is split by
    ``salts``: every part gets the domain's probes and comes to the same end.
    """
    salt = F.pmod(F.xxhash64("email"), F.lit(salts)).cast("int")
    # A missing answer is no acceptance.
    code = F.coalesce(F.col("code"), F.lit(0)).cast("int")
    asked = addresses.select(
        urls.email_domain(F.col("email")).alias("domain"), salt.alias("salt"), "at",
        F.lit(False).alias("probe"), F.lit(0).alias("code"), "email", "source", "hidden",
    )
    none = F.lit(None).cast("string")
    answers = probes.select(
        "domain", F.explode(F.array([F.lit(i) for i in range(salts)])).alias("salt"), "at",
        F.lit(True).alias("probe"), code.alias("code"), none.alias("email"),
        none.alias("source"), F.lit(False).alias("hidden"),
    )
    return (
        asked.unionByName(answers)
        .groupBy("domain", "salt")
        .transformWithStateInPandas(
            _CatchAll(most_probes, wait),
            f"domain STRING, {_ASKED}, catch_all BOOLEAN",
            "Append",
            "EventTime",
        )
    )
