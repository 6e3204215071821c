"""Packing of token ids into fixed windows by non-negative least squares.

A document longer than a window is cut into full windows and a rest; shorter
ones stay whole. Lengths are binned to a grid, all combinations of at most
three bins that fill a window are enumerated, and a non-negative least squares
fit against the histogram gives how often each is used. The rounded counts are
taken from the histogram and the residue is packed greedily, again as patterns
with repeat counts. Only the histogram (at most ``GRID_BINS`` rows) reaches the
driver; pieces find their place by their rank within their bin.

Defined results: NULL text has the end id only; repeated rows are packed each
on their own; an empty table gives no rows; a NULL ``doc_id`` is kept as it is;
extra columns are ignored.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pagelens.llm.words import WORD_TOKENIZER, word_encoder
from pagelens.llm.worker import document_batches
from pagelens.operators.shared import cut

WINDOW = 2048
END_ID = 1
GRID_BINS = 256
DEPTH = 3
# Rows ranked in one sort are about this many; slices of a bin are shifted.
SLICE_ROWS = 1 << 20
LEAST_SLICES = 64

PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
    ]
)


def token_pieces(
    docs: DataFrame,
    window: int = WINDOW,
    end_id: int = END_ID,
    with_ids: bool = False,
    tokenizer: str = WORD_TOKENIZER,
    memo_parts: int | None = None,
) -> DataFrame:
    """The pieces of every document, with their ids where asked for.

    ``memo_parts`` trades a worker's memory for time (default: the encoder's).

    Cuts depend on the document alone, so the checksum of a piece is taken
    where its ids are made and no ids need to be shuffled.
    """
    ids_field = [T.StructField("ids", T.BinaryType())] if with_ids else []
    schema = T.StructType(PIECE.fields + ids_field)
    end = int(end_id).to_bytes(4, "little")
    document_batches(docs.sparkSession)

    def run(batches):
        encoder = word_encoder(tokenizer, memo_parts)
        for batch in batches:
            rows = [[] for _ in schema.fields]
            encoded = encoder.encode(batch.column(1).to_pylist())
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    row = (doc_id, start, len(part) // 4, zlib.crc32(part), total)
                    for column, value in zip(rows, row + (part,)):
                        column.append(value)
            kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(rows, kinds)], names=schema.names
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


@dataclass
class Plan:
    """Patterns of bins with repeat counts."""

    patterns: list[tuple[int, ...]]
    repeats: list[int]

    def slots(self):
        """Per bin the ranks that go to each slot, as sorted arrays.

        Returns ``bin -> (first rank, first sequence, slot)``.
        """
        taken: dict[int, int] = {}
        found: dict[int, list] = {}
        sequence = 0
        for pattern, times in zip(self.patterns, self.repeats):
            for slot, size in enumerate(pattern):
                rank = taken.get(size, 0)
                found.setdefault(size, []).append((rank, sequence, slot))
                taken[size] = rank + times
            sequence += times
        return {size: np.array(rows, dtype=np.int64).T for size, rows in found.items()}


def fillings(bins: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Combinations of at most ``depth`` bins whose sum is exactly ``bins``."""
    out: list[tuple[int, ...]] = []

    def grow(rest, most, chosen):
        if rest == 0:
            out.append(tuple(chosen))
        elif len(chosen) < depth:
            for size in range(min(rest, most), 0, -1):
                if size * (depth - len(chosen)) < rest:
                    break
                grow(rest - size, size, [*chosen, size])

    grow(bins, bins, [])
    return out


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """Active-set least squares with non-negative weights.

    ``columns`` holds the multiplicities of each bin, one combination a row.
    """
    scale = max(float(target.max(initial=0.0)), 1.0)
    b = target / scale
    x = np.zeros(len(columns))
    active = np.zeros(len(columns), dtype=bool)
    for _ in range(rounds):
        slope = columns @ (b - x @ columns)
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-10:
            break
        active[best] = True
        while True:
            chosen = np.flatnonzero(active)
            fit = np.linalg.lstsq(columns[chosen].T, b, rcond=None)[0]
            if fit.min() > 0:
                x[:] = 0
                x[chosen] = fit
                break
            bad = fit <= 0
            old = x[chosen]
            step = np.min(old[bad] / np.maximum(old[bad] - fit[bad], 1e-300))
            x[chosen] = old + step * (fit - old)
            drop = chosen[x[chosen] <= 1e-12]
            x[drop] = 0
            active[drop] = False
            if not active.any():
                break
    return x * scale


def solve(histogram: dict[int, int], bins: int = GRID_BINS, depth: int = DEPTH) -> Plan:
    """Patterns that use every piece of the histogram exactly once."""
    left = np.zeros(bins + 1, dtype=np.int64)
    for size, count in histogram.items():
        left[size] = count
    patterns: list[tuple[int, ...]] = []
    repeats: list[int] = []
    if left.sum() == 0:
        return Plan(patterns, repeats)

    combos = [c for c in fillings(bins, depth) if all(left[s] for s in c)]
    if combos:
        columns = np.zeros((len(combos), bins + 1))
        for i, combo in enumerate(combos):
            np.add.at(columns[i], list(combo), 1)
        weights = nnls(columns, left.astype(float))
        for i in np.argsort(-weights, kind="stable"):
            if weights[i] < 0.5:
                break
            sizes, many = np.unique(combos[i], return_counts=True)
            times = min(round(weights[i]), int((left[sizes] // many).min()))
            if times > 0:
                left[sizes] -= times * many
                patterns.append(combos[i])
                repeats.append(times)

    while left.any():
        space, pattern = bins, []
        rest = left.copy()
        while space > 0:
            fits = np.flatnonzero(rest[: space + 1])
            if not len(fits):
                break
            size = int(fits[-1])
            pattern.append(size)
            rest[size] -= 1
            space -= size
        sizes, many = np.unique(pattern, return_counts=True)
        times = int((left[sizes] // many).min())
        left[sizes] -= times * many
        patterns.append(tuple(pattern))
        repeats.append(times)
    return Plan(patterns, repeats)


def _ranked(pieces: DataFrame, most: int) -> DataFrame:
    """Rank of each piece within its bin, without sorting a bin in one task."""
    slices = max(LEAST_SLICES, -(-most // SLICE_ROWS))
    order = ["doc_id", "start", "length", "ids_crc32"]
    sliced = pieces.withColumn("__slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    before = Window.partitionBy("__bin").orderBy("__slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shift = (
        sliced.groupBy("__bin", "__slice")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    inside = Window.partitionBy("__bin", "__slice").orderBy(*order)
    return (
        sliced.withColumn("__rank", F.row_number().over(inside) - 1)
        .join(shift, ["__bin", "__slice"])
        .withColumn("__rank", F.col("__rank") + F.col("__before"))
        .drop("__slice", "__before")
    )


def _place(bin_: Column, rank: Column, plan: Plan) -> Column:
    """Sequence and slot of the piece with this rank in its bin.

    The slots are at most a few per pattern, and patterns are bounded by the
    bins, so what travels with the tasks does not grow with the data.
    """
    slots = plan.slots()

    def place(bins: pa.Array, ranks: pa.Array) -> pa.Array:
        b, r = bins.to_numpy(), ranks.to_numpy()
        sequence, slot = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
        for size in np.unique(b):
            rows = np.flatnonzero(b == size)
            first, base, position = slots[int(size)]
            at = np.searchsorted(first, r[rows], side="right") - 1
            sequence[rows] = base[at] + r[rows] - first[at]
            slot[rows] = position[at]
        return pa.StructArray.from_arrays(
            [pa.array(sequence), pa.array(slot)], ["sequence_id", "slot"]
        )

    kind = "struct<sequence_id: bigint, slot: bigint>"
    return F.arrow_udf(place, kind).asNondeterministic()(bin_, rank)


def pack(pieces: DataFrame, window: int = WINDOW, bins: int = GRID_BINS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``window`` ids."""
    bins = min(bins, window)
    grid = -(-window // bins)
    bins = -(-window // grid)
    binned = cut(
        pieces.withColumn("__bin", F.ceil(F.col("length") / F.lit(grid)).cast("int"))
    )
    histogram = {r[0]: r[1] for r in binned.groupBy("__bin").count().collect()}
    plan = solve(histogram, bins)
    ranked = _ranked(binned, max(histogram.values(), default=0))
    placed = ranked.withColumn(
        "__at", _place(F.col("__bin"), F.col("__rank").cast("long"), plan)
    )
    before = Window.partitionBy("sequence_id").orderBy("__slot").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        placed.select(
            *pieces.columns,
            F.col("__at.sequence_id").alias("sequence_id"),
            F.col("__at.slot").alias("__slot"),
        )
        .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
        .drop("__slot")
    )


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Every whole document, cut and packed."""
    return pack(token_pieces(docs, **options), options.get("window", WINDOW))
