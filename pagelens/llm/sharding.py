"""Uniform shuffle into shards of exact size by a communication matrix.

Rows belong to ``parts`` local partitions by a keyed hash. How many rows each
partition sends to each target block is drawn from the multivariate
hypergeometric distribution, so that the margins are exactly the partition
counts and the block sizes. Each partition permutes its rows and deals them out
by its row of the matrix; each block permutes what it got. A shard is a run of
``BLOCKS`` blocks, so its rows are numbered without counting or sorting it
whole. The law is ``rows``: shard sizes differ by one at most.

Only the partition counts reach the driver (``parts`` rows, a parameter), and
the matrix (``parts`` times ``shards * BLOCKS`` numbers) is all that is
broadcast; neither grows with the data.

Defined results: any column may be NULL; rows equal in all columns may change
places, which changes nothing; an empty table gives no rows; ``shard`` and
``slot`` replace columns of those names. The draw depends on ``seed`` and the
counts alone and the order on keyed hashes, so a task run again gives the same
rows.
"""

import math
import random

from pyspark.sql import Column, DataFrame, Window, functions as F

PARTS = 256
BLOCKS = 16
SEED = 20_240_229


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Exact draw by inversion outwards from the mode; any population size."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = (draws + 1) * (good + 1) // (good + bad + 2)
    mode = min(max(mode, low), high)

    def log_choose(n, k):
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    peak = math.exp(
        log_choose(good, mode)
        + log_choose(bad, draws - mode)
        - log_choose(good + bad, draws)
    )
    left = rng.random() - peak
    up = down = mode
    p_up = p_down = peak
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / (
                (good - down + 1) * (draws - down + 1)
            )
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(
    counts: dict[int, int], sizes: list[int], seed: int = SEED
) -> dict[int, list[int]]:
    """Rows each partition sends to each block; all margins are exact."""
    rng = random.Random(seed)
    room = list(sizes)
    matrix = {}
    for part in sorted(counts):
        rest, open_ = counts[part], sum(room)
        row = []
        for i, size in enumerate(room):
            taken = hypergeometric(rng, size, open_ - size, rest) if rest else 0
            row.append(taken)
            open_ -= size
            rest -= taken
            room[i] -= taken
        matrix[part] = row
    return matrix


def block_sizes(rows: int, shards: int, blocks: int = BLOCKS) -> list[int]:
    """Sizes of all blocks, shard by shard."""
    out = []
    for s in range(shards):
        size = rows // shards + (s < rows % shards)
        out += [size // blocks + (b < size % blocks) for b in range(blocks)]
    return out


def _mixed(seed: int, keys: list[str]) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def shuffle_into_shards(
    rows: DataFrame,
    shards: int,
    keys: list[str],
    seed: int = SEED,
    parts: int = PARTS,
    blocks: int = BLOCKS,
) -> DataFrame:
    """Adds ``shard`` and ``slot`` to every row.

    ``keys`` tell rows apart; all other columns only travel along.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    sortable = [c for c, t in rows.dtypes if not t.startswith("map")]
    # Rows without keys, or with equal ones, are told apart by what they hold.
    told = [*keys, *[c for c in sortable if c not in keys]]
    part = F.pmod(_mixed(seed, told), F.lit(parts)).cast("int")
    counts = {r[0]: r[1] for r in rows.select(part.alias("p")).groupBy("p").count().collect()}
    sizes = block_sizes(sum(counts.values()), shards, blocks)
    dealt = []
    for p, row in communication_matrix(counts, sizes, seed).items():
        ends, total = [], 0
        for n in row:
            total += n
            ends.append(total)
        dealt.append((p, ends))
    bounds = spark.createDataFrame(dealt, "__part int, __ends array<bigint>")

    starts, total = [], 0
    for i, size in enumerate(sizes):
        total = 0 if i % blocks == 0 else total
        starts.append(total)
        total += size

    local = Window.partitionBy("__part").orderBy(_mixed(seed + 1, told), *sortable)
    again = Window.partitionBy("__block").orderBy(_mixed(seed + 2, told), *sortable)
    # Rows up to each end go to that block: the first end above the rank.
    block = F.size(F.filter("__ends", lambda end: end <= F.col("__rank")))
    return (
        rows.withColumn("__part", part)
        .withColumn("__rank", F.row_number().over(local) - 1)
        .join(F.broadcast(bounds), "__part")
        .withColumn("__block", block)
        .drop("__part", "__rank", "__ends")
        .withColumn("__at", F.row_number().over(again) - 1)
        .withColumn("shard", F.floor(F.col("__block") / F.lit(blocks)).cast("int"))
        .withColumn(
            "slot",
            F.element_at(F.array(*[F.lit(s) for s in starts]), F.col("__block") + 1)
            .cast("long") + F.col("__at"),
        )
        .drop("__block", "__at")
    )
