"""Building blocks shared by the jobs: shared storage, joins, ranks."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SMALL_ROWS = 100_000
RANK_WIDTH = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    context = spark.sparkContext
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="pagelens-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder of any file system Spark can write to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def taken(df: DataFrame, *folders: str) -> DataFrame:
    """Keeps what was read from scratch folders and removes the folders."""
    kept = cut(df)
    for folder in folders:
        remove_folder(df.sparkSession, folder)
    return kept


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Widen a scan with fewer splits than cores (one file is one split).

    Large inputs already have more splits than cores and are left alone, so
    no page text is shuffled at scale. ``df`` must be a plain scan.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Counted check before a broadcast; the count stops at the bound."""
    return df.limit(rows + 1).count() <= rows


def even_join(left: DataFrame, right: DataFrame, on: list | str, how: str = "inner") -> DataFrame:
    """Join of sides that both grow with the input: sorted, never broadcast.

    What the planner takes for the size of exploded rows follows from the
    compressed bytes of their files and is far too low; a broadcast would bring
    all of them through the driver. Hot keys are split at run time.
    """
    return left.join(right.hint("merge"), on, how)


def attach(
    facts: DataFrame,
    lookup: DataFrame,
    on: list | str,
    how: str = "left",
    salts: int = 1,
) -> DataFrame:
    """Join a lookup with one row per key to facts that may have hot keys.

    Adaptive execution splits the facts of a key that repeats, and broadcasts
    the lookup when its measured size is below the session's threshold; none
    is forced. Where it cannot split (adaptive execution off, or the join's
    output must keep its partitioning) name ``salts``: each lookup row is
    repeated per salt and each fact takes one by a hash of its own values, so
    a retried task gives the same rows and later filters still reach the scan.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if facts.isStreaming or salts <= 1:
        return facts.join(lookup, keys, how)
    mixed = [c for c, t in facts.dtypes if not t.startswith(("map", "array", "struct"))]
    salt = F.pmod(F.xxhash64(*mixed), F.lit(salts)).cast("int")
    copies = lookup.withColumn(
        "__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)]))
    )
    return (
        facts.withColumn("__salt", salt)
        .join(copies, [*keys, "__salt"], how)
        .drop("__salt")
    )


def unnest(
    df: DataFrame, keep: list, values: Column, value: str, pos: str = "pos"
) -> DataFrame:
    """One row per array item, with its position.

    A plain explode makes the optimizer add ``size(values) > 0`` below it and
    evaluate a costly ``values`` twice more; the outer form does not.
    """
    return df.select(
        *keep, F.posexplode_outer(values).alias(pos, value)
    ).filter(F.col(pos).isNotNull())


def first_by(
    df: DataFrame, keys: list, order: list, values: list | None = None
) -> DataFrame:
    """WIN-1: per key the row that comes first in ``order``.

    ``min_by`` combines on the map side, so a hot key costs one row per task
    instead of a sort of the whole group in one task.
    """
    values = values or [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*values), F.struct(*order)).alias("__first")
    return df.groupBy(*keys).agg(picked).select(*keys, "__first.*")


def running_number(
    df: DataFrame, run: list, seq: str, into: str, width: int = RANK_WIDTH
) -> DataFrame:
    """Rank of each row by a unique integer ``seq`` within its run.

    Rows are ranked inside slices of ``width`` consecutive values and shifted
    by the rows before the slice, so a run of any length is never sorted in
    one task. Only the per-slice counts are summed in order.
    """
    sliced = df.withColumn("__slice", F.floor(F.col(seq) / F.lit(width)))
    before = Window.partitionBy(*run).orderBy("__slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        sliced.groupBy(*run, "__slice")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    inside = Window.partitionBy(*run, "__slice").orderBy(seq)
    ranked = sliced.withColumn("__rank", F.row_number().over(inside))
    return (
        ranked.join(offsets, [*run, "__slice"])
        .withColumn(into, F.col("__rank") + F.col("__before"))
        .drop("__slice", "__rank", "__before")
    )


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("bigint")
