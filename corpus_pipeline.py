"""From raw documents to packed training windows.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of
``docs``. An empty table passes all stages; extra columns are kept until the
last one.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelens.llm import langid, packing, setjoin, surrogates
from pagelens.operators.shared import cut, remove_folder, scratch_path, small, taken

BROADCAST_ROWS = 200_000
# Workers are shared with the other stages, so the packing memo is half its size.
MEMO_PARTS = 300_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language; ``lang`` becomes the one found.

    Learns from the labelled rows that are not held out; where no row is
    labelled, nothing is known about any language, and only texts without a
    letter go.
    """
    samples = langid.training_samples(docs.filter(~langid.held_out()))
    if not samples:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs, samples, into=("__lang", "__score"))
    kept = found.filter(F.col("__lang") != langid.UNKNOWN)
    return kept.withColumn("lang", F.col("__lang")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least ``doc_id`` of each group of near-duplicates.

    Rows with one ``doc_id`` are one document: it stays if any of them leads
    its group, and equal rows of it become one. Rows without ``doc_id`` stay.
    """
    groups = cut(setjoin.near_duplicate_groups(docs, size=5, num=80, den=100))
    by_id = groups.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("leads"),
    )
    # Documents that go, or whose rows must be looked at together: few.
    odd = cut(by_id.filter("leads = 0 or rows > 1"))
    marks = F.broadcast(odd) if small(odd, BROADCAST_ROWS) else odd
    plain = docs.join(marks.select("doc_id"), "doc_id", "left_anti")
    repeated = docs.join(
        marks.filter("leads = 1 and rows > 1").select("doc_id"), "doc_id", "left_semi"
    )
    return plain.select(docs.columns).unionByName(
        repeated.select(docs.columns).dropDuplicates()
    )


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in every text by surrogates."""
    replaced = surrogates.replace_entities(docs, into=("__entities", "__kinds"))
    size = F.char_length("text").cast("long")
    changed = F.when(F.col("__entities") > 0, size).otherwise(F.col("n_chars"))
    return replaced.withColumn("n_chars", changed).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts and packs all documents into windows."""
    return packing.pack_documents(docs, memo_parts=MEMO_PARTS)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]

# The language and window models cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what stages hand on is removed after use."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if folder is not None:
            remove_folder(spark, folder)
        docs, folder = spark.read.parquet(path), path
    return taken(STAGES[-1][1](spark, docs, sf_dir), folder)
