"""One query per operator over its whole table."""

from pyspark.sql import functions as F

from pagelens.llm import (
    bytebpe,
    codes,
    idfiles,
    imatch,
    langid,
    licences,
    packing,
    quality,
    setjoin,
    sharding,
    surrogates,
    vectors,
    whitening,
)
from pagelens.llm.inputs import ORACLES, QUERIES, query, table
from pagelens.operators.shared import scratch_path

__all__ = ["ORACLES", "QUERIES"]


@query("op9_nnls_packing")
def op9_nnls_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op6_addressable_id_files")
def op6_addressable_id_files(spark, sf_dir):
    folder = scratch_path(spark, "ids")
    return idfiles.round_trip(table(spark, sf_dir, "documents"), folder)


@query("op4_tree_byte_bpe")
def op4_tree_byte_bpe(spark, sf_dir):
    encoded = bytebpe.encode_documents(table(spark, sf_dir, "documents"))
    return bytebpe.decode_documents(encoded).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op1_cross_parsing_language")
def op1_cross_parsing_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    samples = langid.training_samples(docs.filter(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), samples)
    return found.select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score"
    )


@query("op10_hypergeometric_shards")
def op10_hypergeometric_shards(spark, sf_dir):
    text = F.col("text").cast("binary")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.crc32(F.lit(b""))).alias("text_crc32"),
    )
    return sharding.shuffle_into_shards(rows, 8, ["doc_id"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op7_epsilon_grid_order_join", vectors.near_sql())
def op7_epsilon_grid_order_join(spark, sf_dir):
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op8_set_relation_join", setjoin.groups_sql(3, 90, 100))
def op8_set_relation_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return setjoin.near_duplicate_groups(docs, size=3, num=90, den=100)


@query("op5_imatch_fingerprints", imatch.COMPARED_SQL)
def op5_imatch_fingerprints(spark, sf_dir):
    return imatch.compared(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


@query("op3_surrogate_pii")
def op3_surrogate_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs)


@query("op2_licence_paragraphs")
def op2_licence_paragraphs(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop(
        "text"
    )


@query("op13_trie_vector_codes", codes.codes_sql())
def op13_trie_vector_codes(spark, sf_dir):
    return codes.compress(table(spark, sf_dir, "embeddings"))


@query("op11_qdwh_whitening")
def op11_qdwh_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_subword_quality")
def op12_subword_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("class")
    )
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    held_out = F.coalesce(third == 1, F.lit(False))
    texts = quality.training_texts(docs, labels.filter(~held_out))
    return quality.score(docs, quality.train(texts)).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
