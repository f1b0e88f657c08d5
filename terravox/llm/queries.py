"""The registered queries of the thirteen operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravox.llm import automata_dedup, decontaminate, filter_audit, html_text, id_store, language, mixing, packing, quality, simhash, sql, suffix_merge, vector_links, whitening
from terravox.llm.common import read


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _crc(column):
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op1_quality_classifier(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    voters = quality.fit(docs, labels.filter(_crc("doc_id") % 4 != 2))
    out = quality.scores(docs, voters)
    held = F.coalesce(_crc("id") % 4 == 2, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs.filter(_crc("doc_id") % 5 != 0))
    held = F.coalesce(_crc("id") % 5 == 0, F.lit(False))
    return language.predict(docs, model).select(F.col("id").alias("doc_id"), held.alias("held_out"), "lang_pred", "score", "accepted")


def op3_benchmark_decontamination(spark, sf_dir):
    return decontaminate.report(decontaminate.hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op4_embedding_near_dedup(spark, sf_dir):
    return vector_links.near_vectors(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op5_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def op6_html_extraction(spark, sf_dir):
    return html_text.main_text(read(spark, sf_dir, "pages"))


def op7_substring_dedup(spark, sf_dir):
    out = automata_dedup.passage_dedup(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


def op8_best_fit_packing(spark, sf_dir):
    packed = packing.best_fit(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return packed.withColumnRenamed("id", "doc_id")


def op9_suffix_array_dedup(spark, sf_dir):
    out = suffix_merge.substring_dedup(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op10_token_id_output(spark, sf_dir):
    path = id_store.write_store(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return id_store.read_store(spark, path).withColumnRenamed("id", "doc_id")


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", read(spark, sf_dir, "labels"))


def op12_embedding_whitening(spark, sf_dir):
    out = whitening.whitened(read(spark, sf_dir, "embeddings"))
    # The exact sum is a decimal; it fits in 64 bits up to some millions of unit vectors.
    return out.select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def op13_source_mixing(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_classifier, op2_language_id, op3_benchmark_decontamination, op4_embedding_near_dedup, op5_simhash_near_dedup, op6_html_extraction, op7_substring_dedup, op8_best_fit_packing, op9_suffix_array_dedup, op10_token_id_output, op11_filter_audit, op12_embedding_whitening, op13_source_mixing)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_benchmark_decontamination": sql.DECONTAMINATION,
        "op4_embedding_near_dedup": sql.VECTORS,
        "op7_substring_dedup": sql.PASSAGES,
        "op9_suffix_array_dedup": sql.SUBSTRINGS,
        "op11_filter_audit": sql.FILTER_AUDIT,
        "op13_source_mixing": sql.MIX,
    }
