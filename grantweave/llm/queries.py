"""The queries of the numbered operators, over the whole of their tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, langid, licenses, line_rules, piece_bpe, prefix_trie, quality
from .common import held_out, table
from .fingerprints import document_fingerprints
from .packing import pack_documents
from .sharding import record_bytes, write_shards
from .simhash_dedup import hex16, near_duplicates


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files lie on this machine and its executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return write_shards(docs).select("doc_id", record_bytes().alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = document_fingerprints(table(spark, sf_dir, "documents"))
    return out.withColumns({c: hex16(c) for c in ("fingerprint", "edited_fingerprint")})


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= quality.PASS).cast("int").alias("predicted"))


def op5_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    out = piece_bpe.decode(piece_bpe.encode(table(spark, sf_dir, "documents"), model), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.measure(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    digest = decontaminate.items_digest().alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_sharding": op3_sharding,
    "op4_quality": op4_quality,
    "op5_piece_bpe": op5_piece_bpe,
    "op6_fingerprints": op6_fingerprints,
    "op7_langid": op7_langid,
    "op8_chat": op8_chat,
    "op9_line_rules": op9_line_rules,
    "op10_licenses": op10_licenses,
    "op11_divergence": op11_divergence,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_decontamination": op13_decontamination,
}
SQL: dict[str, str] = {
    "op8_chat": chat.SQL,
    "op9_line_rules": line_rules.SQL,
    "op10_licenses": licenses.SQL,
    "op11_divergence": divergence.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_decontamination": decontaminate.SQL,
}
