"""The registered query of each training-data operator, over its whole table."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import ann, embed_dedup, licenses, merkle, minhash, mixing, oracles, packing, pii, secrets, suffix, toxicity, trie, warc
from feedloom.llm.common import table

#: Where the public tokenizers' files are; only a default, operators take the path as a parameter.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.col("draws.shard").alias("shards"), F.col("draws.place").alias("places"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    found = merkle.manifest(table(spark, sf_dir, "documents"), F.when(tampered, F.translate("text", licenses.UPPER, licenses.LOWER)))
    return found.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_best_fit_packing, op2_warc, op3_toxicity, op4_secret_scans, op5_nearest_neighbours, op6_pii, op7_embedding_near_dedup, op8_source_mixing, op9_minhash_near_dedup, op10_suffix_array_dedup, op11_license_scans, op12_merkle_manifest, op13_conversation_prefix_trie]
    out = {f.__name__: f for f in own}
    if importlib.util.find_spec("corpus_pipeline"):
        out["pipeline"] = pipeline
    return out


def oracle_sql() -> dict[str, str]:
    """Only where SQL states the whole result and is quick enough over whole tables."""
    return {
        "op2_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
            f AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first FROM p),
            h AS (SELECT page_id, first, strlen(html) AS payload_bytes, sha1(html) AS hex, html FROM f),
            d AS (SELECT *, list_transform(range(32), lambda i: (
                (('0x' || substr(hex, CAST((i * 5) // 20 * 5 + 1 AS INTEGER), 5))::BIGINT >> (15 - (i * 5) % 20)) & 31)) AS fives FROM h)
            SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
                array_to_string(list_transform(fives, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v + 1 AS INTEGER), 1)), '') AS payload_digest,
                CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
                CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to FROM d""",
        "op11_license_scans": oracles.license_scans(),
        "op12_merkle_manifest": oracles.merkle_manifest(),
        "op13_conversation_prefix_trie": oracles.prefix_trie(),
    }
