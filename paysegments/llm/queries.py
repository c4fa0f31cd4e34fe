"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysegments.llm import (
    ann,
    bpe,
    chat_format,
    fingerprints,
    language_id,
    merkle,
    mixing,
    pq_dedup,
    repair,
    sharding,
    simhash,
    substring_dedup,
    token_counts,
)
from paysegments.llm.ranking import group_key

Query = Callable[[SparkSession, str], DataFrame]

# A conversation whose texts hold a backslash and things that look like control strings.
ESCAPED = "\\### Assistant: </turn> ok"


DIMENSIONS = 64  # of the vectors of ``embeddings``


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit(ESCAPED)
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"),
        said.alias("text"),
    )
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = table.unionByName(extra)
    out = chat_format.format_conversations(turns, chat_format.text_parts(F.col("text")))
    line = F.lit("\n")
    spoken = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], line, chat_format.turn_text(t), line)), ""
    )
    return (
        out.withColumn("turns", chat_format.read_back(F.col("formatted")))
        .withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans")))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(spoken, 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    return encoded.select(
        "row.doc_id",
        bpe.n_tokens(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0, DIMENSIONS, k=20)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, most=3)
    return found.withColumn("fingerprint", simhash.hexadecimal(F.col("fingerprint")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.where(~held_out))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", language_id.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def op9_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pq_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), DIMENSIONS, threshold=0.98)
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(read(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    found = merkle.leaf([changed.get(f, F.col(f)) for f in fields])
    built = merkle.manifest(read(spark, sf_dir, "documents"), "doc_id", "lang", fields, {"found": F.when(tampered, found)})
    folded = merkle.fold(F.coalesce("found", "leaf"), F.col("proof"))
    return built.leaves.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults, by a checksum of conversation and turn; a null is one space."""
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    text, role, fault = F.coalesce("text", space), F.coalesce("role", space), F.col("fault")
    found = turns.withColumn("fault", F.crc32(name.cast("binary")) % 20).where("fault <> 0")
    return found.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("_"),
    ).drop("_")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conversations = turns.select("conv_id").distinct().withColumn("group", group_key(F.col("conv_id")))
    broken = damaged(turns)
    found = repair.repair(broken)
    texts = repair.repaired_text(found, broken).select("group", "repaired_sha256")
    per = conversations.join(repair.summary(found), "group", "left").join(texts, "group", "left")
    zero, nothing = F.lit(0).cast("long"), F.lit("")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return per.select(
        "conv_id",
        *[F.coalesce(n, zero).alias(n) for n in numbers],
        F.coalesce("audit", nothing).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(nothing, 256)).alias("repaired_sha256"),
    )


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.with_next(read(spark, sf_dir, "documents").select("doc_id", "text"))
    own = F.col("fingerprint")
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        fingerprints.likeness(own, F.col("edited_fingerprint")).alias("near_edited"),
        fingerprints.likeness(own, F.col("next_fingerprint")).alias("near_next"),
    )


def queries() -> dict[str, Query]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_bpe": op3_bpe,
        "op4_ann": op4_ann,
        "op5_simhash": op5_simhash,
        "op6_token_counts": op6_token_counts,
        "op7_mixing": op7_mixing,
        "op8_language_id": op8_language_id,
        "op9_pq_dedup": op9_pq_dedup,
        "op10_sharding": op10_sharding,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_document_fingerprints": op13_document_fingerprints,
    }
