"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlane.llm import bpe, chat, itq, langid, lm, media, minhash, mixing, oracle, packing, sharding
from siftlane.llm.common import fold, read_table, shared_dir, stage


def tokenizer() -> str:
    """The path of the vocabulary of op1, op3 and the pipeline: looked for only where it is needed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids of op3's vocabulary, two bytes each, in packed rows of 8192 tokens."""
    ids = stage(bpe.encode_ids(read_table(spark, sf_dir, "documents"), tokenizer(), width=2), "packing-ids")
    return packing.pack(ids, row=8192, key="id", ids="ids", width=2)


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a model of their training folds."""
    out = lm.score(read_table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id")


def op3_bpe_speculate_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    out = bpe.encode(read_table(spark, sf_dir, "documents"), tokenizer())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes; and in 17 by the map's next version."""
    measured = sharding.measure(read_table(spark, sf_dir, "documents"))
    sizes = sharding.slot_sizes(measured)
    path = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    sharding.save_map(sharding.new_map(sizes, 16), path)
    sharding.save_map(sharding.rebalance(sharding.load_map(spark, path), sizes, 17), path)
    after = sharding.load_map(spark, path).select(F.col("slot").alias("virtual_slot"), F.col("shard").alias("next_shard"), F.col("version").alias("next_version"))
    out = sharding.place(measured, sharding.load_map(spark, path, 1)).join(F.broadcast(after), "virtual_slot", "left")  # at most SLOTS rows
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version", "next_shard", "next_version")


def op5_hierarchical_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of the documents for a budget of 0.6 of all tokens, two epochs at most."""
    out = mixing.mix(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "domain", "lang", "source", "n_tokens", "epoch", "given")


def op6_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a sound, read back and fingerprinted; feature names the arrays' size and digest."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).alias("n_bytes"))
    out = media.analyse(media.store(docs, keep=("doc_id", "n_bytes")))
    size = F.octet_length("samples")
    prints = F.concat_ws(";", F.array_join("peak_times", ","), F.array_join("peak_codes", ","))
    return out.select(
        "doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), size.cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("peak_codes").cast("string"), F.md5(F.encode(prints, "UTF-8"))).alias("feature"), F.size("peak_codes").alias("n_pairs"), "peak_times", "peak_codes",
    )


def op7_transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles recovered from raw transcripts of all conversations, and their canonical form."""
    raw = stage(chat.transcripts(read_table(spark, sf_dir, "conversations")), "chat-transcripts")
    model = chat.fit(chat.training_rows(raw))
    out = chat.parse(raw, model, keep=("id", "segment", "piece", "true_roles"), before="before", after="after")
    return out.select(F.col("id").alias("conv_id"), "segment", "piece", (fold("id", 5) == 0).alias("held_out"), F.size("true_roles").alias("n_true"), F.size("roles").alias("n_turns"), "roles", (F.col("roles") == F.col("true_roles")).alias("recovered"), "rendered")


def op8_subword_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    docs = read_table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).withColumnRenamed("id", "doc_id")


def op9_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return itq.near_vectors(read_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op10_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the documents: three-word shingles, Jaccard 0.85."""
    out = minhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, percent=85, rows=6, bands=20)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_deleted_interpolation, op3_bpe_speculate_verify, op4_virtual_slots, op5_hierarchical_budgets, op6_wav_fingerprints, op7_transcript_roles, op8_subword_langid, op9_itq_dedup, op10_circulant_minhash)
}
SQL: dict[str, str] = oracle.SQL
