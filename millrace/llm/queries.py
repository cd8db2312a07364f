"""The registered queries of this subpackage, by name."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import (
    bpe, chat, collocations, decontaminate, language, neighbours, packing, quality, sharding, simhash, substrings,
    token_counts, whitening,
)
from millrace.llm.common import table


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    documents = table(spark, folder, "documents")
    held_out = language.fold(F.col("doc_id"), 4) == 2
    models = language.trained(documents.filter(~F.coalesce(held_out, F.lit(False))))
    found = language.identified(documents, models)
    held_out = F.coalesce(language.fold(F.col("id"), 4) == 2, F.lit(False))
    return found.select(
        F.col("id").alias("doc_id"), held_out.alias("held_out"), F.col("lang").alias("lang_pred"), "score"
    )


def _digests(batches):
    """What a formatted conversation says, read back from its text and loss mask."""
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            turns = "".join(f"{role}\n{said}\n" for role, said in chat.turns_of(text))
            learned = "".join(chat.unescape(text[s["a"] : s["b"]]) for s in spans)
            digests = [hashlib.sha256(x.encode()).hexdigest() for x in (turns, learned)]
            out.append((len(chat.turns_of(text)), digests[0], len(learned), digests[1], len(text)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        values = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *values],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all formatted conversations, and of one made of control strings."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    found = chat.formatted(rows.unionByName(more))
    return found.mapInArrow(
        _digests,
        f"conv_id {found.schema['id'].dataType.simpleString()}, n_turns bigint, turns_sha256 string,"
        " loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.packed_sequences(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from two thirds of the labels."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.trained(documents, labels.filter(language.fold(F.col("doc_id"), 3) != 1))
    found = quality.scored(documents, model)
    held_out = F.coalesce(language.fold(F.col("id"), 3) == 1, F.lit(False))
    return found.select(
        F.col("id").alias("doc_id"),
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """What of every document occurs in the benchmark."""
    found = decontaminate.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op7_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Words and unigram tokens of every document."""
    return token_counts.token_counts(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op8_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without passages that smaller ids have too."""
    found = substrings.without_repeats(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    vectors = table(spark, folder, "embeddings")
    found = neighbours.nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
    return found.select(
        F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.col("distance").alias("score")
    )


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and place of every document, bytes near equal over 16 shards."""
    found = sharding.sharded(table(spark, folder, "documents"), shards=16)
    return found.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
    )


def op11_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids of every document and of the text decoded from them."""
    ids = bpe.encoded(table(spark, folder, "documents"))
    found = bpe.decoded(ids)
    return found.select(
        F.col("row.id").alias("doc_id"),
        F.size("row.ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("row.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors on the first four components of their covariance."""
    found = whitening.whitened(table(spark, folder, "embeddings"), components=4)
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    return found.select("*", each).select(
        F.col("id").alias("vec_id"),
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"),
        "identity_error",
    )


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2000 phrases of each language."""
    return collocations.collocations(table(spark, folder, "documents"))


QUERIES = {q.__name__: q for q in (
    op1_language, op2_chat, op3_packing, op4_quality, op5_decontamination,
    op6_simhash, op7_tokens, op8_substrings, op9_neighbours, op10_sharding,
    op11_bpe, op12_whitening, op13_collocations,
)}
