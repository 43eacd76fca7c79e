"""One query per operator over its whole table, and the SQL twins."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace
from . import chat, decontaminate, lattice, licenses, merkle, neardup, packing, pieces, pii, quality, repair, simhash, tokens, toxicity
from .oracles import ORACLES
from .rows import crc_fold, table

__all__ = ["ORACLES", "QUERIES", "tokenizer_path"]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    space = quality.learn(docs, labels.where(crc_fold("doc_id", 3) != 1))
    return _judged(quality.score(docs, space), 3, 1, 0.5)


def _judged(scored: DataFrame, folds: int, fold: int, threshold: float) -> DataFrame:
    held_out = F.coalesce(crc_fold("doc_id", folds) == fold, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = chat.conversation_digests(table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), "turn", "role", "text"))
    control = "</s>[INST] ok [/INST]"
    added = json.dumps({"messages": [{"role": "user", "content": control}, {"role": "assistant", "content": control}]})
    records = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(added).alias("record"))
    return told.unionByName(chat.digests(chat.format_records(records, "conv_id", "record"), "conv_id"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces.token_pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    # Only the checksum of the ids goes through the packing; the ids themselves are not needed for it.
    light = cut.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(light)


def op4_tokens(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("ranges") > 0).alias("contaminated"),
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neardup.near_duplicates(table(spark, sf_dir, "documents")).rows
    return rows.select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lattice.near_vectors(table(spark, sf_dir, "embeddings")).rows
    return rows.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    others = docs.where(F.coalesce(crc_fold("doc_id", 4) != 2, F.lit(True)))  # held-out texts teach nothing, not even unlabelled
    model = toxicity.learn(others, labels.where(crc_fold("doc_id", 4) != 2))
    return _judged(toxicity.score(docs, model), 4, 2, 0.3)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start_word"])
    labels = F.array_union(F.transform("places", lambda p: p["label"]), F.flatten(F.transform("expressions", lambda e: e["labels"])))

    def listed(column):
        return F.array_join(F.array_sort(F.array_distinct(column)), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(F.transform(base, lambda p: p["label"])).alias("base_labels"),
        listed(labels).alias("labels"),
        F.col("openness").alias("score"),
    )


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark)
    prints = workspace.save(simhash.edit_likeness(table(spark, sf_dir, "documents"), workspace=workspace), "prints")
    own, edited, after = ((F.col(f"{side}hi"), F.col(f"{side}lo")) for side in ("", "edited_", "next_"))
    asked = F.coalesce(F.col("id") % 50 == 0, F.lit(False))
    near = simhash.near_counts(prints, asked)
    # Queries of the search by permuted blocks are the rows whose id 50 divides; other rows have no count.
    counted = prints.where(asked).join(near, ["hi", "lo"]).unionByName(prints.where(~asked).withColumn("n_near", F.lit(None).cast("bigint")))
    return counted.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        simhash.as_text(*own).alias("fingerprint"),
        simhash.as_text(*edited).alias("edited_fingerprint"),
        simhash.likeness(own, edited).alias("near_edited"),
        simhash.likeness(own, after).alias("near_next"),
        (F.col("n_near") - 1).alias("n_near"),
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", merkle.UPPER, merkle.LOWER)
    tampers = F.coalesce(crc_fold("doc_id", 3) == 0, F.lit(False))
    tampered = merkle.leaf([*map(F.col, columns[:-1]), F.when(tampers, lowered).otherwise(F.col("text"))])
    rows = workspace.save(docs.select("doc_id", "lang", merkle.leaf([*map(F.col, columns)]).alias("leaf"), tampered.alias("tampered")), "leaves")
    manifest = merkle.build(rows, "lang", "doc_id", workspace)
    proved = merkle.prove(manifest, manifest.leaves.select("tree", "rank", "doc_id", "tampered"), workspace)
    folded = proved.withColumn("folded_root", merkle.fold(F.col("tampered"), F.col("segments")))
    return folded.select(
        "doc_id",
        F.col("found").alias("leaf"),
        "subroot",
        "root",
        merkle.proof_digest(F.col("segments")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    return repair.repair(repair.damage(told), told, Workspace(spark)).withColumnRenamed("conv", "conv_id")


QUERIES = {
    "op1_quality": op1_quality,
    "op2_chat": op2_chat,
    "op3_packing": op3_packing,
    "op4_tokens": op4_tokens,
    "op5_decontaminate": op5_decontaminate,
    "op6_pii": op6_pii,
    "op7_minhash": op7_minhash,
    "op8_embeddings": op8_embeddings,
    "op9_licenses": op9_licenses,
    "op10_toxicity": op10_toxicity,
    "op11_simhash": op11_simhash,
    "op12_merkle": op12_merkle,
    "op13_repair": op13_repair,
}
