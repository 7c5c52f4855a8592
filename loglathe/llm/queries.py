"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe import session
from loglathe.llm import alignment, check_sql, decontamination, fingerprints, katz, line_dedup, linking, mixing, ngram_join, pieces, quotes, repair, rules, sharding, warc


SHARDS = [f"shard-{i:03d}" for i in range(64)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session.small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(_table(spark, sf_dir, "documents"))


def piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_table(spark, sf_dir, "documents"), pieces.read_model(pieces.default_path()))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learned = rules.learn_from(docs, _table(spark, sf_dir, "labels"))
    return rules.judged(docs.select("doc_id", "text"), learned).select(
        "doc_id", *rules.COUNTS, "base_failed", "kept", "rule"
    )


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "source", "n_chars", "slot", "shard")


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked(_table(spark, sf_dir, "conversations"))


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(_table(spark, sf_dir, "pages"))
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


MIX = {"clean": 0.9, "low": 0.08, "toxic": 0.02}


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", mixing.domain_of_labels().alias("domain"))
    vectors = linking.stored(mixing.Domains.vectorised(docs, ["doc_id"]), "vectors")
    domains = mixing.Domains(docs, labels, vectors)
    rows = mixing.mixed(docs, domains, weights=MIX, vectors=vectors)
    linking.discard(vectors)
    shares = [F.col("posteriors")[d].alias(f"p_{name}") for d, name in enumerate(domains.names)]
    return rows.select("doc_id", "n_tokens", *shares, "rate", "copies")


def jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(_table(spark, sf_dir, "documents"))


def fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return rows.select("doc_id", "n_lines", F.size("dropped").alias("n_dropped"), "dropped", digest.alias("kept_sha256"))


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scored(_table(spark, sf_dir, "documents"))


def aligned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = alignment.read_models(*alignment.default_paths())
    grouped = alignment.token_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"), *models)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    counted = alignment.with_link_counts(grouped.withColumn("groups_sha256", digest).drop("text", "groups"))
    return counted.select("doc_id", *alignment.COUNTS, "n_best", "count_sum", "groups_sha256")


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def repaired_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    found = repair.summaries(repair.damaged(rows)).withColumnRenamed("conv_id", "_conv")
    joined = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*repair.COUNTS, "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
    )


QUERIES = {
    "op1_fingerprints": fingerprint,
    "op2_line_dedup": fuzzy_lines,
    "op3_ngram_jaccard": jaccard_groups,
    "op5_lm_scoring": language_model,
    "op6_sharding": shards,
    "op7_mixing": mixture,
    "op8_quality_rules": quality,
    "op9_chat_quotations": chat,
    "op10_warc": archive,
    "op4_sentencepiece": piece_coding,
    "op11_alignment": aligned_tokens,
    "op12_decontamination": leaks,
    "op13_repair": repaired_chats,
}

ORACLES = {
    "op3_ngram_jaccard": check_sql.JACCARD_GROUPS,
    "op10_warc": check_sql.WARC_RECORDS,
    "op12_decontamination": check_sql.LEAKS,
}
