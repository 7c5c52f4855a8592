"""From raw documents to token ids: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller writes it and hands the written table on. The
first four return the columns of the documents they got. The last adds the token ids and their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe import session
from loglathe.llm import line_dedup, linking, mixing, ngram_join, pieces, rules

# What a domain should have of the tokens that it has now.
DOMAIN_SCALE = {"clean": 1.0, "low": 1.0, "toxic": 0.0}
LEAST_RATE = 0.5  # a document is kept once if its rate rounds to one or more


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list learned from the labels."""
    return rules.filtered(docs, rules.learn_from(docs, _labels(spark, sf_dir)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document, or the same, has in equal or similar form.

    `n_chars` is counted again. A document of which no word is left goes.
    """
    changed = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    kept = line_dedup.cleaned(docs)
    return kept.withColumn("n_chars", changed) if "n_chars" in docs.columns else kept


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of every group of documents linked by similar 4-gram sets."""
    return ngram_join.one_per_group(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose fitted rate rounds to one or more; the targets leave the toxic domain without tokens."""
    labels = _labels(spark, sf_dir).select("doc_id", mixing.domain_of_labels().alias("domain"))
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    vectors = linking.stored(mixing.Domains.vectorised(rows, ["_row", "doc_id"]), "vectors")
    mixed = mixing.mixed(rows, mixing.Domains(docs, labels, vectors), scale=DOMAIN_SCALE, vectors=vectors)
    linking.discard(vectors)
    return mixed.where(F.col("rate") >= LEAST_RATE).select("_row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids (packed) and the number of them; the ids decode to the text again."""
    return pieces.coded(docs, pieces.read_model(pieces.default_path())).select(
        *[c for c in docs.columns if c not in ("ids", "n_tokens", "round_trip")],
        "ids",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(stage: Stage) -> Stage:
    """The stage with small batches, as the Python workers of all stages stay beside one another for a while."""
    return lambda spark, docs, sf_dir: stage(session.small_batches(spark), docs, sf_dir)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", _bounded(quality_rules)),
    ("line dedup", _bounded(dedup_lines)),
    ("n-gram Jaccard join", _bounded(join_near_copies)),
    ("mixing sources to target weights", _bounded(mix_domains)),
    ("SentencePiece encoding and decoding", _bounded(encode_pieces)),
]

ORACLE_SQL = None  # learned rules, edit similarity and merge rounds have no SQL form; tests hold the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = linking.stored(docs, name.replace(" ", "-"))
    return docs
