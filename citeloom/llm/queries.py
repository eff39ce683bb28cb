"""The operators' queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, table
from . import ann, decontaminate, html, interactions, langid, licenses, mixing, quality, repeats, search, sharding, simhash, toxicity
from .labelled import fold


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, fold("doc_id", 5) != 0)
    out = toxicity.score(docs.select("doc_id", "text"), model, threshold=0.5)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, distance=2)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0, keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, fold("doc_id", 4) != 2, threshold=0.7)
    out = quality.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark texts: (doc_id, item_id, n_tokens, n_changed)."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, fold("doc_id", 3) != 1)
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the compacted store: (doc_id, n_bytes, shard, shard_row)."""
    rows = sharding.shard(table(spark, sf_dir, "documents"), Scratch(spark, "shards").root, keep=1)  # a store of its own
    return rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "shard", "shard_row")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.interactions(interactions.failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("found")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_simhash, op3_mixing, op4_quality, op5_repeats, op6_ann, op7_decontamination, op8_html, op9_langid, op10_sharding, op11_search, op12_filters, op13_licenses)
}
ORACLE_SQL: dict[str, str] = {"op3_mixing": mixing.SQL, "op11_search": search.SQL, "op12_filters": interactions.SQL}
