"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.ann import nearest_neighbours
from kgloom.llm.common import held_out, read_table, scratch_path
from kgloom.llm.divergence import DIVERGENCE_SQL, source_divergence
from kgloom.llm.language import fit_languages, identify_languages
from kgloom.llm.mixing import MIX_SQL, mix_sizes
from kgloom.llm.near_dup import near_duplicates
from kgloom.llm.packing import pack_documents
from kgloom.llm.pii import KEY_SETTING, pseudonymize
from kgloom.llm.quality import MEASURES, QUALITY_SQL, quality_rules
from kgloom.llm.topk import TOPK_SQL, top_k_search
from kgloom.llm.toxicity import fit_toxicity, score_toxicity
from kgloom.llm.url_filter import URL_SQL, filter_urls
from kgloom.llm.warc import WARC_SQL, read_warc, verified, write_warc
from kgloom.llm.whitening import whiten


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_search(read_table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify_languages(docs.select("doc_id", "text"), fit_languages(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.array_join("languages", ",").alias("languages"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"))


def demo_key(spark: SparkSession) -> str:
    """The session's key, or one for invented data, which hides nothing."""
    return spark.conf.get(KEY_SETTING, None) or "invented data need no secret"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(read_table(spark, sf_dir, "documents").select("doc_id", "text"), key=demo_key(spark))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    manifest = write_warc(read_table(spark, sf_dir, "pages"), path)
    records = read_warc(spark, path, manifest=manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "path")
    return verified(records, manifest).drop("path")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *MEASURES, "base_failed", "kept")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_dup, op2_exact_top_k, op3_url_filter, op4_mix_sources, op5_toxicity, op6_language_id, op7_ann, op8_pii, op9_warc, op10_packing,
        op11_quality_rules, op12_whitening, op13_source_divergence,
    )
}
#: The others are tested in tests/llm against brute force, held-out accuracy or an exact round trip.
ORACLES = {"op2_exact_top_k": TOPK_SQL, "op3_url_filter": URL_SQL, "op4_mix_sources": MIX_SQL, "op9_warc": WARC_SQL, "op11_quality_rules": QUALITY_SQL, "op13_source_divergence": DIVERGENCE_SQL}
