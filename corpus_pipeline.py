"""A corpus pipeline in five stages, each of which calls one operator of kgloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import materialize, read_table
from kgloom.llm.language import UNKNOWN, fit_languages, identify_languages
from kgloom.llm.mixing import emit_copies, mix_sources
from kgloom.llm.near_dup import keep_one_of_each
from kgloom.llm.packing import pack_documents
from kgloom.llm.pii import pseudonymize
from kgloom.llm.queries import demo_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; one without a text or a letter is rejected.  ``lang`` becomes the language found.

    A clean document in any learned language stays; where no row has a lang to learn from, none is rejected
    but for that, and ``lang`` stays.
    """
    model = fit_languages(docs)
    if model is None:
        return _columns(docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))))
    found = identify_languages(_columns(docs), model).where(F.col("lang_pred") != UNKNOWN)
    return _columns(found.withColumn("lang", F.col("lang_pred")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies, that with the least id."""
    return _columns(keep_one_of_each(_columns(docs)))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for personal data; ``n_chars`` follows the new text."""
    return _columns(pseudonymize(_columns(docs), key=demo_key(spark)).withColumn("n_chars", F.length("text").cast("long")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or repeated."""
    return _columns(emit_copies(mix_sources(_columns(docs))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: SQL expresses neither language identification nor near-duplicate groups; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
