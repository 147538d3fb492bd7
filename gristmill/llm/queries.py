"""The operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import (
    decontaminate,
    filter_audit,
    html_extract,
    imatch,
    language_id,
    license_scan,
    line_dedup,
    mixing,
    sharding,
    simhash,
    substring_dedup,
    url_reputation,
    vector_codes,
)
from gristmill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@query
def op1_substring_dedup(spark, folder):
    return substring_dedup.find_repeats(table(spark, folder, "documents"))


@query
def op2_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    return language_id.identify(docs, language_id.train(docs))


@query
def op3_url_reputation(spark, folder):
    pages = table(spark, folder, "pages")
    outcomes = url_reputation.labelled_outcomes(pages, table(spark, folder, "labels"))
    return url_reputation.judge_urls(pages, outcomes).withColumn("bad_bound", F.round("bad_bound", 6))


@query
def op4_imatch(spark, folder):
    found = imatch.fingerprint_pairs(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        imatch.fingerprint_text(F.col("marks")).alias("fingerprint"),
        imatch.fingerprint_text(F.col("edited_marks")).alias("edited_fingerprint"),
        F.round("near_edited", 6).alias("near_edited"),
        F.round("near_next", 6).alias("near_next"),
    )


@query
def op5_decontaminate(spark, folder):
    return decontaminate.find_contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


@query
def op6_mixing(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        F.round("target", 6).alias("target"),
        (F.col("size") * F.col("copies")).alias("taken"),
    )


@query
def op7_simhash(spark, folder):
    groups = simhash.near_groups(table(spark, folder, "documents"))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups.select("doc_id", shown.alias("fingerprint"), "component_id")


@query
def op8_license_scan(spark, folder):
    return license_scan.scan(table(spark, folder, "documents"))


@query
def op9_html_extract(spark, folder):
    return html_extract.extract(table(spark, folder, "pages"))


@query
def op10_sharding(spark, folder):
    return sharding.shard_rows(table(spark, folder, "documents"))


@query
def op11_line_dedup(spark, folder):
    return line_dedup.line_report(line_dedup.dedup_lines(table(spark, folder, "documents")))


@query
def op12_filter_audit(spark, folder):
    failed = filter_audit.failures(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return filter_audit.audit(failed)


@query
def op13_vector_codes(spark, folder):
    codec = vector_codes.compress(table(spark, folder, "embeddings"))
    return vector_codes.with_label_error(codec.codes).select(
        "vec_id", "code", "error", "label_error", F.lit(codec.digest()).alias("codebooks_sha256")
    )


QUERIES["pipeline"] = corpus_pipeline.run
