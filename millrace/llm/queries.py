"""The queries opN_<name> over the whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import ann, mixing, near_duplicates, packing, quality, repeats, secrets, token_store, topk, url_filters
from .common import scratch
from .tokens import public_vocabulary


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, public_vocabulary(), end_id=0)
    return token_store.summaries(spark, path)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, docs, labels = (table(spark, sf_dir, name) for name in ("pages", "documents", "labels"))
    return url_filters.judge(url_filters.labelled(pages, docs, labels), label="bad")


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cut_repeats(table(spark, sf_dir, "documents"))


def op7_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_vocabulary(), end_id=2)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_nearest_neighbours, op3_token_output, op4_quality_rules, op5_url_templates, op6_repeated_bytes, op7_top_products, op8_best_fit_packing, op9_jaccard_join, op10_source_mix)}
ORACLE = {"op7_top_products": topk.ORACLE, "op10_source_mix": mixing.oracle()}
