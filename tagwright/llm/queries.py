"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagwright.llm import (
    codelength,
    conversations,
    licenses,
    mixing,
    quality,
    rules,
    sentencepieces,
    sharding,
    simhash,
    suffixes,
    urls,
    vectors,
    whitening,
)
from tagwright.sources.tables import read

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_statements: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _queries[name] = fn
        if sql is not None:
            _statements[name] = sql
        return fn

    return add


def registered() -> dict[str, Query]:
    return dict(_queries)


def statements() -> dict[str, str]:
    return dict(_statements)


@query("op1_quality_classifier")
def quality_classifier(spark, folder):
    return quality.digest(read(spark, folder, "documents"))


@query("op2_url_filters", urls.sql())
def url_filters(spark, folder):
    return urls.digest(read(spark, folder, "pages"))


@query("op3_sentencepiece")
def sentencepiece(spark, folder):
    return sentencepieces.digest(read(spark, folder, "documents"))


@query("op4_license_scans")
def license_scans(spark, folder):
    return licenses.scanned(read(spark, folder, "documents"))


@query("op5_embedding_near_dedup", vectors.SQL)
def embedding_near_dedup(spark, folder):
    return vectors.near_duplicates(read(spark, folder, "embeddings"))


@query("op6_quality_rules", rules.SQL)
def quality_rules(spark, folder):
    return rules.digest(read(spark, folder, "documents"))


@query("op7_simhash_near_dedup")
def simhash_near_dedup(spark, folder):
    return simhash.digest(read(spark, folder, "documents"))


@query("op8_suffix_array_dedup")
def suffix_array_dedup(spark, folder):
    return suffixes.dedup_digest(read(spark, folder, "documents"))


@query("op9_mixing")
def mixing_to_targets(spark, folder):
    return mixing.digest(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op10_sharding")
def sharding_by_bytes(spark, folder):
    return sharding.digest(read(spark, folder, "documents"))


@query("op11_context_tree_scores")
def context_tree_scores(spark, folder):
    return codelength.scores(read(spark, folder, "documents"))


@query("op12_prefix_trie", conversations.SQL)
def conversation_prefix_trie(spark, folder):
    return conversations.digest(read(spark, folder, "conversations"))


@query("op13_whitening")
def embedding_whitening(spark, folder):
    return whitening.whitened(read(spark, folder, "embeddings"))
