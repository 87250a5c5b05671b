"""Queries of this subpackage for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules that the URL query applies; the longest that fits decides.
URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def op1_chroma_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.chroma import fingerprints, search, tone

    return search(fingerprints(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", sound=tone))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.url_filter import filter_urls

    out = filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "soft_distinct")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), w=3, percent=85)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.context_tree import score

    return score(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents")).selectExpr("doc_id", "n_blocks", "array_join(licenses, ',') AS licenses", "to_json(blocks) AS blocks")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.line_dedup import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.selectExpr("doc_id", "n_lines", "n_removed", "n_near", "md5(coalesce(text, '')) AS text_md5", "text")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.quality import classify, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, train(docs, _table(spark, sf_dir, "labels"))).drop("text")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.mixing import mix

    out = mix(_table(spark, sf_dir, "documents"))
    return out.selectExpr("doc_id", "source", "size", "source_size", "target", "copies", "taken", "array_join(shards, ',') AS shards")


def op9_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.syncmers import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.bpe import encode

    return encode(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chroma_search": op1_chroma_search,
    "op2_url_filter": op2_url_filter,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_license_scan": op5_license_scan,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_source_mixing": op8_source_mixing,
    "op9_syncmer_fingerprints": op9_syncmer_fingerprints,
    "op10_bpe_round_trip": op10_bpe_round_trip,
}

def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express at their full size."""
    from quillon.llm import url_filter

    return {"op2_url_filter": url_filter.oracle(URL_RULES)}
