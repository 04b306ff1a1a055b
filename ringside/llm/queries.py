"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringside.llm import bpe, fim, fingerprint, html_text, jaccard, kmeans, licenses, media, minhash, mixing, quality, token_files, toxicity
from ringside.llm.common import fold, read_table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(read_table(spark, sf_dir, "documents"), words=4, threshold=(85, 100))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read_table(spark, sf_dir, "documents"))


def op4_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), folds=3, held_out=1)
    return _predicted(toxicity.scan(docs, model).drop("text", "passages"), folds=3, held_out=1)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), folds=4, held_out=2)
    return _predicted(quality.score(docs, model).drop("text"), folds=4, held_out=2)


def _predicted(scored: DataFrame, folds: int, held_out: int) -> DataFrame:
    apart = F.coalesce(fold("doc_id", folds) == held_out, F.lit(False))
    return scored.withColumn("held_out", apart).withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"), least=0).drop("text")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    files = token_files.write(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_digests(files)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(read_table(spark, sf_dir, "documents"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=4, threshold=(80, 100))


def op13_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.report(*kmeans.cluster(read_table(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_fingerprints": op3_fingerprints,
        "op4_toxic_passages": op4_toxic_passages,
        "op5_quality_rules": op5_quality_rules,
        "op6_html_text": op6_html_text,
        "op7_mix_sources": op7_mix_sources,
        "op8_license_scan": op8_license_scan,
        "op9_webp_media": op9_webp_media,
        "op10_token_files": op10_token_files,
        "op11_fim": op11_fim,
        "op12_minhash": op12_minhash,
        "op13_yinyang": op13_yinyang,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_mix_sources": mixing.SQL, "op8_license_scan": licenses.sql(), "op11_fim": fim.SQL, "op13_yinyang": kmeans.sql()}
