"""The corpus queries of the driver's contract: thin, each gets its rows through its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]).drop("items", "hit_words", "hit_spans")


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import weak_quality

    judged = weak_quality(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", "p_good")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


#: The contract's rules.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(table(spark, sf_dir, "pages"), RULES, keep=["page_id"])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import joined, number, scan

    got = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary=tokenizer_file())
    base = F.filter("secrets", lambda s: s["rank"] < 3)
    count = [number(F.col("secrets"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return got.select("doc_id", *count, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    got = mix(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op8_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    got = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(table(spark, sf_dir, "documents"))


def tokenizer_file() -> str:
    """Of the tokenizer of op10 and the pipeline: an installed package, so equal on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


VOCABULARY = 49408


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_output

    return token_output(table(spark, sf_dir, "documents"), tokenizer_file(), vocabulary=VOCABULARY)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import centroid_clusters

    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_phrases": op11_phrases, "op12_centroids": op12_centroids, "op13_near_vectors": op13_near_vectors, "op6_substrings": op6_substrings, "op1_near_duplicates": op1_near_duplicates, "op2_urls": op2_urls, "op7_secrets": op7_secrets, "op3_mix": op3_mix, "op8_shuffle": op8_shuffle, "op10_tokens": op10_tokens, "op4_language": op4_language, "op5_weak_quality": op5_weak_quality, "op9_decontaminate": op9_decontaminate}
