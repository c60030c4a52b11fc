"""The thin queries over the operators, as __spark_entry__ registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_digests(documents: DataFrame) -> DataFrame:
    from . import bpe, public_paths

    vocabulary = bpe.share(documents.sparkSession, public_paths.BYTE_BPE, public_paths.PATTERN)
    return bpe.round_trip(documents, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeats

    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language

    return language(_table(spark, sf_dir, "documents"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.read(warc.archive(_table(spark, sf_dir, "pages")), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find

    return find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(_table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import periodic

    return periodic.digests(periodic.periodic_runs(_table(spark, sf_dir, "documents"), periodic.planted))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation import repair

    return repair(_table(spark, sf_dir, "conversations"), broken=True)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_frequent_lines

    cleaned = drop_frequent_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def _sql() -> dict[str, str]:
    from . import license_scan, line_dedup, topk, url_filter, warc

    return {"op1_license_scan": license_scan.sql(), "op2_exact_top_k": topk.SQL, "op3_warc": warc.SQL, "op5_url_filter": url_filter.sql(), "op13_line_dedup": line_dedup.SQL}


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_exact_top_k, op3_warc, op4_decontamination, op5_url_filter, op6_toxicity, op7_byte_bpe, op8_suffix_dedup, op9_near_duplicates, op10_language_id, op11_periodic_runs, op12_conversation_repair, op13_line_dedup)}
ORACLE_SQL = _sql()
