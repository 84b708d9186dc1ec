"""Every corpus operator as a named query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.llm import (
    bytepair,
    decontamination,
    html,
    manifest,
    neardup,
    packing,
    periodic,
    pii,
    quality,
    secrets,
    sharding,
    substring,
    warc,
)
from forecourt.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER, BYTE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json"

#: Packing alone has room for more words than beside the pipeline's other stages.
KEPT_WORDS = 300_000

SHARDS = [f"shard-{k:03d}" for k in range(64)]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path(), kept=KEPT_WORDS)


def op2_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.with_revisits(table(spark, folder, "pages"))
    found = warc.read_archive(spark, warc.write_archive(records))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    judged, stats, failed, kept = quality.judge(docs, table(spark, folder, "labels"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "doc_id",
        *[F.col(stats)[c].alias(c) for c in names],
        F.col(failed).alias("base_failed"),
        F.col(kept).alias("kept"),
    )


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.scan(table(spark, folder, "documents"))


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return sharding.place(docs, "doc_id", SHARDS).select("doc_id", "source", "slot", "shard")


def op7_neardup(spark: SparkSession, folder: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, folder, "documents"), size=2, similarity=0.8)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("row")


def op9_substring(spark: SparkSession, folder: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, folder, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


def op11_bytepair(spark: SparkSession, folder: str) -> DataFrame:
    found = bytepair.encode_decode(table(spark, folder, "documents"), tokenizer_path(BYTE_TOKENIZER))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.manifest(table(spark, folder, "documents"), tamper=True)


def op13_periodic(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, folder, "documents"), plant=True)


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_html": op2_html,
    "op3_warc": op3_warc,
    "op4_quality": op4_quality,
    "op5_pii": op5_pii,
    "op6_sharding": op6_sharding,
    "op7_neardup": op7_neardup,
    "op8_decontamination": op8_decontamination,
    "op9_substring": op9_substring,
    "op10_secrets": op10_secrets,
    "op11_bytepair": op11_bytepair,
    "op12_manifest": op12_manifest,
    "op13_periodic": op13_periodic,
}
