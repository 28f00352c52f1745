"""Thin queries of the operators for the driver contract, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .common import fresh_dir, table


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; the folder is a parameter of the machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Shards of the sharding query.
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign

    return assign(table(spark, sf_dir, "documents"), SHARDS).select(F.col("key").alias("doc_id"), "slot", "shard", "shard_name")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tie")


def op7_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .recompression import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("cleaned", 256).alias("kept_sha256"))


def op1_line_dedup_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1, where a repeated line of many words goes too if it stands alone."""
    from .line_dedup import LONG_WORDS, dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"), long_words=LONG_WORDS).select("doc_id", "n_lines", "n_removed", F.sha2("cleaned", 256).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import assess

    return assess(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "lost_chars"
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), count_links=False).select("doc_id", "n_shingles", "component_id")


def op3_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 with the class of each text (its first member's identifier) and the
    number of other classes that its class links with."""
    from .jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op4_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sstable import read_shards, write_shards

    shards = write_shards(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), fresh_dir(spark, "tokens"), end_id=2)
    return read_shards(spark, shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import mark_revisits, read_archives, write_archives

    places = write_archives(mark_revisits(table(spark, sf_dir, "pages")), fresh_dir(spark, "warc"))
    return read_archives(spark, places, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import held_out, score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))), fresh_dir(spark, "lm"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_line_dedup": op1_line_dedup, "op2_quality": op2_quality, "op3_jaccard_join": op3_jaccard_join, "op4_sstable": op4_sstable, "op5_sharding": op5_sharding, "op6_decontaminate": op6_decontaminate, "op7_recompression": op7_recompression, "op8_bpe": op8_bpe, "op9_warc": op9_warc, "op10_kneser_ney": op10_kneser_ney, "op1_line_dedup_long": op1_line_dedup_long, "op3_jaccard_links": op3_jaccard_links}


def oracle_sql() -> dict[str, str]:
    """SQL has no tokenizer, edit-distance search or language model: 4, 6, 8
    and 10 are tested against brute force instead."""
    return {"op1_line_dedup": sql.op1(), "op2_quality": sql.op2(), "op3_jaccard_join": sql.op3(), "op5_sharding": sql.op5(SHARDS), "op7_recompression": sql.op7(), "op9_warc": sql.op9(), "op1_line_dedup_long": sql.op1_long(), "op3_jaccard_links": sql.op3_links()}
