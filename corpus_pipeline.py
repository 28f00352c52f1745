"""The corpus pipeline: STAGES applied to ``documents`` in order.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``documents``
(the last one its token ids); between stages the rows are written and read
again, so that a lost executor costs a re-read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrove.llm.bpe import encode_decode
from vecgrove.llm.common import settle, table
from vecgrove.llm.decontaminate import leaks
from vecgrove.llm.jaccard_join import near_duplicates
from vecgrove.llm.line_dedup import LONG_WORDS, dedup_lines
from vecgrove.llm.quality import assess
from vecgrove.llm.queries import tokenizer_path


def _with_text(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The carried rows with their text replaced and their characters counted."""
    new = {"text": F.col(text), "n_chars": F.char_length(text).cast("bigint")}
    return rows.select(*[new[c].alias(c) if c in new else F.col("carried")[c].alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that fail a rule. Rows
    are judged one by one, so identifiers don't matter; null and empty texts go."""
    return _with_text(assess(docs, carry=True).filter("kept"), docs.columns, "cleaned")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs and of long lines go, and documents of
    nothing else. A null identifier comes first; rows that repeat both identifier
    and text are one document and fare alike."""
    rows = dedup_lines(docs, carry=True, long_words=LONG_WORDS).filter((F.col("n_removed") == 0) | F.col("cleaned").rlike(r"[^\x20\x09-\x0D]"))
    return _with_text(rows, docs.columns, "cleaned")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group stays; of rows that
    repeat both identifier and text, one. A null identifier comes first;
    documents without words link with nothing and stay."""
    found = near_duplicates(docs, count_links=False)
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("tie") == F.col("component_tie"))).select(F.col("doc_id").alias("first_id"), F.col("tie").alias("first_tie")).distinct()
    text = F.coalesce("text", F.lit(""))
    stay = docs.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.xxhash64(text) == F.col("first_tie")), "left_semi")
    return stay.dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. A document is its identifier
    and its text: of rows that share an identifier, or have none, those with
    another text stay. An empty table of documents or passages changes nothing."""
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    held = leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leaked"), F.col("tie").alias("leaked_tie")).distinct()
    return docs.join(held, F.col("doc_id").eqNullSafe(F.col("leaked")) & (tie == F.col("leaked_tie")), "left_anti")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the characters they decode to. A row
    each: repeated rows come out repeated, a null identifier stays null, a null
    or empty text has no tokens, an empty table gives an empty one."""
    coded = encode_decode(docs, tokenizer_path("byte_bpe_50k.json"))
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.char_length("decoded").cast("bigint").alias("n_chars"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: SQL can express neither edit-distance search nor a tokenizer's merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Null and repeated identifiers go through as
    each stage says; an empty table gives an empty one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
