"""Corpus pipeline: quality rules, line dedup, near-dedup, source mixing, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents. Rows of null text or id, repeated rows and empty tables pass as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pcframe.llm import compression_bands, segment_lines, sum_of_squares, super_minhash, temperature_mixing
from pcframe.llm.common import WORD, cut, fresh_name, table
from pcframe.llm.queries import tokenizer_path

#: How often a small source may be repeated so that sources come nearer to each other.
MAX_REPEATS = 2.0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the compression bands reject go, those of null or empty
    text among them; repeated rows are judged each."""
    found = compression_bands.quality(docs, passthrough=True)
    verdict = found.columns[-1]
    return found.where(F.col(f"`{verdict}`.kept")).drop(verdict)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand before go; so do documents in which nothing but such lines had words.
    n_chars, where there is one, is that of the text that is left. Rows of null text go; those of
    null id take no part and stay."""
    out = segment_lines.dedup(docs, keep_columns=True).where(F.col("text").rlike(WORD))
    kept = [F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*kept)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (the least id) stays. Shingles have five
    words, as stages on word shingles take unless a contract says otherwise (op7's says four).
    Rows of an id go or stay together; rows of null id or without words stay."""
    found = super_minhash.near_duplicates(docs)
    name = fresh_name(docs, "__gone")
    gone = cut(found.where("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources are repeated up to MAX_REPEATS times; none is left out. Null
    sources are a source, null or empty texts count as one token."""
    return temperature_mixing.mix(docs, max_repeats=MAX_REPEATS, keep_columns=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences; a null or empty text is its end id alone."""
    return sum_of_squares.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mixing),
    ("packing", packing),
]

#: zstandard ratios, hashes and token ids can't be had in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs
