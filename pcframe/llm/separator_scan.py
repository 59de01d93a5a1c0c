"""Token counts: a vectorised search for end-of-document ids in flat, unindexed token files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pcframe.llm.common import attempt_name, cut, fresh_dir, open_fs, release, small_batches
from pcframe.llm.token_ids import TokenIds

#: The vocabulary's own end-of-document id; text that spells it is plain text to the writer.
END_OF_TEXT = 49_407
#: Tokens of a block, two bytes each, as the vocabulary has fewer than 65,536.
BLOCK_TOKENS = 2_000_000


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write each partition's documents to a flat file of little-endian uint16 ids, each ended
    by END_OF_TEXT; returns, for the files that were committed, file, n_tokens and the documents'
    ids in order (in lots: file, first, ids)."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        fs.create_dir(top, recursive=True)
        tokens, end = TokenIds.shared(tokenizer, True), np.asarray([END_OF_TEXT], "<u2").tobytes()
        name, out, first, at = attempt_name("tokens") + ".bin", None, 0, 0
        for b in batches:
            out = out or fs.open_output_stream(f"{top}/{name}", compression=None)
            for found in tokens.of(b.column(1)):
                ids = found.astype("<u2").tobytes() + end
                out.write(ids)
                at += len(ids) // 2
            ids = pa.ListArray.from_arrays(pa.array([0, len(b)], pa.int32()), b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([at], pa.int64()), ids], ["file", "first", "written", "ids"])
            first += len(b)
        if out:
            out.close()
        release()

    return rows.mapInArrow(run, "file string, first long, written long, ids array<long>")


def scan(spark: SparkSession, files: DataFrame, folder: str, separator: int = END_OF_TEXT, block: int = BLOCK_TOKENS) -> DataFrame:
    """file, ordinal, n_tokens (the separator not counted) of each document in flat token files.

    files: file, n_tokens. Blocks are read by range and searched as arrays; each tells how many
    separators it has, and the tokens before its first and after its last. A prefix scan over
    the blocks of a file gives each block the ordinal of its first document and the tokens that
    this document has in the blocks before. Tokens behind a file's last separator are a last,
    unended document. Files without tokens have no documents.
    """
    blocks = files.where("n_tokens > 0").select("file", "n_tokens", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(block).cast("long"))).alias("block", "start"))
    blocks = blocks.repartition(F.col("file"), F.col("block"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        for b in batches:
            for file, total, number, start in zip(*(c.to_pylist() for c in b.columns)):
                with fs.open_input_file(f"{top}/{file}") as f:
                    f.seek(2 * start)
                    ids = np.frombuffer(f.read(2 * min(block, total - start)), "<u2")
                at = np.flatnonzero(ids == separator)
                counts = np.diff(at, prepend=-1) - 1
                tail = len(ids) - 1 - int(at[-1]) if len(at) else len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([number], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([tail], pa.int64()), pa.array([start + len(ids) == total]), pa.array([counts], pa.list_(pa.int64()))], ["file", "block", "ended", "tail", "last", "counts"])

    found = cut(blocks.mapInArrow(search, "file string, block long, ended long, tail long, last boolean, counts array<long>"), "blocks")
    # the prefix scan: rows of one file only, as many as it has blocks, without their counts
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = found.select("file", "block", "ended", "tail").withColumn("first", F.coalesce(F.sum("ended").over(w), F.lit(0).cast("long")))
    # tokens carried in: all tails since the last block that had a separator, that block's included
    heads = heads.withColumn("run", F.sum(F.when(F.col("ended") > 0, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("block")))
    sums = heads.withColumn("upto", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("block")))
    sums = sums.withColumn("carry", F.coalesce(F.lag("upto").over(Window.partitionBy("file").orderBy("block")), F.lit(0).cast("long")))
    both = found.select("file", "block", "counts", "last", "tail").join(sums.select("file", "block", "first", "carry", "upto"), ["file", "block"])
    docs = both.select("file", "first", "carry", F.posexplode("counts").alias("i", "n"))
    docs = docs.select("file", (F.col("first") + F.col("i")).alias("ordinal"), (F.col("n") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))
    rest = both.where("last and upto > 0").select("file", (F.col("first") + F.size("counts")).alias("ordinal"), F.col("upto").alias("n_tokens"))
    return docs.unionByName(rest)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, file, ordinal, n_tokens: write the documents as flat token files, then count them
    from these alone; the writer's list of ids names them again.

    Null text: empty, no tokens. Null ids are kept; repeated rows are counted each; an empty
    table gives no rows; other columns are left out. A document may be longer than any block.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = fresh_dir(spark, "tokens")
    lots = cut(write_tokens(docs, tokenizer, folder, id_col, text_col), "lots")
    files = lots.groupBy("file").agg(F.max("written").alias("n_tokens"))
    names = lots.select("file", "first", F.posexplode("ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    return scan(spark, files, folder).join(names, ["file", "ordinal"], "full").select("doc_id", "file", "ordinal", "n_tokens")
