"""Packing: sum-of-squares online packing of tokenised documents into windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pcframe.llm.common import release, small_batches
from pcframe.llm.token_ids import TokenIds

WINDOW = 2048
#: Added after each document's ids.
END_ID = 1


class Packer:
    """Sum-of-squares packing, online.

    levels[h] counts the open windows filled to h; an item of s tokens goes to the level h
    (0: a new window) that leaves the smallest sum of squares of the counts at 0 < h < window.
    Moving a window from h to h+s changes the sum by 2*(levels[h+s] - levels[h]) + 2, with
    what touches 0 or the full window left out; all levels are compared at once. Whole windows
    of a longer document are cut off first. What is still open at the end is cut to fill
    windows in turn, so that at most the last one needs padding. Some windows are always open,
    about as many however much is packed, so the share that ends this way (left_over counts its
    tokens) falls with the size of what one packer gets: give it partitions of 100 MB or more.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.next_id = self.left_over = 0

    def _best(self, size: int) -> int:
        w, n = self.window, self.levels
        h = np.arange(0, w - size + 1)
        gain = 2 * n[h + size] + 1
        gain[-1] = 0  # it fills a window up, which then no longer counts
        gain[1:] += 1 - 2 * n[1 : w - size + 1]
        gain[1:][n[1 : w - size + 1] == 0] = np.iinfo(np.int64).max
        least = int(gain.min())
        return int(np.flatnonzero(gain == least)[-1])  # a tie goes to the fullest window

    def _emit(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            yield doc, start, n, zlib.crc32(ids), total, self.next_id, at, ids
            at += n
        self.next_id += 1

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        """(doc, start, length, crc32, doc_tokens, sequence, offset, ids) of windows now full."""
        total, start = len(ids) // 4, 0
        while total - start >= self.window:
            yield from self._emit([(doc, start, ids[4 * start : 4 * (start + self.window)], total)])
            start += self.window
        if start == total:
            return
        size = total - start
        h = self._best(size)
        pieces = self.open[h].pop() if h else []
        if h:
            self.levels[h] -= 1
        pieces.append((doc, start, ids[4 * start :], total))
        if h + size == self.window:
            yield from self._emit(pieces)
        else:
            self.levels[h + size] += 1
            self.open.setdefault(h + size, []).append(pieces)

    def close(self) -> Iterator[tuple]:
        room, pieces = self.window, []
        self.left_over = sum(h * len(bins) for h, bins in self.open.items())
        for h in sorted(self.open, reverse=True):
            for doc, start, ids, total in (p for bin_ in self.open[h] for p in bin_):
                while ids:
                    part, ids = ids[: 4 * room], ids[4 * room :]
                    pieces.append((doc, start, part, total))
                    start += len(part) // 4
                    room -= len(part) // 4
                    if not room:
                        yield from self._emit(pieces)
                        room, pieces = self.window, []
        if pieces:
            yield from self._emit(pieces)
        self.levels[:], self.open = 0, {}


_SCHEMA = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    Each input partition packs its documents in turn, with no shuffle: the partition's number
    is in the upper bits of sequence_id, and at most one sequence of a partition is padded.
    Give it a table's scan, whose partitions a retried task reads in the same order.

    A null text is empty: its document is the end id alone. A null id is returned as it is;
    repeated rows are packed each. An empty table gives no rows; other columns are left out.
    A document longer than the window is cut at multiples of it, whatever its length.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col))
    ids_of = rows.schema[0]
    ddl = f"`{ids_of.name}` {ids_of.dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        tokens, packer, end = TokenIds.shared(tokenizer), Packer(window), np.asarray([END_ID], "<u4").tobytes()
        id_type = None

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            doc, start, n, crc, total, seq, at, ids = zip(*found)
            cols = [pa.array(doc, id_type), *(pa.array(c, pa.int64()) for c in (start, n, crc, total, [first + s for s in seq], at))]
            return pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, [ids_of.name, *_SCHEMA.names, *["ids"] * with_ids])

        found: list[tuple] = []
        for batch in batches:
            id_type = batch.column(0).type
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.of(batch.column(1))):
                for piece in packer.add(doc, ids.astype("<u4").tobytes() + end):
                    found.append(piece if with_ids else (*piece[:7], None))
                if len(found) >= 4096:
                    yield batch_of(found)
                    found = []
        found += [p if with_ids else (*p[:7], None) for p in packer.close()]
        if found:
            yield batch_of(found)
        release()

    return rows.mapInArrow(run, ddl)
