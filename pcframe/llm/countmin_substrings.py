"""Substring dedup: count-min prefilter over all word windows, then exact grouping of those
that the sketch estimates as repeated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pcframe.llm import words as W
from pcframe.llm.common import MASK64, fresh_dir, mix64, open_fs, release, small_batches

WINDOW = 13
#: Rows of the sketch, and counters a row for each window of the corpus, whatever its size.
#: Counters saturate at two, all that the second pass asks for.
DEPTH, LOAD = 2, 3
#: Counters of one range of a row, which one task merges: at least, at most, and ranges a row
#: that are aimed at in between (so that what a lot has for a range stays worth a row).
LEAST_RANGE, MOST_RANGE, RANGES = 1 << 22, 1 << 28, 4_096
#: Windows of a lot's sketch, flagged windows that a task groups before it sends them on, windows
#: of a bucket of the exact pass.
LOT, FLAGGED, BUCKET = 1_000_000, 500_000, 1_000_000
#: Folders that answers are filed in at most, and partitions that share one (all that a task reads).
FOLDERS, SHARED = 4_096, 4
#: Bytes of text whose windows are hashed at once.
TEXT_BYTES = 2_000_000


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays, byte planes apart, behind their lengths and widths; zstandard over all."""
    head = np.array([[len(a), a.dtype.itemsize] for a in arrays], "<i8").tobytes()
    body = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"" for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(body))


def _unpack(blob: bytes, n: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    head, at, out = np.frombuffer(raw, "<i8", 2 * n).reshape(-1, 2), 16 * n, []
    for length, width in head:
        planes = np.frombuffer(raw, np.uint8, length * width, at).reshape(width, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}"))
        at += length * width
    return out


def _gaps(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0)).astype(np.uint32)


def _cells(h: np.ndarray, row: int, width: int) -> np.ndarray:
    """The counter of each window hash in one row of any width: the upper half of the product
    of a 64-bit hash and the width."""
    x, w = mix64(h + np.uint64((row + 1) * 0x9E3779B97F4A7C15 & MASK64)), np.uint64(width)
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    if width < 1 << 32:
        return ((x & low) * w >> half) + (x >> half) * w >> half
    a = (x & low) * (w & low) >> half
    b, c = (x >> half) * (w & low), (x & low) * (w >> half)
    mid = a + (b & low) + (c & low)
    return (x >> half) * (w >> half) + (b >> half) + (c >> half) + (mid >> half)


class _Lot:
    """Texts of a partition, in order, of LOT windows or a little more: the unit of its sketches."""

    def __init__(self):
        self.n, self.docs, self.rows, self.counts, self.h0, self.h1 = 0, [], [], [], [], []

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in (self.docs, self.rows, self.counts, self.h0, self.h1))


def _lots(batches: Iterator[pa.RecordBatch], k: int, both: bool, size: int) -> Iterator[_Lot]:
    """The lots of a partition of (doc_id, text); the same in every pass over the same rows. both:
    with the second lane of the windows' hashes. Rows of null id have a number, but no windows."""
    lot, row = _Lot(), 0
    for batch in batches:
        known = np.asarray(batch.column(0).is_valid())
        docs = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for first, texts in W.lots(batch.column(1), TEXT_BYTES):
            words = W.split(texts)
            lanes = W.hashes(words.distinct)
            here = slice(first, first + len(texts))
            h0, counts = W.windows(words, lanes, k, 0)
            h1 = W.windows(words, lanes, k, 1)[0] if both else h0[:0]
            if not known[here].all():
                own = np.repeat(known[here], counts)
                h0, h1, counts = h0[own], h1[own] if both else h1, counts * known[here]
            for x, v in ((lot.docs, docs[here]), (lot.rows, row + np.arange(len(texts))), (lot.counts, counts), (lot.h0, h0), (lot.h1, h1)):
                x.append(v)
            lot.n, row = lot.n + len(h0), row + len(texts)
            if lot.n >= size:
                yield lot
                lot = _Lot()
    if lot.n:
        yield lot


def _ranges(cells: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted cells: the ranges of counters that have any, and the edges between them."""
    at = cells // np.uint64(size)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(cells) else np.empty(0, np.int64)
    return at[first].astype(np.int64), np.append(first, len(cells))


def _distinct(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of sorted cells, and how often each stands there."""
    last = np.flatnonzero(np.concatenate([cells[1:] != cells[:-1], [True]]))
    return cells[last], np.diff(last, prepend=-1)


def _partition() -> int:
    from pyspark import TaskContext

    c = TaskContext.get()
    return c.partitionId() if c else 0


def _sketches(width: int, size: int, k: int):
    """The sketch of each lot, sparse and cut into ranges of counters: those seen, and those of
    them seen twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = _partition()
        for n, lot in enumerate(_lots(batches, k, False, LOT)):
            h = np.concatenate(lot.h0)
            for row in range(DEPTH):
                cells, count = _distinct(np.sort(_cells(h, row, width)))
                found, edges = _ranges(cells, size)
                blobs = []
                for r, lo, hi in zip(found.tolist(), edges[:-1], edges[1:]):
                    local = cells[lo:hi] - np.uint64(r * size)
                    blobs.append(_pack(_gaps(local), _gaps(local[count[lo:hi] > 1])))
                m = len(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, row, np.int32)), pa.array(found), pa.array(np.full(m, pid, np.int64)), pa.array(np.full(m, n, np.int32)), pa.array(blobs, pa.binary())], ["row", "r", "pid", "lot", "blob"])
        release()

    return run


def _answers(size: int):
    """Sums the lots' sketches of one range, and answers each lot which of its counters are two or
    more: a bit for each that it has."""

    def run(group: pa.Table) -> pa.Table:
        count, compress = np.zeros(size, np.uint8), zstandard.ZstdCompressor(level=1)
        blobs = group.column("blob")
        for blob in blobs:
            seen, many = (np.cumsum(a, dtype=np.int64) for a in _unpack(blob.as_py(), 2))
            count[seen] = np.minimum(count[seen], 1) + 1
            count[many] = 2
        out = []
        for blob in blobs:
            seen = np.cumsum(_unpack(blob.as_py(), 2)[0], dtype=np.int64)
            out.append(compress.compress(np.int64(len(seen)).tobytes() + np.packbits(count[seen] > 1).tobytes()))
        return pa.table({"pid": group.column("pid"), "lot": group.column("lot"), "row": group.column("row"), "r": group.column("r"), "blob": pa.array(out, pa.binary())})

    return run


def _file(df: DataFrame, path: str) -> None:
    """Write rows of a partition (pid) so that its task finds them: SHARED partitions a folder."""
    folder = F.pmod(F.floor(F.col("pid") / SHARED), F.lit(FOLDERS)).cast("int")
    df.select(folder.alias("folder"), *df.columns).repartition("folder").sortWithinPartitions("folder", "pid").write.option("compression", "none").partitionBy("folder").parquet(path)


def _own(path: str, pid: int, shared: int, folders: int) -> Iterator[dict]:
    """The rows filed for a partition."""
    import pyarrow.fs as pafs

    fs, top = open_fs(f"{path}/folder={pid // shared % folders}")
    for info in fs.get_file_info(pafs.FileSelector(top, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                file = pq.ParquetFile(f)
                at = file.schema_arrow.get_field_index("pid")
                for g in range(file.num_row_groups):
                    s = file.metadata.row_group(g).column(at).statistics
                    if s is None or s.min <= pid <= s.max:
                        for batch in file.iter_batches(batch_size=256, row_groups=[g]):
                            yield from (x for x in batch.to_pylist() if x["pid"] == pid)


def _runs(doc: np.ndarray, row: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    """(doc, row, pos), rows together and positions rising, as runs of a row and gaps."""
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
    gaps = np.diff(pos.astype(np.int64), prepend=0)
    gaps[first] = pos[first]
    return [doc[first].astype(np.int64), row[first].astype(np.int64), np.diff(np.append(first, len(doc))).astype(np.uint32), gaps.astype(np.uint32)]


def _unruns(doc: np.ndarray, row: np.ndarray, n: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = n.astype(np.int64)
    total = np.cumsum(gaps.astype(np.int64))
    first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if len(n) else np.empty(0, np.int64)
    base = np.repeat(total[first] - gaps[first].astype(np.int64), n) if len(n) else total
    return np.repeat(doc.view(np.int64), n), np.repeat(row.view(np.int64), n), total - base


def _by_partition(doc: np.ndarray, row: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """row: the partition's number above 40 bits, the row's below."""
    order = np.lexsort((pos, row))
    doc, row, pos = doc[order], row[order], pos[order]
    at = row >> 40
    edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if len(at) else []
    for lo, hi in zip(edges[:-1], edges[1:]):
        yield int(at[lo]), _pack(*_runs(doc[lo:hi], row[lo:hi], pos[lo:hi]))


def _later(h0: np.ndarray, h1: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the same window."""
    order = np.lexsort((doc, h1, h0))
    a, b, d = h0[order], h1[order], doc[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, bool)
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(a) else d
    out = np.empty(len(a), bool)
    out[order] = d > least
    return out


def _estimated_repeats(h: np.ndarray, answers: dict[tuple[int, int], bytes], width: int, size: int) -> np.ndarray:
    """Which windows of a lot the merged sketch estimates at two or more. Without an answer for
    exactly the counters that the lot has, all of them: no window is lost."""
    hit = np.ones(len(h), bool)
    for row in range(DEPTH):
        cells = _cells(h, row, width)
        order = np.argsort(cells)
        at = cells[order]
        new = np.concatenate([[True], at[1:] != at[:-1]])
        distinct = at[new]
        found, edges = _ranges(distinct, size)
        bits = np.ones(len(distinct), bool)
        for r, lo, hi in zip(found.tolist(), edges[:-1], edges[1:]):
            raw = answers.get((row, r))
            if raw is not None and int(np.frombuffer(raw, np.int64, 1)[0]) == hi - lo:
                bits[lo:hi] = np.unpackbits(np.frombuffer(raw, np.uint8, offset=8), count=int(hi - lo)).astype(bool)
        own = np.empty(len(h), bool)
        own[order] = bits[np.cumsum(new) - 1]
        hit &= own
    return hit


def _flagged(path: str, width: int, size: int, k: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, held, n = _partition(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc, row, pos, h0, h1 = (np.concatenate(c) for c in zip(*held))
            held.clear()
            later = _later(h0, h1, doc)  # known here: of a window, only its least document in this lot is open
            g, kind, blobs = [], [], []
            for _, blob in _by_partition(doc[later], row[later], pos[later]):
                g.append(buckets + pid)
                kind.append(1)
                blobs.append(blob)
            doc, row, pos, h0, h1 = (c[~later] for c in (doc, row, pos, h0, h1))
            at = (mix64(h0 ^ np.uint64(0xB10C)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")  # documents stay in runs
            doc, row, pos, h0, h1, at = (c[order] for c in (doc, row, pos, h0, h1, at))
            edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if len(at) else []
            for lo, hi in zip(edges[:-1], edges[1:]):
                g.append(int(at[lo]))
                kind.append(0)
                blobs.append(_pack(*_runs(doc[lo:hi], row[lo:hi], pos[lo:hi]), h0[lo:hi], h1[lo:hi]))
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(kind, pa.int32()), pa.array(blobs, pa.binary())], ["g", "kind", "blob"])

        answers: dict[int, dict[tuple[int, int], bytes]] = {}
        for x in _own(path, pid, SHARED, FOLDERS):
            answers.setdefault(x["lot"], {})[x["row"], x["r"]] = x["blob"]
        for number, lot in enumerate(_lots(batches, k, True, LOT)):
            docs, rows, counts, h0, h1 = lot.arrays()
            raw = {key: zstandard.ZstdDecompressor().decompress(b) for key, b in answers.pop(number, {}).items()}
            at = np.flatnonzero(_estimated_repeats(h0, raw, width, size))
            ends = np.cumsum(counts)
            text = np.searchsorted(ends, at, "right")
            held.append((docs[text], (pid << 40) + rows[text], at - (ends - counts)[text], h0[at], h1[at]))
            n += len(at)
            if n >= FLAGGED:
                yield from flush()
                n = 0
        if n:
            yield from flush()
        release()

    return run


def _exact(group: pa.Table) -> pa.Table:
    """A bucket's windows, grouped by 128 bits of their word sequence; what is known passes through."""
    if group.column("kind")[0].as_py() == 1:
        pids = [int(_unpack(b.as_py(), 4)[1].view(np.int64)[0]) >> 40 for b in group.column("blob")]
        return pa.table({"pid": pa.array(pids, pa.int64()), "blob": group.column("blob").combine_chunks()})
    parts = []
    for blob in group.column("blob"):
        *runs, h0, h1 = _unpack(blob.as_py(), 6)
        parts.append((*_unruns(*runs), h0, h1))
    doc, row, pos, h0, h1 = (np.concatenate(c) for c in zip(*parts))
    later = _later(h0, h1, doc)
    found = list(_by_partition(doc[later], row[later], pos[later]))
    return pa.table({"pid": pa.array([p for p, _ in found], pa.int64()), "blob": pa.array([b for _, b in found], pa.binary())})


def _remove(path: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, row, found = _partition(), 0, {}
        for x in _own(path, pid, SHARED, FOLDERS):
            doc, at, n, gaps = _unpack(x["blob"], 4)
            pos, ends = _unruns(doc, at, n, gaps)[2], np.cumsum(n.astype(np.int64))
            for d, r, end, m in zip(doc.view(np.int64).tolist(), at.view(np.int64).tolist(), ends.tolist(), n.tolist()):
                found.setdefault((d, r & (1 << 40) - 1), []).append(pos[end - m : end])
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in W.lots(batch.column(1), TEXT_BYTES):
                total, gone, kept = [], [], []
                for i, text in enumerate(texts.to_pylist()):
                    words = text.encode().split()
                    starts = found.pop((ids[first + i], row), None)
                    row += 1
                    total.append(len(words))
                    if starts is None:
                        gone.append(0)
                        kept.append(b" ".join(words))
                        continue
                    edge = np.zeros(len(words) + 1, np.int64)
                    starts = np.unique(np.concatenate(starts))
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + k, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    gone.append(int(len(words) - stay.sum()))
                    kept.append(b" ".join([words[j] for j in np.flatnonzero(stay)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])
        if found:
            raise ValueError("the documents' partitions are not those of the passes before: give dedup() a table")

    return run


def dedup(docs: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the kept words, joined by one space).

    A word goes if a window of k consecutive words that covers it also starts, as the same word
    sequence, in a document with a smaller id; windows are judged on the input. Texts stay where
    they are read; the passes meet in the shared folder, by the number of the partition:

    1. Each lot of a partition's windows makes a count-min sketch, sparse and cut into ranges of
    counters. 2. A range is summed over all lots, and each lot is answered, a bit a counter, which
    of its counters are two or more. So the sketch has LOAD counters a window at any size, and no
    task holds more of it than a range. 3. Windows whose estimate is two or more, which no repeated
    window can escape, are grouped exactly in buckets; of a window, a lot sends on only its least
    document, so a passage that everyone shares stays small. Word sequences are told apart by 128
    bits: among 10**13 windows any two are mixed up with probability 10**-12. 4. The words go.

    docs must have the same partitions whenever it is read, as a table or a cached DataFrame does.
    If they change between passes, 3 takes all windows of a lot without an answer, and 4 raises
    ValueError over removals that find no document.

    Null text: no words. A null id takes no part: its words are kept. Repeated rows of an id
    don't remove from one another. An empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = int(d.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    windows = max(1, size // 6)
    width = max(1 << 16, LOAD * windows)
    span = min(MOST_RANGE, max(LEAST_RANGE, -(-width // RANGES)))
    buckets = -(-windows // BUCKET)

    sketches = d.mapInArrow(_sketches(width, span, k), "row int, r long, pid long, lot int, blob binary")
    answers = fresh_dir(spark, "answers")
    _file(sketches.groupBy("row", "r").applyInArrow(_answers(span), "pid long, lot int, row int, r long, blob binary"), answers)

    flagged = d.mapInArrow(_flagged(answers, width, span, k, buckets), "g long, kind int, blob binary")
    removals = fresh_dir(spark, "removals")
    _file(flagged.groupBy("g").applyInArrow(_exact, "pid long, blob binary"), removals)
    return d.mapInArrow(_remove(removals, k), "doc_id long, n_words long, n_removed long, kept_text string")
