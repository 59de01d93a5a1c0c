"""Quality rules: zstandard compression bands over whole documents and fixed chunks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pcframe.llm.common import as_bytes, fresh_name, small_batches

_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_CONTINUATION = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Bands:
    """Limits on raw/compressed size, by length.

    whole: (least bytes, lowest ratio, highest ratio), the last row whose length a text
    reaches holds. Short texts compress less, long ones more; below 200 bytes the frame's own
    bytes decide (ratios of sound texts go from 0.5 to 1.5), so no ratio tells anything there and
    the base rules judge alone. chunk: the same limits for
    every full chunk of chunk_bytes (a shorter tail counts with the whole text only); a
    text fails if more than max_bad_chunks of its chunks, as a share, lie outside.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 1e9), (200, 1.0, 2.6), (500, 1.2, 2.6), (1_000, 1.4, 2.8), (4_000, 1.6, 3.0), (16_000, 1.7, 3.3), (64_000, 1.7, 4.0),
    )
    chunk_bytes: int = 4_096
    chunk: tuple[float, float] = (1.4, 3.0)
    max_bad_chunks: float = 0.3
    level: int = 3
    min_words: int = 10
    max_repeat_share: tuple[int, int] = (20, 100)
    window: int = field(default=5)


def _base(text: bytes, window: int) -> tuple[int, int, int, int, int]:
    words = text.split()
    joined = b"".join(words)
    chars = len(joined.translate(None, _CONTINUATION))
    symbols = len(_SYMBOLS.findall(joined))
    lines = Counter(line for line in text.split(b"\n") if line and not line.isspace())
    dup_lines = sum(lines.values()) - len(lines)
    repeated = 0
    if len(words) > window:
        grams = list(zip(*(words[i:] for i in range(window))))
        if len(set(grams)) < len(grams):
            counts, end = Counter(grams), 0
            for i, g in enumerate(grams):
                if counts[g] > 1:
                    repeated += i + window - max(i, end)
                    end = i + window
    return len(words), chars, symbols, dup_lines, repeated


def _verdict(text: bytes, bands: Bands, z: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of its full chunks outside their band, and whether it passes."""
    n = len(text)
    if not n:
        return 0.0, 0.0, True
    ratio = n / len(z.compress(text))
    low, high = next((lo, hi) for least, lo, hi in reversed(bands.whole) if n >= least)
    bad = full = 0
    for at in range(0, n - bands.chunk_bytes + 1, bands.chunk_bytes):
        r = bands.chunk_bytes / len(z.compress(text[at : at + bands.chunk_bytes]))
        full += 1
        bad += not bands.chunk[0] <= r <= bands.chunk[1]
    share = bad / full if full else 0.0
    return ratio, share, low <= ratio <= high and share <= bands.max_bad_chunks


_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, bad_chunk_share double"


def quality(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text", passthrough: bool = False) -> DataFrame:
    """One row per input row: id, base counts, base_failed, kept, and the two ratios; with
    passthrough all columns of docs, and these results as a struct that the last column is
    (__quality, or a longer name where docs has that).

    Nulls: a null text is an empty one (no words: base_failed); a null id is returned as it is.
    Repeated rows each get a row; an empty table gives an empty one. Other columns are left
    out, but for passthrough. No shuffle: one pass over the texts, whole, a batch at a time.
    """
    small_batches(docs.sparkSession)
    names = [c.split(" ")[0] for c in _SCHEMA.split(", ")]
    rows = docs if passthrough else docs.select(F.col(id_col), F.col(text_col))
    place = rows.columns.index(text_col)
    carried = list(range(len(rows.columns))) if passthrough else [0]
    out = T.StructType([rows.schema[i] for i in carried])
    results = T.StructType.fromDDL(_SCHEMA)
    out = out.add(fresh_name(docs, "__quality"), results) if passthrough else T.StructType(out.fields + results.fields)
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=bands.level)
        share, of = bands.max_repeat_share
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for text in as_bytes(batch.column(place)):
                n, chars, symbols, dup, rep = _base(text, bands.window)
                ratio, bad, ok = _verdict(text, bands, z)
                failed = n < bands.min_words or of * rep > share * n
                for c, v in zip(cols, (n, chars, symbols, dup, rep, failed, ok and not failed, ratio, bad)):
                    c.append(v)
            found = [pa.array(c, k) for c, k in zip(cols, kinds)]
            found = [pa.StructArray.from_arrays(found, names)] if passthrough else found
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in carried), *found], out.names)

    return rows.mapInArrow(run, out)
