"""Words of whole texts by the lot: split and told apart by Arrow, so that only the distinct
words of a lot become Python objects, and nothing is remembered from one lot to the next."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text of a lot; a longer text is a lot by itself. What is held at once is a few times this.
LOT_BYTES = 8_000_000


def as_strings(column: pa.Array) -> pa.StringArray:
    """Texts with null as empty."""
    return pc.fill_null(column.cast(pa.string()), "")


def lots(texts: pa.Array, size: int = LOT_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of runs of about so many bytes, in order."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield at, as_strings(texts.slice(at, to - at))
        at = to


@dataclass
class Words:
    """Texts as words: codes into the distinct words, text after text; ends: where each text's
    words end."""

    distinct: pa.StringArray
    codes: np.ndarray
    ends: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if len(self.ends) else self.ends

    def of(self, i: int) -> np.ndarray:
        return self.codes[self.ends[i - 1] if i else 0 : self.ends[i]]


def split(texts: pa.StringArray, lower: bool = False) -> Words:
    """Words are runs of anything but the six ASCII white-space characters; lower: A-Z lower-cased."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = found.flatten().dictionary_encode()
    codes, distinct = flat.indices.to_numpy(), flat.dictionary
    ends = np.diff(found.offsets.to_numpy()).cumsum().astype(np.int64)
    empty = pc.index(distinct, "").as_py()  # white space at a text's edges splits off empty words
    if empty >= 0:
        keep = codes != empty
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        codes = codes[keep]
        codes = codes - (codes > empty)
        distinct = pa.concat_arrays([distinct.slice(0, empty), distinct.slice(empty + 1)])
    return Words(distinct, codes, ends)


def hashes(distinct: pa.StringArray) -> np.ndarray:
    """Two 64-bit lanes of each word's 128-bit hash: shape (n, 2)."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct.cast(pa.binary()).to_pylist())), dtype="<u8").reshape(-1, 2)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[starts[i] : starts[i] + lengths[i]], one after another."""
    ends = np.cumsum(lengths)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)]


def windows(words: Words, lanes: np.ndarray, k: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all windows of k words in a text, text after text, from one lane of the
    words' hashes; and how many each text has."""
    from pcframe.llm.common import window_hashes

    sizes = np.diff(words.ends, prepend=0)
    counts = np.maximum(sizes - k + 1, 0)
    every = window_hashes(lanes[words.codes], k, lane)
    return gather(every, words.starts, counts), counts
