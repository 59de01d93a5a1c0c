"""Token ids of whole texts under a word-end BPE vocabulary, by the lot."""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pcframe.llm import words as W

#: Code points below this have one fixed class, lower-case form and composition in every version
#: of Unicode; words with any other go through the whole tokenizer.
TOP = 0x250
_LETTER, _DIGIT, _OTHER, _SLOW = range(4)
#: Pieces that are joined to one input of the vocabulary's model.
_JOIN = 4_000
#: Words that are cut at once, which takes many times their text.
_WORDS = 16_000


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: its class to the vocabulary's pattern, and the one or two letters of
    the byte alphabet that its lower-case form has (0: none)."""
    alphabet, more = {}, 256
    for b in range(256):  # bytes that print stand for themselves, the others for what follows
        prints = 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
        alphabet[b] = b if prints else more
        more += not prints
    kind, one, two = np.full(TOP + 1, _SLOW, np.uint8), np.zeros(TOP + 1, "<u4"), np.zeros(TOP + 1, "<u4")
    for c in range(TOP):
        group, low = unicodedata.category(chr(c))[0], chr(c).lower()
        if group in "CZ" or len(low) > 1 or chr(c) == "'":  # apostrophes begin contractions
            continue
        kind[c] = {"L": _LETTER, "N": _DIGIT}.get(group, _OTHER)
        coded = [alphabet[b] for b in low.encode()]
        one[c], two[c] = coded[0], coded[1] if len(coded) > 1 else 0
    return kind, one, two


class TokenIds:
    """Ids of texts: those of their words in turn, as the vocabulary's pattern never joins
    characters across white space. Of a lot, only distinct words are looked at; they are cut
    where the pattern cuts them (letters, single digits, other characters), and the distinct
    pieces go through the vocabulary's model. A piece ends with the first id that ends a word.
    Words with an apostrophe, a special token or a character beyond TOP go through the tokenizer
    one by one. Nothing is kept from lot to lot, so memory depends on a lot alone.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor are its threads
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = plain_specials
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._model = Tokenizer(self._tokenizer.model)
        self._model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        suffix = parts["model"].get("end_of_word_suffix")
        if not suffix or parts["normalizer"] is None or len(parts["model"]["vocab"]) >= 1 << 16:
            raise ValueError("the vocabulary must mark word ends, lower-case, and fit 16 bits")
        self._ends = np.zeros(1 << 16, bool)
        self._ends[[i for token, i in parts["model"]["vocab"].items() if token.endswith(suffix)]] = True
        self._kind, self._one, self._two = _tables()

    @staticmethod
    @functools.lru_cache(maxsize=2)
    def shared(path: str, plain_specials: bool = False) -> TokenIds:
        """One for a worker process: a vocabulary, and no texts' words."""
        return TokenIds(path, plain_specials)

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. An encoding holds much more a token than its id, so none
        outlives the call."""
        return [np.asarray(e.ids, np.uint16) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces: all ids, and where each piece's begin and how many they are."""
        joined = (" ".join(pieces.slice(i, _JOIN).to_pylist()) for i in range(0, len(pieces), _JOIN))
        got = [x for j in joined for x in self._ids(self._model, [j])]
        flat = np.concatenate(got) if got else np.empty(0, np.uint16)
        ends = np.flatnonzero(self._ends[flat]) + 1
        if len(ends) != len(pieces):
            raise ValueError("the vocabulary's model does not end each piece with a word end")
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        return flat, starts, ends - starts

    def _cut(self, some: pa.StringArray) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
        """Of words: which are left to the tokenizer, the pieces of the others, and how many each has."""
        lengths = pc.utf8_length(some).to_numpy().astype(np.int64)
        points = np.frombuffer("".join(some.to_pylist()).encode("utf-32-le"), "<u4")
        kind = self._kind[np.minimum(points, TOP)]
        kind[:-1][(points[:-1] == ord("<")) & (points[1:] == ord("|"))] = _SLOW
        first = np.cumsum(lengths) - lengths
        slow = np.maximum.reduceat(kind, first) == _SLOW
        if slow.all():
            return slow, pa.array([], pa.string()), np.empty(0, np.int64)
        keep = ~np.repeat(slow, lengths)
        p, k, begins = points[keep], kind[keep], np.zeros(len(points), bool)
        begins[first] = True
        word = begins[keep]
        cut = word | (k == _DIGIT)
        cut[1:] |= k[1:] != k[:-1]
        spelt = np.column_stack([np.where(cut, 32, 0).astype("<u4"), self._one[p], self._two[p]]).reshape(-1)
        text = spelt[spelt != 0][1:].tobytes().decode("utf-32-le")
        pieces = pc.split_pattern(pa.array([text], pa.large_string()), " ").flatten().cast(pa.string())
        return slow, pieces, np.diff(np.flatnonzero(word[cut]), append=len(pieces))

    def of_words(self, distinct: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and where each word's begin and how many they are."""
        n = len(distinct)
        starts, sizes = np.zeros(n, np.int64), np.zeros(n, np.int64)
        parts: list[np.ndarray] = [np.empty(0, np.uint16)]
        if not n:
            return parts[0], starts, sizes
        slow, pieces, counts = zip(*(self._cut(distinct.slice(i, _WORDS)) for i in range(0, n, _WORDS)))
        slow, counts, total = np.concatenate(slow), np.concatenate(counts), 0

        if len(counts):
            found = pa.concat_arrays(pieces).dictionary_encode()
            ids, at, size = self._pieces(found.dictionary)
            codes = found.indices.to_numpy()
            parts += [W.gather(ids, at[c], size[c]) for c in (codes[i : i + _WORDS] for i in range(0, len(codes), _WORDS))]
            own = np.add.reduceat(size[codes], np.cumsum(counts) - counts)
            sizes[~slow] = own
            starts[~slow] = np.cumsum(own) - own
            total = int(own.sum())
        if slow.any():
            odd = distinct.filter(pa.array(slow))
            some = [x for i in range(0, len(odd), _JOIN) for x in self._ids(self._tokenizer, odd.slice(i, _JOIN).to_pylist())]
            own = np.array([len(x) for x in some], np.int64)
            sizes[slow] = own
            starts[slow] = total + np.cumsum(own) - own
            parts += some
        return np.concatenate(parts), starts, sizes

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids (16 bits each) of each text in turn; null: none."""
        for _, lot in W.lots(texts):
            words = W.split(lot)
            flat, starts, sizes = self.of_words(words.distinct)
            for i in range(len(lot)):
                codes = words.of(i)
                yield W.gather(flat, starts[codes], sizes[codes])
