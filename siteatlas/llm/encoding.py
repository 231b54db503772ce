"""Bulk encoding with a public tokenizer inside a task.

``word_bpe_49k`` lower-cases, breaks at white space and never joins what a space or a line feed separates, so the ids of
a text are the ids of its pieces between those two characters, one after another.  Pieces repeat a lot: each distinct
piece of a batch is looked up once, and what was encoded is kept in a table of bounded size.

A piece is Latin if all its characters are below U+0100 and it spells no added token.  There the tokenizer's normal form
is lower case alone, and its words are the matches of ``WORD``: pieces are lower-cased and parted from closing marks as
Arrow columns, and many at a time are encoded as one text, told apart by the number of words in each.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LATIN = r"^[\x00-\x{ff}]*$"
MARKED = r"^(?P<head>\p{L}+)(?P<tail>[!-/:-@\[-`{-~]+)$"
# The tokenizer's own pattern, for pieces without white space and control characters.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+"
BLANK = r"[\x00-\x20\x7f-\xa0]"


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1, one range after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class BulkEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, table_limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers import pre_tokenizers as pre

        self.tokenizer = Tokenizer.from_file(path)
        # For lower-case Latin words: the same model, without what makes no difference to them.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre.Sequence([pre.WhitespaceSplit(), pre.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.limit = table_limit
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        # Added tokens are matched as written, before lower case: a piece that spells one in any case is left alone.
        self.added = [token.content.lower() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {"": 0}
        self.starts = np.zeros(1 << 16, dtype=np.int64)
        self.sizes = np.zeros(1 << 16, dtype=np.int64)
        self.flat = np.zeros(1 << 18, dtype=np.uint32)
        self.used = 0

    def _add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, n, end = len(self.slots), len(pieces), self.used + len(ids)
        while first + n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.sizes))
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:end] = ids
        self.sizes[first:first + n] = sizes
        self.starts[first:first + n] = self.used + np.cumsum(sizes) - sizes
        self.used = end
        self.slots.update(zip(pieces, range(first, first + n), strict=True))

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _join(self, tokenizer, pieces: list[str], words: np.ndarray, at_once: int) -> list[str]:
        """Encode many pieces as one text, told apart by the ids that close a word; those that this fails for come back."""
        failed = []
        for i in range(0, len(pieces), at_once):
            some = pieces[i:i + at_once]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends, last = np.flatnonzero(self.closes[ids]) + 1, np.cumsum(words[i:i + len(some)])
            if len(ends) == last[-1] and ends[-1] == len(ids):
                self._add(some, ids, np.diff(ends[last - 1], prepend=0))
            else:
                failed.extend(some)
        return failed

    def _learn(self, pieces: pa.Array, latin: np.ndarray) -> None:
        """Encode new pieces; ``latin`` ones are in lower case."""
        names = pieces.to_numpy(zero_copy_only=False)
        letters = np.fromiter(map(str.isalpha, names), dtype=bool, count=len(names))
        words = pc.count_substring_regex(pieces, WORD).to_numpy()
        counted = latin & ~letters & (words > 0) & ~pc.match_substring_regex(pieces, BLANK).to_numpy(zero_copy_only=False)
        other = names[~(letters | counted)].tolist()
        ones = np.ones(len(names), dtype=np.int64)
        other += self._join(self.words, names[letters & latin].tolist(), ones, 4096)
        other += self._join(self.tokenizer, names[letters & ~latin].tolist(), ones, 512)
        other += self._join(self.tokenizer, names[counted].tolist(), words[counted], 512)
        for i in range(0, len(other), 512):
            some = other[i:i + 512]
            each = self._encode(some)
            self._add(some, np.array([x for e in each for x in e], dtype=np.uint32), np.array([len(e) for e in each], dtype=np.int64))

    def _slots(self, pieces: pa.Array, latin: pa.Array) -> np.ndarray:
        """Places of pieces in the table, which learns those that it does not hold."""
        coded = pieces.dictionary_encode()
        index = coded.indices.to_numpy()
        names = coded.dictionary.to_numpy(zero_copy_only=False)
        found = np.fromiter(map(self.slots.get, names, repeat(-1)), dtype=np.int64, count=len(names))
        new = np.flatnonzero(found < 0)
        if len(new):
            marks = np.zeros(len(names), dtype=bool)
            marks[index] = latin.to_numpy(zero_copy_only=False)
            self._learn(coded.dictionary.take(pa.array(new)), marks[new])
            found[new] = np.fromiter(map(self.slots.__getitem__, names[new]), dtype=np.int64, count=len(new))
        return found[index]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, bounds): the ids of text i are ids[bounds[i]:bounds[i + 1]]; a null text has none."""
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        if len(self.slots) > self.limit:
            self.clear()
        lower, latin = pc.utf8_lower(words.dictionary), pc.match_substring_regex(words.dictionary, LATIN)
        for token in self.added:
            latin = pc.and_not(latin, pc.match_substring(lower, token))
        # Lower case, and closing marks after letters, make no difference to the ids.
        whole = pc.if_else(latin, lower, words.dictionary)
        parts = pc.extract_regex(pc.if_else(latin, lower, ""), MARKED)
        marked = parts.is_valid()
        head = self._slots(pc.if_else(marked, parts.field("head"), whole), latin)
        tail = self._slots(pc.if_else(marked, parts.field("tail"), ""), latin)
        both = np.stack([head, tail], axis=1).ravel()
        sizes = self.sizes[both]
        known = self.flat[ranges(self.starts[both], sizes)]
        size_of = sizes.reshape(-1, 2).sum(axis=1)
        start_of = np.cumsum(size_of) - size_of
        index = words.indices.to_numpy(zero_copy_only=False)
        sizes = size_of[index]
        ids = known[ranges(start_of[index], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        first = lists.offsets.to_numpy()
        return ids, ends[first - first[0]]


_KEPT: dict[str, BulkEncoder] = {}


def encoder(path: str) -> BulkEncoder:
    """One encoder for each tokenizer file and Python worker."""
    if path not in _KEPT:
        _KEPT[path] = BulkEncoder(path)
    return _KEPT[path]
