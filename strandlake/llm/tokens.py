"""Token ids by the tokenizers library, with each distinct space-led word encoded once per Python worker.

Before its merges a byte-level BPE cuts a text at every single space or line end between two other characters, so
the ids of a text are those of its words in turn. Texts in which a space stands beside other white space are encoded
whole. Words of letters with ASCII signs behind them are handed to the library's merges as they are after its cut into
pieces (a space and letters, signs), which takes half the time. Nothing here changes an id: the tests hold it against the
library on whole texts.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space beside another white space character: such texts are not cut at spaces.
_SPACES = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
UNEVEN_SPACE = f" [{_SPACES}]|[{_SPACES}] |\x01"
#: A line end between two other characters; the mark stands for it at the head of a word.
LINE_END, LINE_MARK = f"([^{_SPACES}])\n([^{_SPACES}])", "\x01"
#: Words kept by a worker; later words are encoded each time they come.
CACHE_WORDS = 400_000
#: Words put into one text for the library, and such words checked at once.
RUN_WORDS, CHECK_WORDS = 16, 2048
#: Words whose pieces are known: letters (of blocks that no later Unicode version added to), then signs.
_LETTERS, _SIGNS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}", r"!-/:-@\[-`{-~"
PLAIN_WORD, LAST_SIGNS = f"^[{_LETTERS}]+[{_SIGNS}]*$", f"([{_SIGNS}]+)$"
PIECE_END = "\x02"
_ENCODERS: dict[str, WordEncoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file; it lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def led(word: str) -> str:
    return "\n" + word[1:] if word[:1] == LINE_MARK else " " + word


def byte_letters() -> str:
    """The letter of each byte in the alphabet of byte-level vocabularies; ``PIECE_END`` stands for itself."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    letters = [chr(b) if b in own else chr(next(rest)) for b in range(256)]
    letters[ord(PIECE_END)] = PIECE_END
    return "".join(letters)


def piece_tokenizer(tokenizer):
    """The library's merges on pieces between ``PIECE_END``; None where a tokenizer's own steps before them may differ."""
    from tokenizers import Tokenizer, pre_tokenizers

    steps = json.loads(tokenizer.to_str())
    cut = steps["pre_tokenizer"] or {}
    if steps["normalizer"] or steps["model"]["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
        return None
    # an added token must not fit into such a word: each has a sign with a letter or digit behind it
    if not all(re.search(r"[!-/:-@\[-`{-~][A-Za-z0-9]", x["content"]) for x in steps["added_tokens"]):
        return None
    out = Tokenizer(tokenizer.model)
    out.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(PIECE_END)
    return out


class WordEncoder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.token_bytes = np.array([len(x) for x in self.names], np.int64)  # one letter a byte in this alphabet
        self.cache_words = cache_words
        self.pieces = piece_tokenizer(self.tokenizer)
        self.letters = byte_letters()
        self.known = pa.array([], pa.string())  # the words of the first entries
        self.pool = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.empty(1 << 14, np.int64)
        self.lengths = np.empty(1 << 14, np.int64)
        self.entries = 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of each text."""
        out = []
        for at in range(0, len(texts), 512):
            out += [np.array(e.ids, np.uint32)
                    for e in self.tokenizer.encode_batch_fast(texts[at:at + 512], add_special_tokens=False)]
        return out

    def _plain(self, words: pa.Array) -> np.ndarray:
        """Which words have known pieces."""
        if self.pieces is None:
            return np.zeros(len(words), bool)
        return pc.match_substring_regex(words, PLAIN_WORD).to_numpy(zero_copy_only=False).astype(bool)

    def _spaced(self, words: pa.Array, plain: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word with the space or line end before it, end to end, and their counts; the first so many words
        have known pieces."""
        ids, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        rest = words[plain:].to_pylist()
        lengths[plain:] -= np.fromiter((w[:1] == LINE_MARK for w in rest), np.int64, len(rest))
        lengths += 1
        cut = pc.binary_join_element_wise(f"{PIECE_END} ", pc.replace_substring_regex(words[:plain], LAST_SIGNS, f"{PIECE_END}\\1"), "")
        _, offsets, data = cut.buffers()
        ends = np.frombuffer(offsets, np.int32)[cut.offset:cut.offset + plain + 1] if plain else None
        for at in [*range(0, plain, CHECK_WORDS), *range(plain, len(words), CHECK_WORDS)]:
            to = min(at + CHECK_WORDS, plain if at < plain else len(words))
            if at < plain:
                text, _ = codecs.charmap_decode(memoryview(data)[ends[at]:ends[to]], "strict", self.letters)
                stops = [*range(at, to, RUN_WORDS), to]
                stops = (ends[stops] - ends[at]).tolist()
                runs, library = [text[i:j] for i, j in zip(stops, stops[1:])], self.pieces
            else:
                part = rest[at - plain:to - plain]
                runs, library = [(" " + " ".join(part[i:i + RUN_WORDS])).replace(" " + LINE_MARK, "\n") for i in range(0, len(part), RUN_WORDS)], self.tokenizer
            coded = library.encode_batch_fast(runs, add_special_tokens=False)
            got = np.fromiter(chain.from_iterable(e.ids for e in coded), np.uint32)
            until = np.cumsum(lengths[at:to])
            reach = np.cumsum(self.token_bytes[got])
            cuts = np.searchsorted(reach, until) + 1
            if len(got) and cuts[-1] == len(got) and np.array_equal(reach[cuts - 1], until):
                ids.append(got)
                counts.append(np.diff(cuts, prepend=0))
            else:  # a token across two words: never seen, but then each word goes alone
                each = self.whole([led(w) for w in words[at:to].to_pylist()])
                ids += each
                counts.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(ids), np.concatenate(counts)

    def _store(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """Append entries to the pool; the number of the first."""
        first, n = self.entries, len(counts)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while first + n > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.empty_like(self.lengths)])
        self.pool[self.used:self.used + len(ids)] = ids
        self.starts[first:first + n] = self.used + np.cumsum(counts) - counts
        self.lengths[first:first + n] = counts
        self.used += len(ids)
        self.entries += n
        return first

    def _entries(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
        """For each text its word entries, as flat entry numbers and text offsets; what to cut the pool back to."""
        odd = pc.match_substring_regex(texts, UNEVEN_SPACE).to_numpy(zero_copy_only=False).astype(bool)
        plain = pc.if_else(pa.array(~odd), texts, "")
        lines = pc.replace_substring_regex(plain, LINE_END, f"\\1 {LINE_MARK}\\2")
        words = pc.split_pattern(lines, " ")
        offsets, words = words.offsets.to_numpy(), words.flatten().cast(pa.string())
        heads = np.zeros(len(words), bool)
        heads[offsets[:-1]] = True
        entry = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().astype(np.int64)
        missing = np.flatnonzero((entry < 0) & ~heads)
        coded = words.take(pa.array(missing)).dictionary_encode()
        names, number = coded.dictionary, np.empty(len(coded.dictionary), np.int64)
        empty = pc.equal(names, "").to_numpy(zero_copy_only=False)  # a space at the end of a text
        plain, even = self._plain(names), np.flatnonzero(~empty)
        room = max(0, self.cache_words - len(self.known))

        def add(part: np.ndarray) -> pa.Array:
            part = np.concatenate([part[plain[part]], part[~plain[part]]])
            new = names.take(pa.array(part))
            at = self._store(*self._spaced(new, int(plain[part].sum())))
            number[part] = np.arange(at, at + len(part))
            return new

        self.known = pa.concat_arrays([self.known, add(even[:room])])
        cut = (self.entries, self.used)  # what follows is forgotten after this batch
        add(even[room:])
        at = self._lone([" "] * int(empty.sum()))
        number[empty] = at
        entry[missing] = number[coded.indices.to_numpy()]
        alone = texts.filter(pa.array(odd)).to_pylist()
        first = words.take(pa.array(offsets[:-1][~odd])).to_pylist()
        at = self._lone(alone + first)
        where = np.empty(len(texts), np.int64)
        where[odd] = np.arange(at, at + len(alone))
        where[~odd] = np.arange(at + len(alone), at + len(alone) + len(first))
        entry[heads] = where
        return entry, offsets, cut

    def _lone(self, texts: list[str]) -> int:
        ids = self.whole(texts)
        return self._store(np.concatenate(ids) if ids else np.empty(0, np.uint32), np.array([len(x) for x in ids], np.int64))

    def _forget(self, cut: tuple[int, int]) -> None:
        self.entries, self.used = cut

    def _ids(self, entry: np.ndarray, n: int) -> np.ndarray:
        """The n ids of entries, end to end: entries lie behind each other, so that Arrow copies each as one value."""
        offsets = np.append(self.starts[:self.entries], self.used) * self.pool.itemsize
        values = pa.Array.from_buffers(pa.large_binary(), self.entries, [None, pa.py_buffer(offsets), pa.py_buffer(self.pool)])
        return np.frombuffer(values.take(pa.array(entry)).buffers()[2], np.uint32, n)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the count of each text."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        entry, offsets, cut = self._entries(texts)
        n = self.lengths[entry]
        ids = self._ids(entry, int(n.sum()))
        counts = np.add.reduceat(n, offsets[:-1])
        self._forget(cut)
        return ids, counts

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        if not len(texts):
            return np.empty(0, np.int64)
        entry, offsets, cut = self._entries(texts)
        counts = np.add.reduceat(self.lengths[entry], offsets[:-1])
        self._forget(cut)
        return counts
