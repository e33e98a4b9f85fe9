"""License scans by template markup: license wording with optional and replaceable regions, compiled into word automata.

Markup of a template: ``[[ ... ]]`` is an optional region (they may nest), ``{{least,most}}`` stands for any ``least`` to
``most`` words (names, years, addresses). All other words are mandatory and have to come exactly and in order. Case,
punctuation and line breaks play no part, since templates and texts are both reduced to words first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from strandlake.llm.batches import by_bytes, one, strings

_BREAKS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_UPPER = {c: c + 32 for c in range(65, 91)}

#: Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
    WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {{1,12}} BE LIABLE FOR ANY
    CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
    WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: [[1]] Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. [[2]] Redistributions in binary form must reproduce the above copyright notice, this
    list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution."""
#: Fixed values: (name, label, template). The wording is that of the licenses themselves or of the usual notices of them.
TEMPLATES = (
    ("mit-text", "mit", f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the
        Software. {_WARRANTY}"""),
    ("mit-notice", "mit", "released under the [[terms of the]] MIT License"),
    ("mit-dual", "mit", "licensed under either of [[{{1,8}} or]] the MIT license"),
    ("isc-text", "isc", """Permission to use, copy, modify, and [[or]] distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("bsd-3-text", "bsd-3-clause", _BSD_HEAD + """ [[3]] Neither the name of {{1,12}} nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission."""),
    ("bsd-2-text", "bsd-2-clause", _BSD_HEAD + " THIS SOFTWARE IS PROVIDED BY {{1,12}} AS IS"),
    ("apache-2-notice", "apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at [[{{1,8}}]] Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"""),
    ("apache-2-line", "apache-2", "licensed under the [[terms of the]] Apache [[Software]] License [[Version]] 2 [[0]]"),
    ("gpl-3-notice", "gpl-3", """is free software: you can redistribute it and or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"""),
    ("gpl-2-notice", "gpl-2", """is free software; you can redistribute it and or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"""),
    ("gpl-3-line", "gpl-3", "licensed under [[the terms of]] the GNU General Public License [[as published by the Free Software Foundation]] version 3 [[0]]"),
    ("gpl-2-line", "gpl-2", "licensed under [[the terms of]] the GNU General Public License [[as published by the Free Software Foundation]] version 2 [[0]]"),
    ("mpl-2-notice", "mpl-2", "subject to the terms of the Mozilla Public License [[v]] [[version]] 2 0"),
    ("cc-by-nc-line", "cc-by-nc", "licensed under [[a]] [[the]] [[Creative Commons]] CC BY NC [[{{1,1}} 0]]"),
    ("cc-by-nc-name", "cc-by-nc", "Creative Commons Attribution [[-]] NonCommercial [[{{1,1}} 0]] [[International]] License"),
    ("cc-by-name", "cc-by", "Creative Commons Attribution [[{{1,1}} 0]] [[International]] License"),
    ("cc0-notice", "cc0", "has waived all copyright and related or neighboring rights to [[{{1,12}}]] worldwide"),
    ("unlicense-text", "unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights", "all-rights-reserved", "Copyright [[c]] {{1,12}} All rights reserved"),
)


def words(text: str) -> list[str]:
    """The words of a text: ASCII letters lower-cased, cut at all other ASCII but digits."""
    return _WORD.findall(text.translate(_UPPER))


def parse(template: str) -> list:
    """A template as a list of words, (least, most) gaps, and lists for optional regions."""
    stack: list[list] = [[]]
    for part in re.split(r"(\[\[|\]\]|\{\{\d+,\d+\}\})", template):
        if part == "[[":
            stack.append([])
        elif part == "]]":
            if len(stack) == 1:
                raise ValueError(f"optional region closed but not opened: {template[:60]!r}")
            inner = stack.pop()
            if inner:
                stack[-1].append(inner)
        elif part.startswith("{{"):
            least, most = map(int, part[2:-2].split(","))
            if not 0 <= least <= most or most < 1:
                raise ValueError(f"gap of {least} to {most} words")
            stack[-1].append((least, most))
        else:
            stack[-1] += words(part)
    if len(stack) > 1:
        raise ValueError(f"optional region not closed: {template[:60]!r}")
    return stack[0]


def mandatory(tree: list) -> int:
    """The number of mandatory words."""
    return sum(isinstance(x, str) for x in tree)


@dataclass
class Automaton:
    """An automaton over words without empty moves: ``moves[state]`` is (word or None for any word, next states)."""

    moves: list[tuple[str | None, tuple[int, ...]]]
    start: tuple[int, ...]
    FINAL = -1

    @classmethod
    def build(cls, tree: list) -> Automaton:
        """States are made from the end of the template back, each knowing the states that may follow it."""
        moves: list[tuple[str | None, tuple[int, ...]]] = []

        def state(word: str | None, then: tuple[int, ...]) -> int:
            moves.append((word, then))
            return len(moves) - 1

        def before(items: list, then: tuple[int, ...]) -> tuple[int, ...]:
            for x in reversed(items):
                if isinstance(x, str):
                    then = (state(x, then),)
                elif isinstance(x, list):
                    then = tuple(dict.fromkeys(before(x, then) + then))
                else:
                    least, most = x
                    after = then
                    for k in range(most, 0, -1):  # k-th word of the gap; from the least on the gap may end
                        here = state(None, then)
                        then = (here, *after) if k > least else (here,)
                        then = tuple(dict.fromkeys(then))
            return then

        start = before(tree, (cls.FINAL,))
        if cls.FINAL in start:
            raise ValueError("a template needs a mandatory word")
        return cls(moves, start)

    def first_words(self) -> set[str]:
        found = {self.moves[s][0] for s in self.start}
        if None in found:
            raise ValueError("a template has to begin with a word")
        return found


class Matcher:
    """All templates as one automaton. Matches are (template number, first word, end word), for each template the longest
    from each start that does not begin inside an earlier one of the template."""

    def __init__(self, templates=TEMPLATES):
        self.names = [n for n, _, _ in templates]
        self.labels = [label for _, label, _ in templates]
        trees = [parse(t) for _, _, t in templates]
        self.size = [mandatory(t) for t in trees]
        self.automata = [Automaton.build(t) for t in trees]
        self.starts: dict[str, list[int]] = {}
        for k, a in enumerate(self.automata):
            for w in a.first_words():
                self.starts.setdefault(w, []).append(k)

    def matches(self, seq: list[str], anchors: list[int]) -> list[tuple[int, int, int]]:
        """Accepted stretches of a word sequence. ``anchors`` are the places of words that some template begins with."""
        out = []
        free = [0] * len(self.automata)  # no start of a template before this place
        for at in anchors:
            for k in self.starts.get(seq[at], ()):
                if at >= free[k]:
                    end = self._longest(self.automata[k], seq, at)
                    if end:
                        out.append((k, at, end))
                        free[k] = end
        return out

    @staticmethod
    def _longest(a: Automaton, seq: list[str], at: int) -> int:
        """The end of the longest accepted stretch from ``at``; 0 if there is none. Sets of states, so no way is tried twice."""
        live, end, moves = set(a.start), 0, a.moves
        for i in range(at, len(seq)):
            word, then = seq[i], set()
            for s in live:
                want, after = moves[s]
                if want is None or want == word:
                    then.update(after)
            if a.FINAL in then:
                end = i + 1
                then.discard(a.FINAL)
            if not then:
                break
            live = then
        return end


def _phrase_places(codes: np.ndarray, of: np.ndarray, number: dict[str, int], phrase: list[str]) -> np.ndarray:
    """Places at which the words of a phrase come one after the other within a text."""
    want = [number.get(w, -1) for w in phrase]
    n = len(codes) - len(want) + 1
    if min(want) < 0 or n < 1:
        return np.empty(0, np.int64)
    ok = of[:n] == of[len(want) - 1:]
    for i, w in enumerate(want):
        ok &= codes[i:i + n] == w
    return np.flatnonzero(ok)


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers of all words, the distinct words, and the offsets of the texts."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), _BREAKS)
    offsets = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy(), coded.dictionary
    empty = pc.index(names, "").as_py()
    if empty >= 0:
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return codes, names, offsets


def scan(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) of every row.

    ``matches`` are the accepted stretches (template, start, end) in words. The score is n / (n + 1) for the largest n, the number of
    mandatory words, of any template or phrase found: longer wording is stronger evidence. A text with neither has 0, as
    have null and empty texts. Null doc_ids and repeated rows keep their rows; other columns are not read; an empty table
    gives no rows. A text of any length is read once, with work bounded by the longest template at each of its starts.
    """
    phrase_words = [(p.split(), label) for p, label in phrases.items()]
    fields = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
              "matches array<struct<template: string, start: long, end: long>>")
    kind = pa.list_(pa.struct([("template", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates)
        begins = pa.array(sorted(matcher.starts), pa.string())
        for t in by_bytes(batches):
            codes, names, offsets = split(strings(t.column("text")))
            n = t.num_rows
            words_of = names.to_pylist()
            number = {w: i for i, w in enumerate(words_of)}
            of = np.repeat(np.arange(n), np.diff(offsets))
            places = [_phrase_places(codes, of, number, p) for p, _ in phrase_words]
            every = np.concatenate(places) if places else np.empty(0, np.int64)
            text_of = of[every]
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
            np.minimum.at(low, text_of, every - offsets[text_of])
            np.maximum.at(high, text_of, every - offsets[text_of])
            n_base = np.bincount(text_of, minlength=n)
            base: list[set[str]] = [set() for _ in range(n)]
            best = np.zeros(n, np.int64)
            for at, (p, label) in zip(places, phrase_words):
                for d in np.unique(of[at]).tolist():
                    base[d].add(label)
                    best[d] = max(best[d], len(p))
            # Places of words that begin a template, if a word that may follow it there comes next.
            first = pc.is_in(names, begins).to_numpy(zero_copy_only=False)
            anchors = np.flatnonzero(_may_begin(matcher, codes, number, first))
            found: list[list] = [[] for _ in range(n)]
            labels = [set(b) for b in base]
            cuts = np.searchsorted(anchors, offsets)
            for d in np.flatnonzero(np.diff(cuts)).tolist():
                lo, hi = offsets[d], offsets[d + 1]
                seq = [words_of[c] for c in codes[lo:hi].tolist()]
                for k, a, b in matcher.matches(seq, (anchors[cuts[d]:cuts[d + 1]] - lo).tolist()):
                    found[d].append({"template": matcher.names[k], "start": a, "end": b})
                    labels[d].add(matcher.labels[k])
                    best[d] = max(best[d], matcher.size[k])
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [one(t.column("doc_id")), pa.array(np.diff(offsets).astype(np.int64)), pa.array(n_base.astype(np.int64)),
                 pa.array(low, mask=none), pa.array(high, mask=none), pa.array([",".join(sorted(b)) for b in base], pa.string()),
                 pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(best / (best + 1.0)),
                 pa.array(found, kind)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, fields)


def _may_begin(matcher: Matcher, codes: np.ndarray, number: dict[str, int], first: np.ndarray) -> np.ndarray:
    """Whether a template may begin at each place, by its first two words."""
    out = np.zeros(len(codes), bool)
    heads = first[codes]
    nexts = np.append(codes[1:], -1)
    for a in matcher.automata:
        for s in a.start:
            word, then = a.moves[s]
            if word not in number:
                continue
            here = heads & (codes == number[word])
            seconds = {None if t == a.FINAL else a.moves[t][0] for t in then}
            if None not in seconds:
                here &= np.isin(nexts, [number[w] for w in seconds if w in number])
            out |= here
    return out
