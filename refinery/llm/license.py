"""Licence scan: matching statistics against a generalised suffix automaton.

The automaton holds the word sequences of all templates and phrases. A document
streams through it word by word: at each word it gives the length of the longest
suffix read so far that occurs in any template, in amortised constant time. Runs
of words that no template has reset it, so only runs of template words are
walked. Maximal matches of ``MIN_MATCH`` words or more are chained per template
(both sides ascending, gaps up to ``MAX_GAP`` words); a chain that covers
``COVER`` of a template's words is a span with the template's label. Base phrases
are found at the same walk, as suffixes of the current match.

Memory is that of a slice of text and the automaton, which is fixed. Whole texts
are read; a text of any length is walked in linear time.

Nulls: a null text counts as empty (no words, no labels, score 0). Rows are
scanned one by one, so repeated rows and ids give equal rows; a null id stays
null. Empty tables give empty results, and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refinery.llm.store import in_tasks
from refinery.llm.textbatch import ALNUM, Words, pieces

MIN_MATCH, MAX_GAP, COVER = 4, 8, 0.7

# Base phrases and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Notices as their licences recommend them (public texts).
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
            " associated documentation files (the \"Software\"), to deal in the Software without restriction,"
            " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,"
            " and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the"
                 " License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
            " that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
            " General Public License as published by the Free Software Foundation"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
            " hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
)


def _words(text: str) -> tuple[list[bytes], np.ndarray]:
    w = Words(pa.array([text]), keep=ALNUM, lower=True)
    raw = w.data.tobytes()
    return [raw[a:b] for a, b in zip(w.starts, w.ends)], w.hashes()


@dataclass(frozen=True)
class Span:
    label: str
    first_word: int
    last_word: int
    covered: int
    score: float


class Automaton:
    """Generalised suffix automaton over word numbers (from 1; 0 is any other word)."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        self.labels = [label for label, _ in templates]
        self.base = [label for _, label in base]
        number: dict[int, int] = {}
        texts, phrases = [], []
        for out, source in ((texts, [t for _, t in templates]), (phrases, [p for p, _ in base])):
            for text in source:
                _, h = _words(text)
                out.append([number.setdefault(int(x), len(number) + 1) for x in h])
        self.known = np.array(sorted(number), np.uint64)
        self.numbers = np.array([number[int(x)] for x in self.known], np.int32)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.known & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.sizes = [len(t) for t in texts]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: state -> (template, position of the last word) of every place of its words
        self.places: list[list[tuple[int, int]]] = [[]]
        for n, words in enumerate(texts + phrases):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, word)
                if n < len(texts):
                    self.places[last].append((n, at))
        children: list[list[int]] = [[] for _ in self.link]
        for state, parent in enumerate(self.link):
            if parent >= 0:
                children[parent].append(state)
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.places[self.link[state]] += self.places[state]
        self.places[0] = []
        self.places = [sorted(set(p)) for p in self.places]
        #: state -> base phrases (number, words) that end any of its matches of that size
        self.ending: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for n, words in enumerate(phrases):
            state = 0
            for word in words:
                state = self.next[state][word]
            below = [state]
            while below:
                s = below.pop()
                self.ending[s].append((n, len(words)))
                below += children[s]
        self.shortest = min(map(len, phrases), default=MIN_MATCH)

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, word)
        new = self._state({}, self.length[last] + 1)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
        return new

    def _clone(self, p: int, q: int, word: int) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _state(self, following: dict[int, int], length: int) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        self.places.append([])
        return len(self.next) - 1

    def tokens(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int32)
        some = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, h[some]), len(self.known) - 1)
        hit = self.known[at] == h[some]
        out[some[hit]] = self.numbers[at[hit]]
        return out

    def walk(self, run: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Base places (phrase, first word) and maximal matches (last word, size, state)."""
        base, matches = [], []
        following, link, length, ending = self.next, self.link, self.length, self.ending
        state = size = 0
        for at, word in enumerate(run):
            before, held = state, size
            while state and word not in following[state]:
                state = link[state]
                size = length[state]
            if word in following[state]:
                state = following[state][word]
                size += 1
            if held >= MIN_MATCH and size <= held:
                matches.append((at - 1, held, before))
            for n, words in ending[state]:
                if size >= words:
                    base.append((n, at - words + 1))
        if size >= MIN_MATCH:
            matches.append((len(run) - 1, size, state))
        return base, matches


def chains(automaton: Automaton, matches: list[tuple[int, int, int]]) -> list[Span]:
    """Best chain of each template from a document's maximal matches (last word, size, state)."""
    by_template: dict[int, list[tuple[int, int, int]]] = {}
    for last, size, state in matches:
        for template, end in automaton.places[state]:
            by_template.setdefault(template, []).append((last, size, end))
    spans = []
    for template, found in by_template.items():
        need = COVER * automaton.sizes[template]
        open_chains: list[tuple[int, int, int, int]] = []  # (covered, first word, last word, end in the template)
        done: list[tuple[int, int, int, int]] = []
        for last, size, end in sorted(found):
            first = last - size + 1
            done += [c for c in open_chains if c[2] + MAX_GAP < first]
            open_chains = [c for c in open_chains if c[2] + MAX_GAP >= first]
            best = (size, first, last, end)
            for covered, f, held_last, held_end in open_chains:
                fresh = min(size, last - held_last, end - held_end)
                if fresh > 0 and (covered + fresh, -f) > (best[0], -best[1]):
                    best = (covered + fresh, f, last, end)
            open_chains.append(best)
        taken = -1
        for covered, f, last, _ in sorted(done + open_chains, key=lambda c: (-c[0], c[1])):
            if covered >= need and f > taken:
                spans.append(Span(automaton.labels[template], f, last, covered,
                                  min(1.0, covered / automaton.sizes[template])))
                taken = max(taken, last)
    return sorted(spans, key=lambda s: (s.first_word, s.label))


_DDL = ("doc_id long, n_words long, base array<struct<label: string, word: long>>, "
        "spans array<struct<label: string, first_word: long, last_word: long, covered: long, score: double>>")
_BASE_T = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_SPAN_T = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                              ("covered", pa.int64()), ("score", pa.float64())]))


def _scan(automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Automaton = automaton.value
        least = min(a.shortest, MIN_MATCH)
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"), keep=ALNUM, lower=True)
            token = a.tokens(words.hashes())
            inside = token > 0
            new = np.ones(len(token), bool)  # a run ends where a word is unknown or a document begins
            new[1:] = ~inside[:-1] | (words.doc[1:] != words.doc[:-1])
            first = np.flatnonzero(inside & new)
            size = np.diff(np.searchsorted(np.flatnonzero(inside), np.append(first, len(token))))
            base: dict[int, list] = {}
            matches: dict[int, list] = {}
            for at, n in zip(first[size >= least].tolist(), size[size >= least].tolist()):
                places, maximal = a.walk(token[at:at + n].tolist())
                if places or maximal:
                    doc = int(words.doc[at])
                    shift = at - int(words.bounds[doc])
                    base.setdefault(doc, []).extend((n_, w + shift) for n_, w in places)
                    matches.setdefault(doc, []).extend((last + shift, s, state) for last, s, state in maximal)
            rows = range(batch.num_rows)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(words.bounds), pa.int64()),
                pa.array([[{"label": a.base[n_], "word": w} for n_, w in base.get(i, ())] for i in rows], _BASE_T),
                pa.array([[vars(s) for s in chains(a, matches[i])] if i in matches else [] for i in rows], _SPAN_T),
            ], names=["doc_id", "n_words", "base", "spans"])
    return run


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
         automaton: Automaton | None = None) -> DataFrame:
    """doc_id, n_words, base (label and first word of every phrase place) and spans
    (label, first and last word, words covered, share of the template) per row."""
    held = docs.sparkSession.sparkContext.broadcast(automaton or Automaton())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_tasks(texts, _scan(held), _DDL)


def labels(docs: DataFrame) -> DataFrame:
    """The scan as counts, places and sorted label lists."""
    found = scan(docs)
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base.label", "spans.label")), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0))
        .otherwise(F.coalesce(F.array_max("spans.score"), F.lit(0.0))).alias("score"), "spans")
