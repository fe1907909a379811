"""License scans by template markup.

A template is a license's wording with markup:

* plain words are mandatory, in their order;
* `<<beginOptional>> ... <<endOptional>>` may be left out as a whole, and may hold more markup;
* `<<var;name=...;words=a-b>>` stands for any a to b words (a copyright holder, a title).

Templates are compiled to one deterministic automaton over words: states are sets of
places in templates, symbols are the words that occur in templates and one symbol
for all other words, so the table is of fixed size, whatever the texts are.  Every word
of a text at which some template can begin starts a lane, and all lanes of a slice of
texts step through the table together until they die; a lane in an accepting state has
found its template's mandatory wording exactly, and the longest such place of each
template and start counts.  Words of texts are compared with those of templates byte by byte.

A set of templates whose automaton outgrows ``MAX_STATES`` is halved into several automata;
one template alone that does is refused.  Texts are read whole, in slices, and never shuffled.

``score`` is m / (m + 1) for the greatest number m of mandatory words of a template found: a
phrase of four words speaks less clearly than a whole license text.

Cases: null and empty texts have no words, no labels and score 0; words and case are as in
the contract (only A-Z are lower-cased); a match never passes a text's end; overlapping
places count each; repeated rows are judged each; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .cluster import ship, table

MAX_STATES = 1 << 14


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    text: str
    base: bool = False


#: The phrases of the contract and wordings of licenses, with their labels.
TEMPLATES = [
    Template("mit phrase", "mit", "under the mit license", base=True),
    Template("apache phrase", "apache-2", "apache license version 2", base=True),
    Template("cc phrase", "cc-by-nc", "cc by nc", base=True),
    Template("mit notice", "mit", "<<beginOptional>>is<<endOptional>> released <<beginOptional>>and distributed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> MIT <<beginOptional>>open source<<endOptional>> License"),
    Template("apache notice", "apache-2", "Licensed under the <<beginOptional>>terms of the<<endOptional>> Apache <<beginOptional>>Software<<endOptional>> License <<beginOptional>>Version<<endOptional>> 2 <<beginOptional>>0 <<beginOptional>>the License<<endOptional>><<endOptional>>"),
    Template("cc notice", "cc-by-nc", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-NC <<var;name=version;words=0-2>>"),
    Template("cc name", "cc-by-nc", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution NonCommercial <<var;name=version;words=0-2>> <<beginOptional>>International<<endOptional>> License"),
    Template("gpl notice", "gpl-3", "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3 <<beginOptional>>of the License<<endOptional>> <<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>"),
    Template("gpl header", "gpl-3", "is free software you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation either version 3 of the License or <<beginOptional>>at your option<<endOptional>> any later version"),
    Template("apache header", "apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this <<var;name=what;words=1-3>> except in compliance with the License. You may obtain a copy of the License at"),
    Template(
        "mit text", "mit",
        "<<beginOptional>>The MIT License <<beginOptional>>MIT<<endOptional>><<endOptional>> <<beginOptional>>Copyright <<beginOptional>>c<<endOptional>> <<var;name=holder;words=0-12>><<endOptional>> "
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL <<var;name=holders;words=1-8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    Template(
        "isc text", "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    Template(
        "bsd text", "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1<<endOptional>> "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2<<endOptional>> "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
]

_MARK = re.compile(r"<<(.*?)>>", re.S)
_VAR = re.compile(r"var;(?:[^;]*;)*words=(\d+)-(\d+)")


def _words(text: str) -> list[str]:
    w = W.find(*W.text_bytes(pa.array([text], pa.large_string())), W.ALNUM, True)
    return [w.text(i).decode() for i in range(len(w.start))]


def parse(text: str) -> list:
    """Words, (least, most) of replaceable regions, and lists of what is optional."""
    stack: list[list] = [[]]
    at = 0
    for mark in _MARK.finditer(text):
        stack[-1].extend(_words(text[at : mark.start()]))
        at = mark.end()
        name = mark[1].strip()
        if name == "beginOptional":
            stack.append([])
        elif name == "endOptional" and len(stack) > 1:
            inner = stack.pop()
            stack[-1].append(inner)
        elif (var := _VAR.fullmatch(name)) and int(var[1]) <= int(var[2]):
            stack[-1].append((int(var[1]), int(var[2])))
        else:
            raise ValueError(f"markup {mark[0]}")
    if len(stack) > 1:
        raise ValueError("optional region without an end")
    return stack[0] + _words(text[at:])


def mandatory(parts: list) -> int:
    return sum(isinstance(p, str) for p in parts)


@dataclass
class _Places:
    """The places of all templates: what a word leads to, and what needs no word."""

    word: list[dict[str | None, set[int]]] = field(default_factory=list)  # None: any word
    free: list[set[int]] = field(default_factory=list)

    def new(self) -> int:
        self.word.append({})
        self.free.append(set())
        return len(self.word) - 1

    def lay(self, parts: list, at: int) -> int:
        """Lay parts behind a place; gives the place after them."""
        for part in parts:
            if isinstance(part, str):
                after = self.new()
                self.word[at].setdefault(part, set()).add(after)
            elif isinstance(part, list):
                after = self.new()
                self.free[self.lay(part, at)].add(after)
                self.free[at].add(after)
            else:
                after, here = self.new(), at
                for k in range(part[1]):
                    if k >= part[0]:
                        self.free[here].add(after)
                    then = self.new()
                    self.word[here].setdefault(None, set()).add(then)
                    here = then
                self.free[here].add(after)
            at = after
        return at

    def closed(self, places: set[int]) -> frozenset[int]:
        todo, out = list(places), set(places)
        while todo:
            for p in self.free[todo.pop()] - out:
                out.add(p)
                todo.append(p)
        return frozenset(out)


@dataclass
class Automaton:
    """The table of a set of templates; state 0 is dead, state 1 the start, symbol 0 any other word."""

    templates: list[Template]
    symbols: W.Words
    hashes: np.ndarray  # sorted
    number: np.ndarray  # of the symbol with each hash
    table: np.ndarray
    accepts: list[tuple[int, ...]]  # templates, by state

    def __post_init__(self) -> None:
        self.accepting = np.array([bool(a) for a in self.accepts])


def compile_set(templates: list[Template]) -> Automaton | None:
    """None if there are more than MAX_STATES states."""
    places = _Places()
    start = places.new()
    ends: dict[int, int] = {}
    for number, t in enumerate(templates):
        parts = parse(t.text)
        if not mandatory(parts):
            raise ValueError(f"template {t.name} has no mandatory word")
        first = places.new()
        places.free[start].add(first)
        ends[places.lay(parts, first)] = number
    vocabulary = sorted({w for steps in places.word for w in steps if w is not None})
    states: dict[frozenset[int], int] = {frozenset(): 0, places.closed({start}): 1}
    order = list(states)
    rows = [[0] * (len(vocabulary) + 1)]
    at = 1
    while at < len(order):
        row = []
        anything = set().union(*(places.word[p].get(None, ()) for p in order[at]))
        for w in [None, *vocabulary]:
            reached = places.closed(anything.union(*(places.word[p].get(w, ()) for p in order[at])) if w is not None else anything)
            if reached not in states:
                states[reached] = len(order)
                order.append(reached)
                if len(order) > MAX_STATES:
                    return None
            row.append(states[reached])
        rows.append(row)
        at += 1
    joined = np.frombuffer(" ".join(vocabulary).encode(), np.uint8)
    symbols = W.find(joined, np.array([0, len(joined)]), W.ALNUM)
    by_hash = np.argsort(symbols.hash, kind="stable")
    accepts = [tuple(sorted({ends[p] for p in s if p in ends})) for s in order]
    return Automaton(templates, symbols, symbols.hash[by_hash], by_hash + 1, np.array(rows, np.int32), accepts)


def compile_templates(templates: list[Template]) -> list[Automaton]:
    if not templates:
        return []
    whole = compile_set(templates)
    if whole is not None:
        return [whole]
    if len(templates) == 1:
        raise ValueError(f"template {templates[0].name} needs more than {MAX_STATES} states")
    half = len(templates) // 2
    return compile_templates(templates[:half]) + compile_templates(templates[half:])


def symbols_of(a: Automaton, w: W.Words) -> np.ndarray:
    """The symbol of each word, compared byte by byte."""
    out = np.zeros(len(w.hash), np.int32)
    spot = np.searchsorted(a.hashes, w.hash)
    at = np.flatnonzero(spot < len(a.hashes))
    while len(at):  # once, but for distinct symbols with one hash
        at = at[a.hashes[spot[at]] == w.hash[at]]
        same = W.same_words(w, at, a.symbols, a.number[spot[at]] - 1)
        out[at[same]] = a.number[spot[at[same]]]
        at = at[~same]
        spot[at] += 1
        at = at[spot[at] < len(a.hashes)]
    return out


def matches(a: Automaton, w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template, first word and word after the last of the longest match of each template at each start."""
    symbol = symbols_of(a, w)
    begin = np.flatnonzero(a.table[1][symbol] > 0)
    state = a.table[1][symbol[begin]]
    stop = w.first[w.doc[begin] + 1]
    after = begin + 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(begin):
        for s in np.unique(state[a.accepting[state]]):
            own = state == s
            found.extend((np.full(int(own.sum()), t), begin[own], after[own]) for t in a.accepts[s])
        on = after < stop
        begin, state, stop, after = begin[on], state[on], stop[on], after[on]
        state = a.table[state, symbol[after]]
        on = state > 0
        begin, state, stop, after = begin[on], state[on], stop[on], after[on] + 1
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    template, first, end = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((end, template, first))
    template, first, end = template[order], first[order], end[order]
    longest = np.ones(len(order), bool)
    longest[:-1] = (template[1:] != template[:-1]) | (first[1:] != first[:-1])
    return template[longest], first[longest], end[longest]


_MATCH = pa.struct([("template", pa.string()), ("label", pa.string()), ("base", pa.bool_()), ("mandatory", pa.int32()), ("first", pa.int64()), ("last", pa.int64())])


def scan(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words and matches (template, label, base, mandatory words, first and last word), in order of the first word."""
    ship(docs.sparkSession)
    automata = compile_templates(TEMPLATES if templates is None else templates)
    sent = docs.sparkSession.sparkContext.broadcast(automata)  # tables of MAX_STATES rows at most, a column a word of the templates

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [(t.name, t.label, t.base, mandatory(parse(t.text))) for a in sent.value for t in a.templates]
        of = [pa.array(x, t.type) for x, t in zip(zip(*kinds, strict=True), _MATCH, strict=False)] if kinds else []
        for batch in batches:
            for part, data, offsets in W.slices(batch):
                w = W.find(data, offsets, W.ALNUM, True)
                found, before = [], 0
                for a in sent.value:
                    template, first, end = matches(a, w)
                    found.append(np.stack([template + before, first, end]))
                    before += len(a.templates)
                template, first, end = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
                order = np.lexsort((template, first))
                template, first, end = template[order], first[order], end[order]
                doc = w.doc[first]
                bounds = pa.array(np.searchsorted(doc, np.arange(w.n + 1)).astype(np.int32))
                columns = [c.take(pa.array(template)) for c in of] or [pa.array([], t.type) for t in list(_MATCH)[:4]]
                columns += [pa.array(first - w.first[doc]), pa.array(end - 1 - w.first[doc])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w.counts.astype(np.int64)), pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(columns, fields=list(_MATCH)))], ["doc_id", "n_words", "matches"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        each, "doc_id long, n_words long, matches array<struct<template: string, label: string, base: boolean, mandatory: int, first: long, last: long>>"
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["first"])
    names = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    most = F.coalesce(F.array_max(F.transform("matches", lambda m: m["mandatory"])), F.lit(0)).cast("double")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("matches")).alias("labels"),
        (most / (most + 1)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))


def _pattern(parts: list) -> str:
    """A regular expression of the same wording over words that are each followed by a space."""
    one = {str: lambda p: f"{p} ", list: lambda p: f"(?:{_pattern(p)})?", tuple: lambda p: f"(?:[^ ]+ ){{{p[0]},{p[1]}}}"}
    return "".join(one[type(p)](p) for p in parts)


def sql(templates: list[Template] = TEMPLATES) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    holds = [(t, parse(t.text), f"regexp_matches(s, ' {_pattern(parse(t.text))}')") for t in templates]
    label_of = lambda some: ", ".join(f"CASE WHEN {h} THEN '{t.label}' END" for t, _, h in holds if some(t))
    labels = lambda some: f"coalesce(array_to_string(list_sort(list_distinct([x for x in [{label_of(some)}] if x IS NOT NULL])), ','), '')"
    places = " || ".join(f"CASE WHEN {h} THEN [i for i in range(0, len(w)) if w[i + 1 : i + {len(p)}] = {p!r}] ELSE [] END" for t, p, h in holds if t.base)
    most = ", ".join(f"CASE WHEN {h} THEN {mandatory(p)} ELSE 0 END" for _, p, h in holds)
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), j AS (
  SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM d
), f AS (
  SELECT doc_id, w, {places} AS places, {labels(lambda t: t.base)} AS base_labels, {labels(lambda t: True)} AS labels, CAST(greatest({most}) AS DOUBLE) AS m FROM j
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word, base_labels, labels, m / (m + 1) AS score FROM f
"""


SQL = sql()
