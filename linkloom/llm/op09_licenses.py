"""Licence scans by sentence rules.

A text is cut into sentences: at line ends, and at ``.!?;:`` before white space or the end. A sentence is normalised to its
words, runs of ASCII letters and digits in lower case. Sentences without words, and those that only number what follows (one
or two digits, one letter), don't count. Each known licence sentence has an identifier; ``<>`` in it stands for 1 to 12 words
of any kind, as names. It is found in one sentence of the text, or wrapped over several: those that follow one another with a
single line end between them, and no ``.!?;:`` before that line end. Marks at the begin of a line, as of comments, don't
matter; a line without words parts sentences. A rule is a sequence of identifiers, to be found one right after the other.
Rules are ordered: a match that overlaps one of an earlier rule is dropped. Places and sizes of matches are counted in
sentences of the text, so a wrapped licence sentence counts as many as it has lines.

A null or empty text has no match; a document without a match has no row. Repeated rows are scanned each, and a licence that
stands twice is reported twice. Rows without doc_id are scanned, their doc_id is null. An empty table gives no rows. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import text as tx

_FOUND = "doc_id long, licence string, rule string, first_sentence int, sentences int"
_ALNUM = tx.table(bytes([*range(48, 58), *range(65, 91), *range(97, 123)]))
_END = tx.table(b".!?;:")
_LINE = tx.table(b"\n\r")
_GAP = tx.table(b" \t\n\r")
_MULTIPLIER = np.uint64(0x9FB21C651E98DF25)

_HOLE = 12

_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
    "the Software is furnished to do so, subject to the following conditions:"
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_NEXT = "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."
_MIT_AS_IS = (
    'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose '
    "and noninfringement."
)
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
_APACHE_TERMS = (
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
    "either express or implied."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution."
)
_BSD_NAME = "Neither the name of <> may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_ADVERT = "All advertising materials mentioning features or use of this software must display the following acknowledgement:"
_BSD_AS_IS = (
    'This software is provided by <> "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular '
    "purpose are disclaimed."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_OLD = "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = (
    'The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.'
)
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
_BOOST = (
    'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to '
    "use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to "
    "do so, all subject to the following:"
)
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_UNLICENSE_FREE = (
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
    "non-commercial, and by any means."
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
_MPL_COPY = "If a copy of the MPL was not distributed with this file, You can obtain one at {}://mozilla.org/MPL/2.0/."


def _gnu(work: str, family: str, version: str, mark: str) -> str:
    return (
        f"{work} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {family} as published by the Free Software Foundation{',' if mark == ':' else mark} "
        f"either version {version} of the License, or (at your option) any later version."
    )


@dataclass(frozen=True)
class Rule:
    """A licence, and the texts that declare it, one after the other; a text may be several sentences."""

    licence: str
    name: str
    sentences: tuple[str, ...]

    def steps(self) -> list[str]:
        """The normalised sentences in order."""
        return [s for text in self.sentences for s in map(normal, re.split(r"[.!?;:](?=\s|$)", text)) if not _NUMBER.fullmatch(s)]


_NUMBER = re.compile("[0-9]{0,2}|[a-z]")
_GNU_TITLES = (
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE", "Version 3, 19 November 2007"), ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE", "Version 2.1, February 1999"), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE", "Version 2, June 1991"),
)
_GNU_NOTICES = (
    ("AGPL-3.0-or-later", "Affero General Public License", "3"), ("LGPL-3.0-or-later", "Lesser General Public License", "3"), ("LGPL-2.1-or-later", "Lesser General Public License", "2.1"),
    ("GPL-3.0-or-later", "General Public License", "3"), ("GPL-2.0-or-later", "General Public License", "2"),
)
_LINES = (
    ("MIT", "mit", ("the MIT License", "the MIT license (MIT)", "MIT")), ("Apache-2.0", "apache", ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", 'the Apache License, Version 2.0 (the "License")')),
    ("BSD-3-Clause", "bsd-3", ("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License")), ("BSD-2-Clause", "bsd-2", ("the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License")),
    ("GPL-3.0-only", "gpl-3", ("the GNU General Public License, version 3", "the GNU General Public License v3", "the GPL, version 3", "the GPLv3")), ("GPL-2.0-only", "gpl-2", ("the GNU General Public License, version 2", "the GNU General Public License v2", "the GPL, version 2", "the GPLv2")),
    ("LGPL-3.0-only", "lgpl-3", ("the GNU Lesser General Public License, version 3", "the LGPLv3")), ("AGPL-3.0-only", "agpl-3", ("the GNU Affero General Public License, version 3", "the AGPLv3")),
    ("MPL-2.0", "mpl", ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0")), ("ISC", "isc", ("the ISC License",)), ("Unlicense", "unlicense", ("the Unlicense",)),
    *((f"CC-{code.upper()}-{v}", f"cc-{code}", (f"CC {code.upper()} {v}", *(f"{a} Creative Commons {name} {v} {kind} License" for a in ("a", "the") for kind in ("International", "Unported"))))
      for code, name in (("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"), ("by-sa", "Attribution-ShareAlike"), ("by", "Attribution"))
      for v in ("4.0", "3.0")),
)
_OPENINGS = ("Licensed under", "Released under", "Distributed under", *(f"This {x} is {y} under" for x in ("work", "project", "software", "program", "library", "code") for y in ("licensed", "released")))
_SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "ISC", "Unlicense", "0BSD", "Zlib", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-2.0")

RULES = (
    *(Rule("MIT", "mit-text", (_MIT_GRANT, notice, _MIT_AS_IS)) for notice in (_MIT_NOTICE, _MIT_NEXT)),
    Rule("MIT", "mit-grant", (_MIT_GRANT, _MIT_NOTICE)),
    *(Rule("Apache-2.0", "apache-notice", (_APACHE, f"{scheme}://www.apache.org/licenses/LICENSE-2.0", _APACHE_TERMS)) for scheme in ("http", "https")),
    *(Rule("Apache-2.0", "apache-header", (x,)) for x in (_APACHE, _APACHE.replace(' (the "License");', "."))),
    *(Rule("Apache-2.0", "apache-text", ("Apache License", "Version 2.0, January 2004", f"{scheme}://www.apache.org/licenses/")) for scheme in ("http", "https")),
    Rule("BSD-4-Clause", "bsd-4-text", (_BSD, _BSD_SOURCE, _BSD_BINARY, _BSD_ADVERT)),
    Rule("BSD-3-Clause", "bsd-3-text", (_BSD, _BSD_SOURCE, _BSD_BINARY, _BSD_NAME)),
    Rule("BSD-2-Clause", "bsd-2-text", (_BSD, _BSD_SOURCE, _BSD_BINARY, _BSD_AS_IS)),
    *(Rule("ISC", "isc-text", (grant + _ISC_NOTICE, _ISC_AS_IS)) for grant in (_ISC, _ISC_OLD)),
    Rule("0BSD", "0bsd-text", (_ISC + ".", _ISC_AS_IS)),
    Rule("Zlib", "zlib-text", (_ZLIB,)),
    Rule("BSL-1.0", "boost-text", (_BOOST,)),
    Rule("Unlicense", "unlicense-text", (_UNLICENSE, _UNLICENSE_FREE)),
    Rule("Unlicense", "unlicense-line", (_UNLICENSE,)),
    *(Rule("MPL-2.0", "mpl-notice", (_MPL, _MPL_COPY.format(scheme))) for scheme in ("https", "http")),
    Rule("MPL-2.0", "mpl-text", ("Mozilla Public License Version 2.0", "Definitions")),
    *(Rule(f"{code}-only" if "-only" not in code else code, f"{code.lower()}-text", (title, version)) for code, title, version in _GNU_TITLES),
    *(Rule(code, f"{code.lower().removesuffix('-or-later').removesuffix('.0')}-notice", (_gnu(work, family, version, mark),)) for code, family, version in _GNU_NOTICES for work in ("This program", "This library", "This software", "This file", "This package") for mark in ":;"),
    Rule("GPL-3.0-or-later", "gpl-3-notice", ("This program is free software. You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",)),
    Rule("GPL-2.0-only", "gpl-2-only-notice", ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",)),
    Rule("CC0-1.0", "cc0-text", ("CC0 1.0 Universal",)),
    *(Rule(code, "spdx", (f"SPDX-License-Identifier: {code}",)) for code in _SPDX),
    *(Rule(code, f"{name}-line", (f"{opening} {licence}",)) for code, name, licences in _LINES for opening in _OPENINGS for licence in licences),
    Rule("proprietary", "all-rights-reserved", ("All rights reserved",)),
)


def normal(sentence: str) -> str:
    """The words of a sentence, in lower case, one blank between them; ``<>`` stays."""
    return " ".join(re.findall(r"[a-z0-9]+|<>", re.sub("[A-Z]", lambda m: m[0].lower(), sentence)))


def known(rules: tuple[Rule, ...]) -> dict[str, int]:
    """The identifier (from 1) of each normalised licence sentence."""
    return {s: k + 1 for k, s in enumerate(dict.fromkeys(s for r in rules for s in r.steps()))}


class Form(NamedTuple):
    """A licence sentence: its words before the hole and after it (none if it has no hole), and its identifier."""

    head: list[str]
    tail: list[str]
    code: int

    @property
    def sizes(self) -> range:
        own = len(self.head) + len(self.tail)
        return range(own + 1, own + _HOLE + 1) if self.tail else range(own, own + 1)


def forms(names: dict[str, int]) -> list[Form]:
    out = []
    for text, code in names.items():
        head, _, tail = text.partition("<>")
        out.append(Form(head.split(), tail.split(), code))
    return out


class Index(NamedTuple):
    """Licence sentences by hash. first: hashes of their first words. whole: by number of words, the identifier of each hash.
    holes: by number of words, those with a hole (words and hash of the head, words and hash of the tail, identifier)."""

    first: np.ndarray
    whole: dict[int, dict[int, int]]
    holes: dict[int, list[tuple[int, int, int, int, int]]]

    @classmethod
    def of(cls, known: list[Form]) -> Index:
        whole: dict[int, dict[int, int]] = {}
        holes: dict[int, list[tuple[int, int, int, int, int]]] = {}
        for x in known:
            if x.tail:
                for n in x.sizes:
                    holes.setdefault(n, []).append((len(x.head), _digest(x.head), len(x.tail), _digest(x.tail), x.code))
            else:
                whole.setdefault(len(x.head), {})[_digest(x.head)] = x.code
        return cls(np.array(sorted({_digest(x.head[:1]) for x in known}), np.uint64), whole, holes)


class Cut(NamedTuple):
    """The sentences that count, of a slice: the words of each (first..after-1), the unit it is in (sentences of one
    unit are parted by line ends that may be wraps), how many lie before each text (one more than texts), sums of hashes."""

    first: np.ndarray
    after: np.ndarray
    unit: np.ndarray
    where: np.ndarray
    sums: np.ndarray

    def hashes(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        """A hash of the words first..after-1, for each."""
        _, downs = tx.powers(len(self.sums))
        return tx.mix((self.sums[after] - self.sums[first]) * downs[first] + (after - first).astype(np.uint64) * _MULTIPLIER)


def sentences(piece: tx.Slice, numbers: bool = False) -> Cut:
    data, offsets = piece.data, piece.offsets
    begins, ends, _ = tx.tokens(data, offsets, _ALNUM)
    if len(begins) == 0:
        none = np.zeros(0, np.int64)
        return Cut(none, none, none, np.zeros(len(offsets), np.int64), np.zeros(1, np.uint64))
    n = len(data)
    before_gap = np.ones(n, bool)
    before_gap[:-1] = _GAP[data[1:]]
    last = offsets[1:] - 1
    before_gap[last[last >= 0]] = True
    marks = _END[data] & before_gap
    stops = np.flatnonzero(_LINE[data] | marks)
    # A word begins a sentence if a stop or the text's begin lies between it and the word before.
    text = np.searchsorted(offsets[1:], begins, "right")
    mark = np.searchsorted(stops, begins) + text
    first = tx.runs(mark)
    after = np.append(first[1:], len(begins))
    size = ends[first] - begins[first]
    digit = (data[begins[first]] < 58) & (data[ends[first] - 1] < 58)
    number = np.flatnonzero((after - first == 1) & ((size == 1) | (digit & (size == 2))))
    if len(number) and not numbers:
        stay = np.ones(len(begins), bool)
        stay[first[number]] = False
        begins, ends, text, mark = begins[stay], ends[stay], text[stay], mark[stay]
        if len(begins) == 0:
            return Cut(number[:0], number[:0], number[:0], np.zeros(len(offsets), np.int64), np.zeros(1, np.uint64))
        first = tx.runs(mark)
        after = np.append(first[1:], len(begins))
    # A sentence runs on if one line end (\r\n is one) lies between it and the next, and no mark before that.
    line_end = _LINE[data]
    line_end[:-1] &= (data[:-1] != 13) | (data[1:] != 10)
    lines, marks = np.append(np.flatnonzero(line_end), n), np.append(np.flatnonzero(marks), n)
    end, begin = ends[first[1:] - 1], begins[first[1:]]
    line = np.searchsorted(lines, end)
    on = (np.searchsorted(lines, begin) - line == 1) & (lines[line] < marks[np.searchsorted(marks, end)]) & (text[first[1:]] == text[first[:-1]])
    ups, _ = tx.powers(len(begins))
    sums = np.zeros(len(begins) + 1, np.uint64)
    np.cumsum(tx.hashes(tx.LOWER[data], begins, ends) * ups[: len(begins)], out=sums[1:])
    return Cut(first, after, np.concatenate(([0], np.cumsum(~on))), np.searchsorted(begins[first], offsets), sums)


def spotted(cut: Cut, index: Index) -> list[tuple[int, int, int]]:
    """(first sentence, identifier, sentence after it) of all licence sentences, in order."""
    out: dict[tuple[int, int], int] = {}
    starts = np.flatnonzero(np.isin(cut.hashes(cut.first, cut.first + 1), index.first))
    for words in sorted({*index.whole, *index.holes}) if len(starts) else ():
        end = cut.first[starts] + words
        last = np.minimum(np.searchsorted(cut.after, end), len(cut.after) - 1)
        fits = (cut.after[last] == end) & (cut.unit[last] == cut.unit[starts])
        at, end, last = starts[fits], end[fits], last[fits]
        if len(at) == 0:
            continue
        begin = cut.first[at]
        if own := index.whole.get(words):
            hashed = cut.hashes(begin, end)
            for k in np.flatnonzero(np.isin(hashed, np.array(list(own), np.uint64))).tolist():
                out.setdefault((int(at[k]), own[int(hashed[k])]), int(last[k]) + 1)
        for before, head, behind, tail, code in index.holes.get(words, ()):
            hit = np.flatnonzero(cut.hashes(begin, begin + before) == np.uint64(head))
            hit = hit[cut.hashes(end[hit] - behind, end[hit]) == np.uint64(tail)]
            for k in hit.tolist():
                out.setdefault((int(at[k]), code), int(last[k]) + 1)
    return sorted((a, k, z) for (a, k), z in out.items())


def _digest(words: list[str]) -> int:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    cut = sentences(tx.Slice(0, raw, np.array([0, len(raw)])), numbers=True)
    return int(cut.hashes(np.array([0]), np.array([len(cut.sums) - 1]))[0])


def stretches(spots: dict[tuple[int, int], int], rules: list[tuple[int, ...]]) -> list[tuple[int, int, int]]:
    """(rule, first sentence, sentence after it) of all matches that overlap none of an earlier rule; spots: by first sentence
    and identifier, the sentence after it."""
    out, covered = [], set()
    places: dict[int, list[int]] = {}
    for at, x in spots:
        places.setdefault(x, []).append(at)
    for r, own in enumerate(rules):
        found = []
        for at in places.get(own[0], ()):
            end: int | None = at
            for y in own:
                end = spots.get((end, y)) if end is not None else None
            if end is not None:
                found.append((at, end))
        out += [(r, at, end) for at, end in found if covered.isdisjoint(range(at, end))]
        covered.update(k for at, end in found for k in range(at, end))
    return out


def matches(ids: dict[int, int], rules: list[tuple[int, ...]]) -> list[tuple[int, int]]:
    """(rule, first sentence) of the ``stretches`` of licence sentences that aren't wrapped; ids: by number of the sentence."""
    return [(r, at) for r, at, _ in stretches({(at, x): at + 1 for at, x in ids.items()}, rules)]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per match: doc_id, licence, rule, first_sentence (from 0, of the sentences with words), sentences (how many)."""
    names = known(rules)
    sequences = [tuple(names[s] for s in r.steps()) for r in rules]
    index = Index.of(forms(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for piece in tx.slices(batch.column(1)):
                cut = sentences(piece)
                spots = spotted(cut, index)
                of_doc: dict[int, dict[tuple[int, int], int]] = {}
                for d, (at, k, end) in zip((np.searchsorted(cut.where, [x[0] for x in spots], "right") - 1).tolist(), spots):
                    begin = int(cut.where[d])
                    of_doc.setdefault(d, {})[at - begin, k] = end - begin
                for d, own in of_doc.items():
                    for r, first, end in stretches(own, sequences):
                        rows.append(piece.first + d)
                        found.append((rules[r].licence, rules[r].name, first, end - first))
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], ["doc_id", "licence", "rule", "first_sentence", "sentences"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _FOUND)


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the rows of ``scan`` over ``documents`` (of distinct doc_id)."""
    names = known(rules)
    heads = ", ".join(f"('{' '.join(x.head)}', '{' '.join(x.tail)}', {x.sizes[0]}, {x.sizes[-1]}, {x.code})" for x in forms(names))
    steps = ", ".join(f"({r}, {k}, {names[s]})" for r, x in enumerate(rules) for k, s in enumerate(x.steps()))
    sizes = ", ".join(f"({r}, '{x.licence}', '{x.name}', {len(x.steps())})" for r, x in enumerate(rules))
    return rf"""
with recursive form(head, tail, least, most, id) as (values {heads}),
known as (select *, split_part(head, ' ', 1) as word from form),
step(rule, k, id) as (values {steps}),
kind(rule, licence, name, size) as (values {sizes}),
line as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as row_no from (select doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) as ls from documents)),
part as (select doc_id, row_no, unnest(ps) as raw, generate_subscripts(ps, 1) as k, len(ps) as n from (select doc_id, row_no, regexp_split_to_array(line, '[.!?;:](?:[ \t]|$)') as ps from line)),
word as (select doc_id, row_no, k, k = n as last, trim(lower(regexp_replace(raw, '[^A-Za-z0-9]+', ' ', 'g'))) as s from part),
sentence as (select doc_id, row_no, last, s, split_part(s, ' ', 1) as word, row_number() over (partition by doc_id order by row_no, k) - 1 as place from word where not regexp_full_match(s, '[0-9]{{0,2}}|[a-z]')),
grown as (
    select doc_id, place as first, place + 1 as after, row_no, last, s as acc, word from sentence x
    where exists (select 1 from known y where y.word = x.word and (starts_with(head || ' ', s || ' ') or (tail <> '' and starts_with(s || ' ', head || ' '))))
    union all
    select g.doc_id, g.first, g.after + 1, n.row_no, n.last, g.acc || ' ' || n.s, g.word from grown g join sentence n on n.doc_id = g.doc_id and n.place = g.after and g.last and n.row_no = g.row_no + 1
    where exists (select 1 from known y where y.word = g.word and (starts_with(head || ' ', g.acc || ' ' || n.s || ' ')
        or (tail <> '' and starts_with(g.acc || ' ' || n.s, head || ' ') and len(string_split(g.acc || ' ' || n.s, ' ')) <= most)))),
hit as (select doc_id, first, min(after) as after, id from grown join known using (word) where (tail = '' and acc = head)
    or (tail <> '' and starts_with(acc, head || ' ') and ends_with(acc, ' ' || tail) and len(string_split(acc, ' ')) between least and most)
    group by doc_id, first, id),
chain as (select doc_id, rule, k, first, after from hit join step using (id) where k = 0
    union all select c.doc_id, c.rule, c.k + 1, c.first, h.after from chain c join step s on s.rule = c.rule and s.k = c.k + 1 join hit h on h.doc_id = c.doc_id and h.first = c.after and h.id = s.id),
match as (select c.doc_id, c.rule, licence, name, c.first, c.after from chain c join kind using (rule) where k = size - 1)
select doc_id, licence, name as rule, cast(first as integer) as first_sentence, cast(after - first as integer) as sentences from match m
where not exists (select 1 from match o where o.doc_id = m.doc_id and o.rule < m.rule and o.first < m.after and m.first < o.after)
"""
