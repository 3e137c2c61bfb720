import random
import textwrap

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from linkloom.llm import op07_bpe as bpe
from linkloom.llm import op09_licenses as lic
from linkloom.llm import op10_packing as packing
from linkloom.llm import text as tx
from tests.llm.helpers import edge_docs, edge_rows, empty_docs, prose

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def odd_texts():
    pick = random.Random(2)
    out = ["", "it's 'sing don't we'll 've 'l 'll they're 're  's x's's", " \n\n  a  \n b", "   ", "''s", "!'s", "日本語 12３４ ½ x²", "x y　z", "a\u0085b", "😀 'd😀", "\n's", "x  's", "a" * 3000, "'" * 5 + "s", prose(1, 200)]
    return out + ["".join(pick.choice("ab 's\n\t1!éż日lrevmdt  ") for _ in range(pick.randint(0, 30))) for _ in range(800)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_encoding_against_the_merges(name):
    tokens = bpe.load(f"/opt/tokenizers/{name}")
    encoder = bpe.Encoder(tokens)
    merges = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    texts = odd_texts()
    got = []
    for piece in tx.slices(pa.array(texts), limit=2000):
        found, where = encoder.encode_slice(piece)
        got += [found[where[k] : where[k + 1]].tolist() for k in range(piece.count)]
    assert got == [merges.encode_ordinary(t) for t in texts]


def test_encoding_of_a_small_vocabulary_steps_back():
    """Naive merges by rank, on a vocabulary where the longest match is often wrong."""
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"cd", b"abc", b"bcd", b"aa", b"aab", b"dabc"]
    rank = {t: k for k, t in enumerate(tokens)}
    encoder = bpe.Encoder(tokens)
    pick = random.Random(3)

    def naive(raw):
        parts = [bytes([b]) for b in raw]
        while True:
            best = min(((rank.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                return [rank[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for _ in range(3000):
        raw = bytes(pick.choice(b"abcd") for _ in range(pick.randint(1, 14)))
        assert encoder.encode(raw) == naive(raw), raw


def test_bpe_edges_and_round_trip(spark):
    docs = edge_docs(spark)
    out = bpe.encoded(docs)
    rows = out.collect()
    assert len(rows) == len(edge_rows())
    assert all((r.tokens is None and r.n_tokens is None and r.round_trip is None) or (r.round_trip and len(r.tokens) == r.n_tokens) for r in rows)
    assert sum(r.tokens is None for r in rows) == 2 and sum(r.tokens == [] for r in rows) == 1
    back = sorted(((r.doc_id, r.text) for r in bpe.decoded(out).collect()), key=str)
    assert back == sorted(((r[0], r[1]) for r in edge_rows()), key=str)
    assert bpe.encoded(empty_docs(spark)).count() == 0


def test_licence_rules_are_ordered():
    rules = [(1, 2, 3), (1, 2), (2,), (9,)]
    assert lic.matches({0: 1, 1: 2, 2: 3, 7: 2, 8: 9}, rules) == [(0, 0), (2, 7), (3, 8)]
    assert lic.matches({0: 1, 2: 2}, rules) == [(2, 2)]
    assert lic.matches({}, rules) == []
    assert len(lic.matches({k: 9 for k in range(50_000)}, rules)) == 50_000


def test_licences_against_sql(spark):
    mit = "Copyright (c) X.\n" + " ".join([lic._MIT_GRANT.upper(), lic._MIT_NOTICE, lic._MIT_AS_IS])
    texts = [mit, f"{lic._MIT_GRANT} {lic._MIT_NOTICE} Other.", f"{lic._MIT_GRANT} other. {lic._MIT_NOTICE}", "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n x",
             "x\r\nAll rights reserved!! all RIGHTS — reserved", "released under the mit license", "not Released under the MIT License", "Licensed under CC BY-NC 4.0.\n" * 3, None, "", "... !"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in lic.scan(docs).collect())
    db = duckdb.connect()
    table = docs.toArrow()
    db.register("documents", table)
    assert got == sorted(db.execute(lic.sql()).fetchall())
    assert {(d, rule) for d, _, rule, _, _ in got} == {(0, "mit-text"), (1, "mit-grant"), (3, "apache-header"), (4, "all-rights-reserved"), (5, "mit-line"), (7, "cc-by-nc-line")}
    assert sum(d == 4 for d, *_ in got) == 2 and sum(d == 7 for d, *_ in got) == 3


def test_licence_edges(spark):
    got = [(r.doc_id, r.rule, r.first_sentence) for r in lic.scan(edge_docs(spark)).collect()]
    assert sorted(got) == [(-5, "all-rights-reserved", 0), (-5, "all-rights-reserved", 1), (17, "mit-line", 0)]
    assert lic.scan(empty_docs(spark)).count() == 0


def both(spark, texts):
    """What the scan finds, which must be what the SQL finds."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in lic.scan(docs).collect())
    db = duckdb.connect()
    table = docs.toArrow()
    db.register("documents", table)
    assert got == sorted(db.execute(lic.sql()).fetchall())
    return got


def fill(text, mark="", width=70):
    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_wrapped_licences(spark):
    grant, notice, as_is = (fill(x) for x in (lic._MIT_GRANT, lic._MIT_NOTICE, lic._MIT_AS_IS.upper() + " IN NO EVENT SHALL THE AUTHORS BE LIABLE."))
    mit = f"MIT License\n\nCopyright (c) X\n\n{grant}\n\n{notice}\n\n{as_is}\n"
    gpl = lambda mark: f"{mark}Copyright X\n{mark.rstrip()}\n" + fill(lic._gnu("This program", "General Public License", "3", ":"), mark) + f"\n{mark.rstrip()}\n"
    texts = [mit, mit.replace("\n", "\r\n"), "/*\n" + gpl(" * ") + " */\nint x;", gpl("# "), gpl(";; "), gpl("! "), "All rights\nreserved", "All rights\n\nreserved", "All rights.\nreserved", "All rights\n *\n * reserved", "not All rights\nreserved",
             "Licensed under the Apache License, Version 2.0.\nYou may not use this file except in\ncompliance with the License. You may obtain a copy\nof the License at\n\nx", "All rights", "reserved"]
    got = both(spark, texts)
    n = sum(x.count("\n") + 1 for x in (grant, notice)) + next(k + 1 for k, x in enumerate(as_is.split("\n")) if "NONINFRINGEMENT." in x)
    assert {(g[0], g[2]) for g in got} == {(0, "mit-text"), (1, "mit-text"), (2, "gpl-3-notice"), (3, "gpl-3-notice"), (4, "gpl-3-notice"), (5, "gpl-3-notice"), (6, "all-rights-reserved"), (11, "apache-header")}
    assert {(0, "MIT", "mit-text", 2, n), (1, "MIT", "mit-text", 2, n), (6, "proprietary", "all-rights-reserved", 0, 2), (11, "Apache-2.0", "apache-header", 0, 5)} <= set(got)


_BSD_3 = """Copyright (c) 2019, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES.
"""
_APACHE = """Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
_ISC = """Copyright (c) 2004-2010 by Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.
"""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
_LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY.
"""


def test_licence_files_as_they_are_found(spark):
    bsd_2 = _BSD_3[: _BSD_3.index("3. Neither")] + _BSD_3[_BSD_3.index("THIS SOFTWARE") :]
    own_name = _BSD_3.replace("the copyright holder nor the names of its\n   contributors", "Some Body, Inc. nor the names of other\n   contributors".replace(".", ""))
    comment = lambda text, mark: "\n".join((mark + line).rstrip() for line in text.split("\n"))
    gpl_2 = _LGPL.replace("library", "program").replace("Lesser General Public\nLicense", "General Public\nLicense").replace("version 2.1", "version 2")
    named = {
        "bsd-3-text": [_BSD_3, own_name, _BSD_3.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), "/*\n" + comment(_BSD_3, " * ") + "\n */"], "bsd-2-text": [bsd_2, comment(bsd_2, "// "), comment(bsd_2, "# ").replace("\n", "\r\n")],
        "apache-notice": [_APACHE, comment(_APACHE, "# "), "/*\n" + comment(_APACHE, " * "), _APACHE.replace("http:", "https:")], "isc-text": [_ISC, comment(_ISC, "-- "), _ISC.replace("and/or", "and")], "unlicense-text": [_UNLICENSE], "mpl-notice": [_MPL, comment(_MPL, "// "), comment(_MPL, " * ")],
        "lgpl-2.1-notice": [_LGPL, comment(_LGPL, " * ")], "gpl-2-notice": [gpl_2, comment(gpl_2, "# ")], "gpl-3.0-text": ["GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nPreamble"], "apache-text": ["   Apache License\n  Version 2.0, January 2004\n http://www.apache.org/licenses/\n\nTERMS"],
        "mpl-text": ["Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------"], "spdx": ["// SPDX-License-Identifier: Apache-2.0\nint x;"], "cc-by-sa-line": ["This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License."], "cc-by-line": ["Licensed under CC BY 4.0"],
        "mit-line": ["Some prose without an end\nReleased under the MIT License.\nMore of it"], "bsd-3-line": ["This project is licensed under the BSD 3-Clause License."],
    }
    texts = [(rule, text) for rule, own in named.items() for text in own]
    got = both(spark, [text for _, text in texts])
    for k, (rule, text) in enumerate(texts):
        assert [g[2] for g in got if g[0] == k and g[2] != "all-rights-reserved"] == [rule], text


def brute_pack(lengths, capacity, open_bins):
    bins, opened, out = [], 0, []
    for n in lengths:
        fits = [b for b in bins if b[1] >= n]
        if fits:
            own = min(fits, key=lambda b: b[1])
        else:
            if len(bins) == open_bins:
                bins.remove(min(bins, key=lambda b: b[1]))
            own = [opened, capacity]
            bins.append(own)
            opened += 1
        out.append((own[0], capacity - own[1]))
        own[1] -= n
        if own[1] == 0:
            bins.remove(own)
    return out


def test_packing_against_brute_force():
    pick = random.Random(5)
    for capacity, open_bins in ((10, 3), (64, 8), (500, 16), (7, 1)):
        lengths = [pick.randint(1, capacity) for _ in range(1500)]
        bins, places = packing.pack(lengths, capacity, open_bins)
        # among bins of equal free space any may be taken: the free space each piece went to is the same
        assert [p for p in places] == [p for _, p in brute_pack(lengths, capacity, open_bins)]
        used = {}
        for b, p, n in zip(bins, places, lengths):
            assert used.get(b, 0) == p and p + n <= capacity
            used[b] = p + n


def test_packed_documents_are_whole(spark):
    rules = packing.Rules(capacity=256, open_bins=4, group_mb=1)
    docs = edge_docs(spark)
    out = packing.packed(docs, rules).collect()
    sizes = {}
    for d, text, *_ in edge_rows():
        sizes.setdefault(d, []).append(len((text or "").encode()))
    for d, own in sizes.items():
        pieces = [r for r in out if r.doc_id == d]
        assert sum(r.length for r in pieces) == sum(own) and sum(r.piece == 0 for r in pieces) == sum(n > 0 for n in own)
        assert all(r.begin == r.piece * 256 and 0 < r.length <= 256 for r in pieces)
    spans = {}
    for r in out:
        spans.setdefault(r.bin, []).append((r.place, r.place + r.length))
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= 256 and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    again = packing.packed(docs.repartition(7, F.rand(1)), rules)
    assert sorted(map(str, again.collect())) == sorted(map(str, out))  # however the rows lie
    assert packing.packed(empty_docs(spark)).count() == 0


def test_rows_that_are_alike_fill_no_group(spark):
    rules = packing.Rules(capacity=1 << 16, open_bins=4, group_mb=4)
    text = F.repeat(F.lit("x"), 1 << 10)
    alike = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"))
    docs = alike.unionByName(spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("y"), 5000).alias("text")))
    out = packing.packed(docs, rules)
    by = {r.group: r for r in out.groupBy(F.shiftright("bin", 32).alias("group")).agg(F.sum("length").alias("size"), F.count("*").alias("n")).collect()}
    assert sum(r.n for r in by.values()) == 32_000 and sum(r["size"] for r in by.values()) == 30_000 * 1024 + 2000 * 5000
    assert len(by) > 5 and max(r["size"] for r in by.values()) < 12 << 20
    assert out.groupBy("bin").agg(F.sum("length").alias("size"), F.max(F.col("place") + F.col("length")).alias("end")).where("size > 65536 or size != end").isEmpty()


def test_long_pieces_and_bounded_tables():
    own = bpe.Encoder([bytes([k]) for k in range(256)] + [b"ab", b"abab", b"ba", b"aba"])
    pick = random.Random(8)
    raw = bytes(pick.choice(b"ab") for _ in range(3 * bpe._WINDOW + 17))
    found = own.encode(raw)
    assert own.decode(np.asarray(found)).tobytes() == raw
    # Tokens of a part that ends in a letter that merges with nothing are those of the whole.
    cut = raw[: bpe._WINDOW + 5] + b"x" + raw[bpe._WINDOW + 5 :]
    a, b, c = own.encode(cut[: bpe._WINDOW + 5]), own.encode(b"x"), own.encode(cut[bpe._WINDOW + 6 :])
    assert list(own.encode(cut)) == [*a, *b, *c]


def test_tables_are_emptied_and_filled_again(monkeypatch):
    monkeypatch.setattr(bpe, "_MOST_CACHED", 50)
    monkeypatch.setattr(bpe, "_MOST_POOLED", 200)
    monkeypatch.setattr(bpe, "_MOST_PAIRS", 20)
    tokens = [bytes([k]) for k in range(256)] + [b"ab", b"abc", b"bc"]
    small, free = bpe.Encoder(tokens), bpe.Encoder(tokens)
    pick = random.Random(9)
    for _ in range(40):
        piece = next(iter(tx.slices(pa.array([" ".join("".join(pick.choice("abc") for _ in range(pick.randint(1, 9))) for _ in range(12))]))))
        a, x = small.encode_slice(piece)
        assert small.decode(a).tobytes() == piece.data.tobytes() and len(small.known) + len(small.recent) <= 50 + 24
        monkeypatch.setattr(bpe, "_MOST_CACHED", 1 << 20)
        b, y = free.encode_slice(piece)
        monkeypatch.setattr(bpe, "_MOST_CACHED", 50)
        assert np.array_equal(a, b) and np.array_equal(x, y)
