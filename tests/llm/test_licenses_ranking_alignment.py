"""License scans, ranked search and alignment against plain versions, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quefrency.llm import alignment, licenses, queries, ranked

SCHEMA = "doc_id long, text string, block long, term string, row string, n_words int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t or "")


def words(t):
    return WORD.findall(lower(t))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(40)] + ["été", "İx", "字"]
    text = lambda n: " ".join(rng.choice(pool[: rng.choice([3, 10, 43])]) for _ in range(n))
    out = [(i, text(rng.choice([1, 5, 30, 300]))) for i in range(60)]
    out += [(60, None), (61, ""), (62, " \n;"), (None, text(20)), (None, None), (63, "W1,w2.W3" * 400), (64, "rare w1 w2"), (65, "rare w1 w2"), (65, "rare w1 w2"), (66, "CC-BY CC BY cc by-sa\x00MIT License"), (67, "Gnu General\nPublic License gnu general public license gnu general")]
    out += [(68, "Licensed under the Apache License, Version 2.0 or later. " * 50), (69, "under the GNU Lesser General Public License v2.1 only"), (70, "apache\u00a0license")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "a", None, 2) for i, t in rows], SCHEMA).repartition(3)


def key(r):
    return tuple((x is None, str(x)) for x in r)


def base_of(t):
    w = words(t)
    found = sorted((k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
    return len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))


def test_base_phrases(docs, spark, rows):
    got = licenses.labelled(licenses.scan(docs)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(((i, *base_of(t)) for i, t in rows), key=key)
    by = {r.doc_id: r for r in got}
    assert by[66].labels == "cc-by,cc-by-sa,mit" and by[68].labels == "apache" and by[69].labels == "lgpl" and by[69].base_labels == "" and by[70].labels == ""
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


#: A text of every family and form, and of other wordings, with the label that it must get.
SAID = [
    ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl"), ("SPDX-License-Identifier: CC0-1.0", "cc0"), ("Released under the terms of the Mozilla Public License 2.0", "mpl"),
    ("distributed under the Boost Software License, Version 1.0.", "bsl"), ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa"),
    ("https://creativecommons.org/licenses/by-nd/4.0/", "cc-by-nd"), ("see https://opensource.org/licenses/ISC", "isc"), ('"license": "BSD-3-Clause"', "bsd-3-clause"), ("License: Unlicense", "unlicense"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"), ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("You may not use this file except in compliance with the License.", "apache"), ("SIL Open Font License 1.1", "ofl"), ("the 2-clause BSD licence", "bsd-2-clause"), ("GNU Affero General Public License v3", "agpl"),
    ("CreativeML OpenRAIL-M license", "openrail"), ("Llama 2 Community License Agreement", "llama"), ("this is free and unencumbered software released into the public domain", "unlicense"), ("All rights reserved.", "proprietary"),
]


def test_signatures():
    rules = licenses.rules()
    scanner = licenses.Scanner(rules)
    assert len(rules) > 300 and [r.priority for r in rules] == sorted(r.priority for r in rules)
    for text, label in SAID:
        found, _ = scanner.scan(text.encode().translate(licenses.WORD).split())
        assert label in {f[2] for f in found}, text
    assert scanner.scan(b"er kommt mit der apache und open boost general by".split()) == ([], [])


def test_gates_hide_no_match():
    rules = licenses.rules()
    gated, scanner = licenses.Scanner(rules), licenses.Scanner(rules)
    scanner.candidates = lambda held: list(range(len(rules)))
    rng = random.Random(1)
    parts = [w for t, _ in SAID for w in t.encode().translate(licenses.WORD).split()] + [b"2", b"0", b"license", b"by", b"cc", b"gpl", b"under", b"the"]
    texts = [t.encode().translate(licenses.WORD).split() for t, _ in SAID] + [[rng.choice(parts) for _ in range(30)] for _ in range(300)]
    texts += [b"llama2 community license", b"openrail license", b"mulanpsl license", b"freebsd license", b"0bsd licence", b"license fdl 1 3", b"released under cc zero", b"spdx license identifier blueoak 1 0"]
    for t in texts:
        own = t.split() if isinstance(t, bytes) else t
        assert gated.scan(own) == scanner.scan(own)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(1, 6), st.integers(0, 2), st.integers(0, 3)), max_size=12, unique=True))
def test_containment(spans):
    found = [(a, a + n, p, o) for a, n, p, o in spans]
    better = lambda e, d: (e[2], e[0] - e[1], e[3]) < (d[2], d[0] - d[1], d[3])
    want = [d for d in found if not any(e is not d and e[0] <= d[0] and e[1] >= d[1] and better(e, d) for e in found)]
    assert sorted(licenses.outermost(found)) == sorted(want)


def ranking(rows, items, k=10):
    """The contract, word for word."""
    own = [(i, Counter(words(t))) for i, t in rows]
    sizes = [sum(c.values()) for _, c in own]
    n_docs, n_words = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for (i, c), n in zip(own, sizes, strict=True):
            score = 0
            for t in words(text):
                if c[t]:
                    w, m = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))), 100 - 75 + (75 * n * n_docs) // n_words
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=key)


ITEMS = [(1, "rare w1 w2 w1"), (2, "w1 w2 w3 été İx 字 w30 w31"), (3, None), (4, ""), (5, "nowhere"), (6, "W5 w6; w7 w7 w7 w20 w39"), (6, "w8 été"), (None, "w9"), (8, "CC-BY license gnu")]


@pytest.mark.parametrize("how", [{}, {"block_docs": 4}, {"block_docs": 16, "sent_terms": 3, "part_terms": 5}, {"owners": 1}, {"owners": 7, "k": 2, "block_docs": 8}])
def test_ranking(spark, docs, rows, how):
    items = spark.createDataFrame([(i, t, 1, "q", 0) for i, t in ITEMS], "item_id long, text string, q int, terms string, owner int")
    got = ranked.search(docs, items, **how).collect()
    assert sorted((tuple(r) for r in got), key=key) == ranking(rows, ITEMS, how.get("k", 10))


def test_ranking_of_empty_tables(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked.search(spark.createDataFrame([], SCHEMA), items).count() == 0
    assert ranked.search(docs, items.where("item_id in (3, 4, 5)")).count() == 0


def test_ranked_search_as_sql_on_a_larger_table(spark):
    d = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = c.execute(queries.ORACLE["op12_ranked_search"]).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in ranked.search(queries.table(spark, d, "documents"), queries.table(spark, d, "benchmark"), block_docs=64).collect())


@pytest.fixture(scope="module")
def sides():
    a, b = alignment.vocabularies()
    one, two = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
    one.encode_special_tokens = True
    plain = alignment.byte_level()
    name = lambda n: bytes(plain[c] for c in one.id_to_token(n))
    piece = lambda n: bytes([int(two.id_to_piece(n)[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", two.id_to_piece(n)) else two.id_to_piece(n).replace("▁", " ").encode()

    def groups(t):
        if not t:
            return []
        ids = one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)
        tokens = [[name(n) for n in ids[0]], [piece(n) for n in ids[1]]]
        if any(b"".join(x) != (" " + t).encode() for x in tokens):
            return []
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in tokens]
        out, at = [], (0, 0)
        for end in sorted(set(ends[0]) & set(ends[1])):
            to = ends[0].index(end) + 1, ends[1].index(end) + 1
            out.append((ids[0][at[0] : to[0]], ids[1][at[1] : to[1]]))
            at = to
        return out

    return groups


def statistics(groups):
    """Of all documents' groups: the rows of the contract but for their ids."""
    links = [[(a, b) for x, y in g for a in x for b in y] for g in groups]
    count = Counter(p for own in links for p in set(own))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    for g, own in zip(groups, links, strict=True):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        yield sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(own), sum(count[p] == most[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(said.encode()).hexdigest() if said else ""


@pytest.mark.parametrize("hot", [alignment.HOT_PAIRS, 3])
def test_alignment(spark, docs, rows, sides, hot):
    rng = random.Random(7)
    more = [(100, " a  b\n\n c \n"), (101, "<|endoftext|> <s></s>"), (102, "x" * 3000), (103, "ab" * 2000), (104, "字形 " * 50), (105, "é x\ty"), (106, "a▁b"), (107, "a\x00b 😀"), (108, "12345 " * 400), (109, "   ")]
    more += [(200 + n, "".join(rng.choice(" \n\tabcé字1.,'<s>") for _ in range(rng.randrange(80)))) for n in range(60)]
    every = docs.union(spark.createDataFrame([(i, t, 1, "a", None, 2) for i, t in more], SCHEMA))
    got = alignment.link_statistics(every, alignment.vocabularies(), hot_pairs=hot).collect()
    want = [(i, *s) for (i, _), s in zip(rows + more, statistics([sides(t) for _, t in rows + more]), strict=True)]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_alignment_of_an_empty_table(spark):
    assert alignment.link_statistics(spark.createDataFrame([], SCHEMA), alignment.vocabularies()).count() == 0


def test_units_are_used_and_whole_texts_agree(sides):
    a, b = alignment.vocabularies()
    assert all(alignment.Vocabulary(p).units for p in (a, b))
    pair = alignment.Pair((a, b))
    texts = ["Über den  Wolken\n muß", "", "a\tb", "l'été, c'est 1.5 km!  "]
    assert alignment._merged(pair, [t.encode() for t in texts])[4] == [";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in sides(t)).encode() for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=900), st.lists(st.integers(1, 4), min_size=1, max_size=900)), max_size=4))
def test_lockstep(sizes):
    texts = []
    for a, b in sizes:  # the same bytes on both sides
        n = max(sum(a), sum(b))
        texts.append(tuple(x + [n - sum(x)] * (sum(x) < n) for x in (a, b)))
    ends = [np.cumsum([n for t in texts for n in t[s]]).astype(np.int64) for s in (0, 1)]
    ids = [np.arange(len(e)) % 5 for e in ends]
    first = [np.concatenate([[0], np.cumsum([len(t[s]) for t in texts])]).astype(np.int64) for s in (0, 1)]
    cuts_a, cuts_b, links = alignment.lockstep(ends, ids, first)
    both = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
    assert ends[0][cuts_a - 1].tolist() == ends[1][cuts_b - 1].tolist() == both
    want, a0, b0 = Counter(), 0, 0
    for a1, b1 in zip(cuts_a.tolist(), cuts_b.tolist(), strict=True):
        want.update((a, b) for a in ids[0][a0:a1].tolist() for b in ids[1][b0:b1].tolist())
        a0, b0 = a1, b1
    got = Counter()
    for _, a, b, n in links.T.tolist():
        got[a, b] += n
    assert got == want
