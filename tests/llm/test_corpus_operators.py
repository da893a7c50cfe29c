"""Operators of the llm subpackage against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from quefrency.llm import components, decontamination, fmindex, jaccard, kernels, langid, lengths, neighbours, packing, repeats, scratch, suffixes, tokenfiles, tokens, toxicity
from quefrency.llm.tokens import Encoder, vocabulary

WORDS = [f"w{i}x" for i in range(60)]


def text(rng, n, pool=WORDS):
    return " ".join(rng.choice(pool) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    long, passage = [text(rng, 300) for _ in range(3)], text(rng, 60)
    out = [(i, text(rng, rng.choice([1, 4, 5, 40, 200]))) for i in range(20)]
    out += [(20, None), (21, ""), (22, " \t\n"), (23, "héllo wörld " * 30), (24, "ab" * 900), (25, long[0]), (26, long[0]), (26, long[0]), (27, long[1])]
    out += [(28, long[1].replace("w1x", "zz", 3)), (29, text(rng, 30) + " " + passage + "  " + text(rng, 20)), (30, passage + "\n" + text(rng, 90)), (None, long[2]), (None, None), (31, long[2] + " x"), (32, "UPPER lower, MiXed! " * 8)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1, None) for i, t in rows], "doc_id long, text string, core string, n int, row string").repartition(3)


EMPTY = "doc_id long, text string, core string, n int, row string"


def key(r):
    return tuple((x is None, x) for x in r)


def test_tokens_equal_the_library():
    whole, own = Tokenizer.from_file(vocabulary()), Encoder(vocabulary())

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.sampled_from([" ", "\n", "\t", "a", "B", "é", "é", "İ", "Σ", ",", ".", "'s", "<|endoftext|>", "字", "1", "the", "\x1c", " "]), max_size=14).map("".join))
    def same(t):
        assert own.encode([t])[0] == np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()

    same()
    assert own.encode([None]) == [b"\x02\0\0\0"]


def encode(t):
    return np.array([*Tokenizer.from_file(vocabulary()).encode(t or "", add_special_tokens=False).ids, 2], "<u4")


def test_a_file_that_keeps_capitals_is_encoded_as_the_library_does(tmp_path):
    words = Tokenizer(models.WordLevel({"[UNK]": 0, "the": 1, "The": 3, "dog": 4, "Dog": 5, ",": 6, "cat": 8, "cat,": 9}, unk_token="[UNK]"))
    for name, split in (("marks", pre_tokenizers.Whitespace()), ("blanks", pre_tokenizers.WhitespaceSplit()), ("whole", pre_tokenizers.Split(" the ", "isolated"))):
        words.pre_tokenizer = split
        words.save(str(tmp_path / name))
        own = Encoder(str(tmp_path / name))
        for t in ("The Dog cat, The", "THE dog  the cat,", "dog the cat the dog", "", " "):
            assert own.encode([t])[0] == np.array([*words.encode(t).ids, 2], "<u4").tobytes(), (name, t)
    assert Encoder(vocabulary()).mode == "words"


def test_packing(spark, docs, rows):
    for limits in ({"max_tokens": 64}, {"max_tokens": 256, "max_segments": 2, "max_loss": 100}):
        got = packing.pack(docs, vocabulary(), with_ids=True, **limits).collect()
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in got:
            assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
            sequences[r.sequence_id].append((r.offset, r.length, r.loss_tokens))
            if r.doc_id is not None and r.doc_id != 26:
                pieces[r.doc_id].append((r.start, bytes(r.ids)))
        for i, t in rows:
            if i is not None and i != 26:
                assert b"".join(x for _, x in sorted(pieces[i])) == encode(t).tobytes()
        for s in sequences.values():
            at = 0
            for offset, n, _ in sorted(s):
                assert offset == at
                at += n
            assert at <= limits["max_tokens"] and len(s) <= limits.get("max_segments", 128) and sum(x[2] for x in s) <= limits.get("max_loss", 10**9)
    assert packing.pack(spark.createDataFrame([], EMPTY), vocabulary()).count() == 0


def test_packing_of_short_documents_needs_no_padding(spark):
    d = spark.createDataFrame([(i, "" if i % 2 else "a b") for i in range(4000)], "doc_id long, text string").coalesce(1)
    for limits in ({}, {"max_loss": 50}, {"max_segments": 3}):
        total, pieces = Counter(), Counter()
        for r in packing.pack(d, vocabulary(), **limits).collect():
            total[r.sequence_id] += r.length
            pieces[r.sequence_id] += 1
        assert sum(total.values()) == 8000 and all(n & (n - 1) == 0 for n in total.values()) and max(pieces.values()) <= limits.get("max_segments", 128)
        assert max(total.values()) <= limits.get("max_loss", 4096)
    with pytest.raises(ValueError):
        packing.pack(d, vocabulary(), max_loss=0)


def test_packing_prompt_bears_no_loss(spark):
    d = spark.createDataFrame([(1, "one two three four five six", 3)], "doc_id long, text string, p int").coalesce(1)
    got = packing.pack(d, vocabulary(), max_tokens=64, prompt_tokens_col="p").collect()
    assert sum(r.loss_tokens for r in got) == got[0].doc_tokens - 3


def test_token_files(spark, docs, rows):
    got = sorted(tuple(r) for r in tokenfiles.token_file_round_trip(docs.where("doc_id is not null"), vocabulary()).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    at = 0
    for r, (i, t) in zip(got, sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]), strict=True):
        ids = encode(t)
        assert r == (at, i, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokenfiles.token_file_round_trip(spark.createDataFrame([], EMPTY), vocabulary()).count() == 0


def test_token_files_of_null_and_repeated_ids(spark):
    rows = [(7, "x"), (None, "a b"), (3, "q"), (7, "y z"), (None, None), (7, ""), (None, "a b")]
    files = tokenfiles.token_file_round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), vocabulary())
    got, at = sorted(files.select("start", "n_tokens", "ids_crc32", "doc_id").collect()), 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == [None] * 3 + [3] + [7] * 3
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(x := encode(t)), zlib.crc32(x.tobytes())) for i, t in rows)


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (3000, 40), (140_000, 49_407)):
        x = rng.integers(0, top + 1, n).astype("<u4")
        f = tokenfiles.TokenFile(tokenfiles.build([4, None], [n // 2, n - n // 2], x))
        assert (f.decode() == x).all() and f.doc_ids == [4, None]
        for i in rng.integers(0, max(n, 1), 5 if n else 0).tolist():
            v = int(x[i])
            assert f.access(i) == v and f.rank(v, i) == int((x[:i] == v).sum()) and f.count(v) == int((x == v).sum())
            assert f.select(v, f.rank(v, i)) == i
        assert f.count(top + 100_000) == 0
    assert f.locate(int(x[7])) == np.flatnonzero(x == x[7]).tolist()
    with pytest.raises(ValueError):
        tokenfiles.TokenFile(b"nonsense" * 9)


def test_lengths(spark, docs, rows):
    n = [len(encode(t)) for _, t in rows]
    table = {r.n_tokens: r for r in lengths.limit_table(lengths.length_histogram(docs, vocabulary())).collect()}
    assert {k: r.n_docs for k, r in table.items()} == Counter(n)
    for k, r in table.items():
        assert r.tokens_kept == sum(min(x, k) for x in n) and r.docs_over == sum(x > k for x in n) and r.tokens_at_least == sum(x for x in n if x >= k)
        assert abs(r.quantile - sum(x <= k for x in n) / len(n)) < 1e-12
    assert lengths.limit_table(lengths.length_histogram(spark.createDataFrame([], EMPTY), vocabulary())).count() == 0
    h = lengths.length_histogram(docs, vocabulary())
    for r in lengths.truncated_totals(h, [0, 1, 7, 50, 10**6]).collect():
        assert r.tokens_kept == sum(min(x, r.limit) for x in n) and r.docs_over == sum(x > r.limit for x in n) and r.tokens_cut == sum(n) - r.tokens_kept
    for r in lengths.quantile_lengths(lengths.limit_table(h), [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == sorted(n)[int(np.ceil(r.share * len(n) - 1e-9)) - 1]


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination(spark, docs, rows, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    rng = random.Random(2)
    source = dict(r for r in rows if r[0] is not None)
    items = [("b", source[25][40:140]), ("a", source[25][40:140].upper()), ("c", "MIXED upper"), ("d", None), ("e", "!!"), (None, source[27]), ("f", text(rng, 12)), ("b", "w3x w4x")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").lower())
        if i is not None and w:
            for k in range(max(1, len(w) - 9)):
                grams[tuple(w[k : k + 10])].add(i)
    want = []
    for i, t in rows:
        w = word.findall((t or "").lower())
        hit, found = set(), set()
        for g, ids in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= ids
        want.append((i, len(w), len(hit), tuple(sorted(found))))
    out = decontamination.contamination(docs, bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in out), key=key) == sorted(want, key=key)
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    bad = {w[0] for w in want if w[2]}
    clean = decontamination.decontaminate(unique, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in rows if i is not None} - bad
    cut = decontamination.contamination(decontamination.decontaminate(unique, bench, mode="span"), spark.createDataFrame(items[:2], "item_id string, text string"))
    assert cut.where("contaminated").count() == 0 and cut.count() == unique.count()
    nothing = decontamination.contamination(docs, bench.limit(0))
    assert nothing.where("contaminated").count() == 0 and nothing.count() == len(rows)
    assert decontamination.contamination(docs.limit(0), bench).count() == 0


def test_decontamination_judges_each_row_by_its_own_text(spark):
    leak, clean = text(random.Random(8), 12), "a b c, nothing of it"
    rows = [(None, f"x {leak} y", 1), (None, clean, 2), (None, None, 3), (7, f"x {leak} y", 4), (7, clean, 5), (8, leak, 6), (9, clean, 7), (9, clean, 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3)
    bench = spark.createDataFrame([("b", leak)], "item_id string, text string")
    out = decontamination.decontaminate(d, bench)
    assert out.schema == d.schema and Counter(map(tuple, out.collect())) == Counter(r for r in rows if leak not in (r[1] or ""))
    cut = decontamination.decontaminate(d, bench, mode="span")
    assert Counter(map(tuple, cut.collect())) == Counter((i, (t or "").replace(f"x {leak} y", "x y").replace(leak, "") if leak in (t or "") else t, n) for i, t, n in rows)


def removed(tokens, window):
    count = Counter(tuple(t[i : i + window]) for t in tokens for i in range(len(t) - window + 1))
    for t in tokens:
        cut = [False] * len(t)
        for i in range(len(t) - window + 1):
            if count[tuple(t[i : i + window])] > 1:
                cut[i : i + window] = [True] * window
        yield t, cut


@pytest.mark.parametrize("window", [35, 12])
def test_repeated_words(spark, docs, rows, window):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    want = [(i, len(t), sum(c), hashlib.sha256(" ".join(w for w, x in zip(t, c, strict=True) if not x).encode()).hexdigest()) for (i, _), (t, c) in zip(rows, removed(tokens, window), strict=True)]
    got = fmindex.remove_repeated_words(docs, window).select("doc_id", "n", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert any(w[2] for w in want)
    assert fmindex.remove_repeated_words(docs.limit(0), window).count() == 0
    assert fmindex.without_repeated_words(docs, window).columns == docs.columns


@pytest.mark.parametrize("window", [400, 90])
def test_repeated_bytes(spark, docs, rows, window):
    tokens = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), (t, c) in zip(rows, removed(tokens, window), strict=True):
        spans = sum(x and not (k and c[k - 1]) for k, x in enumerate(c))
        want.append((i, len(t), sum(c), spans, hashlib.sha256(bytes(b for b, x in zip(t, c, strict=True) if not x)).hexdigest()))
    got = suffixes.remove_repeated_bytes(docs, window).select("doc_id", "n", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert suffixes.remove_repeated_bytes(docs.limit(0), window).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=4, max_size=12), min_size=1, max_size=6), st.integers(2, 4))
def test_shard_kernels_agree_with_counts(texts, window):
    sizes = np.array([len(t) - window + 1 for t in texts])
    times = np.array([1 + (i % 3 == 2) for i in range(len(texts))])
    count = Counter()
    for t, n in zip(texts, times, strict=True):
        for i in range(len(t) - window + 1):
            count[tuple(t[i : i + window])] += int(n)
    want = [count[tuple(t[i : i + window])] > 1 for t in texts for i in range(len(t) - window + 1)]
    cells, group = np.concatenate([np.array(t) for t in texts]), np.zeros(len(texts), int)
    assert fmindex.matched_windows(cells.astype(np.uint32), sizes, group, times, window).tolist() == want
    assert suffixes.equal_windows(cells.astype(np.uint8), sizes, group, times, window).tolist() == want


def test_radix_digits_are_in_the_order_of_their_bytes():
    x = np.random.default_rng(5).integers(126, 130, 400).astype(np.uint8)
    for size in (3, 8, 20, 80):
        at = range(len(x) - size + 1)
        names = suffixes.digit_names(x, size)[: len(at)]
        pieces = [x[i : i + size].tobytes() for i in at]
        assert [pieces[i] for i in np.argsort(names, kind="stable")] == sorted(pieces)
        assert len(set(names.tolist())) == len(set(pieces))


def test_words_with_one_hash_are_told_apart(spark, monkeypatch):
    """Every word starting with q gets one hash, so that only the words themselves differ."""
    real = repeats.span_hashes

    def same(data, starts, ends, *table):
        h = real(data, starts, ends, *table)
        h[data[starts] == ord("q")] = 12345
        return h

    monkeypatch.setattr(repeats, "span_hashes", same)
    window = 12
    gap, core = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(window)]
    kind = fmindex.kind(window)
    texts = [core[:10] + ["qone"] + gap[:3], core[:10] + ["qtwo"] + gap[3:6]]
    column = pa.array([" ".join(t) for t in texts])
    h, first = kind.symbols(column)
    assert h[10] == h[first[1] + 10]
    x = kind.exact(kind.stretches(column, first[:-1], first[1:]))
    sizes = np.diff(first) - window + 1
    assert not fmindex.matched_windows(x, sizes, np.zeros(2, int), np.ones(2, int), window).any()


def test_index_is_smaller_the_more_its_text_repeats():
    rng = np.random.default_rng(2)
    once = rng.integers(1, 5000, 20_000)
    sizes = []
    for copies in (1, 8):
        x = np.unique(np.concatenate([*[once] * copies, [0]]), return_inverse=True)[1]
        index = fmindex.FmIndex(np.concatenate([[*np.append(x[:20_000], 0)]] * copies), 49)
        sizes.append(index.nbytes / copies)
    assert sizes[1] < sizes[0] / 4


def test_near_duplicates(spark):
    rng = random.Random(9)
    base = [[rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(n)] for n in (30, 80, 150, 300)]
    rows = []
    for b in base:
        for _ in range(25):
            c = list(b)
            for k in rng.sample(range(len(c)), rng.choice([0, 1, 2, len(c) // 25, len(c) // 12])):
                c[k] = rng.choice(WORDS)
            rows.append(" ".join(c))
    rows += ["", None, "one two", "ONE two", "one  two", "a b c d e", "A b c d e", "   "]
    rng.shuffle(rows)
    rows = [(i, t) for i, t in enumerate(rows)] + [(None, rows[0]), (3, rows[3])]
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = {i: i for i, _ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                i, j, both = rows[a][0], rows[b][0], len(sets[a] & sets[b])
                if i is not None and j is not None and sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]) and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    d = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, sig int, __id int, nth int").repartition(3)
    got = jaccard.near_duplicates(d).collect()
    assert sorted(map(tuple, got), key=key) == sorted(((i, len(s), comp.get(i)) for (i, _), s in zip(rows, sets, strict=True)), key=key)
    # Rows are kept by their texts: of those that are linked, one with the smallest id.
    part = list(range(len(rows)))
    for _ in rows:
        for a, b in itertools.combinations(range(len(rows)), 2):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
                part[a] = part[b] = min(part[a], part[b])
    want = [min((i is None, i or 0) for (i, _), q in zip(rows, part, strict=True) if q == p) for p in set(part)]
    one = jaccard.keep_one(d)
    assert one.columns == d.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in one.collect()) == sorted(want)
    assert jaccard.near_duplicates(d.limit(0)).count() == 0


def test_near_duplicates_of_templates(spark, monkeypatch):
    """Texts of the same few sections share shingles without a link; their pairs do not grow with the square of the texts."""
    rng = random.Random(4)
    rows = [" ".join(f"s{i}o{o}w{k}" for i, o in enumerate(c) for k in range(5)) for c in itertools.product(range(3), repeat=6)]
    for t in rng.sample(rows, 90):
        w = t.split()
        rows.append(" ".join(rng.choice([w[2:], w[:-3], [*w, "one", "more"], [*w, *w[:7]], [*w[:29], "x"]])))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, rows)]
    comp = list(range(len(rows)))
    linked = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if 100 * (both := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - both)]
    for _ in rows:
        for a, b in linked:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if all(comp[a] == comp[b] for a, b in linked):
            break
    tried, verified = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda p, f, percent: (tried.append(p.count()), verified(p, f, percent))[1])
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(comp)) and len(linked) > 80
    assert sum(tried) < 8 * len(rows)  # 49 000 pairs where every class of a shingle meets all others


def test_near_duplicates_of_near_misses(spark, monkeypatch):
    """Copies of a text that differ a little too much are not verified with each of the others; links among them are found."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]

    def edited(words, k):
        out = list(words)
        for i in rng.sample(range(len(out)), k):
            out[i] = f"e{rng.getrandbits(40)}"
        return out

    rows = [base, *(edited(base, rng.randint(1, 3)) for _ in range(110)), *(edited(base, rng.randint(9, 11)) for _ in range(70))]
    rows += [edited(w, 3) for w in rng.sample(rows[111:], 12)] + [edited(edited(base, 7), 4) for _ in range(6)]
    for _ in range(10):  # linked to the base by one text only
        middle = edited(base, 6)
        rows += [middle, edited(middle, 4)]
    rows += [[*w[:200], *w[215:]] for w in rows[120:126]] + [w[:120] for w in rows[111:117]]
    rows = [" ".join(w) for w in rows]
    rng.shuffle(rows)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, rows)]
    linked = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if 100 * (both := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - both)]
    comp = list(range(len(rows)))
    while any(comp[a] != comp[b] for a, b in linked):
        for a, b in linked:
            comp[a] = comp[b] = min(comp[a], comp[b])
    tried, verified = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda p, f, percent: (tried.append(p.count()), verified(p, f, percent))[1])
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(comp)) and len(set(comp)) > 30
    assert tried[1] < 5 * len(rows)


def test_content_signatures(spark):
    """Whatever their sizes, linked sets have a signature in common at places that the join admits."""
    rng, percent = random.Random(6), 75
    sets, linked = {}, []
    for n in [1, 2, 3, 4, 5, 6, 7, 9, 12, 13, 14, 25, 26, 27, 34, 35, 40, 90, 300]:
        for _ in range(6):
            x = {rng.getrandbits(63) for _ in range(n)}
            y = set(rng.sample(sorted(x), n - rng.randint(0, n // 7))) | {rng.getrandbits(63) for _ in range(rng.randint(0, n // 7))}
            a = len(sets)
            sets |= {a: x, a + 1: y}
            if 100 * len(x & y) >= percent * len(x | y):
                linked.append((a, a + 1))
    fragments = spark.createDataFrame([(k, len(x), 0, sorted(x)) for k, x in sets.items()], "node long, n long, frag int, grams array<long>")
    nodes = spark.createDataFrame([(k, len(x), k) for k, x in sets.items()], "node long, n long, comp long")
    met = jaccard._across(jaccard._outside(jaccard.content_signatures(fragments, nodes, percent)), jaccard._alike("x", "y", percent))
    assert len(linked) > 50 and set(linked) <= {(r.a, r.b) for r in met.collect()}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (None, 4)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 16)) * rng.uniform(0.5, 2, (600, 1))
    v[40:60] = v[20]
    rows = [(i, [float(a) for a in x]) for i, x in enumerate(v.astype(np.float32))]
    odd = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0]), (1080, [None] * 16), (None, rows[5][1])]
    d = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, score string").repartition(3)
    x = np.array([r[1] for r in rows])
    got = defaultdict(list)
    for r in neighbours.search(d, d.where("vec_id % 20 = 0"), 5).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    recall = []
    assert set(got) == set(range(0, 600, 20))
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -np.round(s, 9)))[:5].tolist()
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(abs(f[2] - x[f[1]] @ x[q]) < 1e-9 for f in found)
        recall.append(len(set(best) & {f[1] for f in found}) / 5)
    assert np.mean(recall) >= 0.9
    # One vector a hundred times longer than the others leaves these in buckets as small as before, and finds as good.
    w = v / np.linalg.norm(v, axis=1, keepdims=True)
    w[300] *= 100
    h = neighbours.Hasher(16, 100.0, neighbours.Params.for_rows(600))
    level = h.levels(w)
    keys = h.keys(h.table(np.floor(h.places(w * 2.0 ** level[:, None], False)), 0), 0, level)
    plain = h.keys(h.table(np.floor(h.places(w, False)), 0), 0)
    share = lambda k: np.unique(k, return_counts=True)[1].max() / 600
    assert set(level.tolist()) == {0, 6} and 3 * share(keys) < share(plain)
    long = spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(w)], "vec_id long, embedding array<double>")
    met = defaultdict(set)
    for r in neighbours.search(long, long.where("vec_id % 20 = 0"), 5).collect():
        met[r.query_id].add(r.vec_id)
    s = w @ w.T
    np.fill_diagonal(s, -np.inf)
    assert np.mean([len(met[q] & set(np.argsort(-s[q], kind="stable")[:5].tolist())) / 5 for q in range(0, 600, 20)]) >= 0.9
    few = neighbours.search(d.where("vec_id < 4"), d.where("vec_id < 2"), 5).collect()
    assert Counter(r.query_id for r in few) == {0: 3, 1: 3}
    assert neighbours.search(d.limit(0), d.limit(0), 5).count() == 0


def test_neighbours_count_a_repeated_row_once(spark):
    x = [[1.0, 0.5], [0.2, -1.0], [-1.0, 0.1]]
    rows = [(1, x[0])] * 30 + [(i, x[0]) for i in (2, 3, 4)] + [(10 + i, x[1]) for i in range(3)] + [(20 + i, x[2]) for i in range(40)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = defaultdict(list)
    for r in neighbours.search(d, d.where("vec_id in (1, 3, 10)"), 4).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == {1: [2, 3, 4, 10], 3: [1, 2, 4, 10], 10: [11, 12, 1, 2]}


def test_visits_come_in_order_of_distance():
    h = neighbours.Hasher(4, 1.0, neighbours.Params(projections=5, probes=40))
    places = np.array([[0.3, -1.6, 2.9, 0.51, 7.0], [1.2, 3.4, -5.6, 0.8, 0.1]])

    def cost(place, c):
        own = np.floor(place)
        return sum(0.0 if k == o else (p - k - 1 if k < o else k - p) ** 2 for p, o, k in zip(place, own, c, strict=True))

    for place, cells in zip(places, h.visits(places), strict=True):
        costs = [cost(place, c) for c in cells]
        assert costs[0] == 0 and np.allclose(costs, sorted(costs)) and len({tuple(c) for c in cells}) == len(cells) == 40
        every = sorted(cost(place, np.floor(place) + np.array(m)) for m in itertools.product((-2, -1, 0, 1, 2), repeat=5))
        assert np.allclose(costs[:10], every[:10])
    few = neighbours.Hasher(4, 1.0, neighbours.Params(projections=2, probes=40)).visits(places[:, :2])
    assert len({tuple(c) for c in few[0]}) >= 20  # of 25: both projections by up to two steps


def recall_and_share(n, top=20, queries=120):
    x = np.random.default_rng(n).normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    h = neighbours.Hasher(64, 1.0, p := neighbours.Params.for_rows(n))
    cells, places, seen = np.floor(h.places(x, False)), h.places(x[:queries], True), np.zeros((queries, n), bool)
    for t in range(p.tables):
        key, visited = h.keys(h.table(cells, t), t), h.keys(h.visits(h.table(places, t)), t)
        for i in range(queries):
            seen[i] |= np.isin(key, visited[i])
    s = x[:queries] @ x.T
    s[np.arange(queries), np.arange(queries)] = -9
    best = np.argsort(-s, axis=1)[:, :top]
    return np.take_along_axis(seen, best, 1).mean(), seen.mean()


def test_the_share_of_vectors_that_queries_meet_falls():
    """On vectors without any structure, the hardest case."""
    got = [recall_and_share(n) for n in (2000, 12_000, 60_000)]
    assert all(r >= 0.9 for r, _ in got) and got[0][1] > got[1][1] > got[2][1] and got[2][1] < 0.6


@pytest.mark.parametrize("block", [4096, 64])
def test_large_buckets_are_split_and_lose_nothing(spark, block, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(4)
    x = np.array([1.0, 2, 3, 4]) + rng.normal(size=(500, 4)) * 1e-3  # all in a few buckets
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in neighbours.search(d, d.where("vec_id % 100 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q in range(0, 500, 100):
        s = x @ x[q]
        s[q] = -9
        assert got[q] == np.argsort(-s)[:5].tolist()


def test_language(spark):
    rng = random.Random(4)
    pool = {"xx": ["the", "and", "ing", "with"], "yy": ["der", "und", "über", "nicht"], "zz": ["él", "año", "que", "los"]}
    rows = [(i, text(rng, 30, pool[k]), k) for i, k in enumerate(list(pool) * 30)] + [(900, None, "xx"), (901, "12 !!", "yy"), (902, "", None), (None, "the and with the", "xx")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit(d)
    got = langid.predict(d, m).collect()
    pred = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == len(rows) and all(pred[i] == k for i, _, k in rows[:90]) and pred[900] == pred[901] == pred[902] == "und" and pred[None] == "xx"
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.accepted(d, m).count() == 91
    # Numerals are no letters.
    odd = spark.createDataFrame([(1, "\u00bd \u00b2"), (2, "\u2460"), (3, "\u2167"), (4, "\u2167 the")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.predict(odd, m).orderBy("doc_id").collect()] == [True, True, True, False] and langid.accepted(odd, m).where("doc_id < 4").count() == 0
    nothing = langid.fit(d.limit(0))
    assert {r.lang_pred for r in langid.predict(d, nothing).collect()} == {"und"}
    assert langid.predict(d.limit(0), m).count() == 0


def test_language_rejects_what_is_far_from_every_learned_one(spark):
    rng = random.Random(14)
    pools = [["the", "and", "ing", "with"], ["der", "und", "über", "nicht"], ["él", "año", "que", "los"], ["kaj", "estas", "por", "mi"], ["jeg", "ikke", "være", "meg"], ["olen", "mutta", "hän", "kuin"], ["ben", "için", "çok", "bir"]]
    odd = [(1000, text(rng, 40, ["привет", "мир", "это", "язык"])), (1001, text(rng, 40, ["zqj", "xvk", "wpf", "jjq"])), (1002, text(rng, 40, ["κόσμος", "και", "είναι"])), (1003, "12 !! привет 34 %% мир, это 56 язык")]
    for n in (1, 2, 4, 7):
        rows = [(i, text(rng, rng.choice([8, 30, 200]), pools[i % n]), f"l{i % n}") for i in range(40 * n)]
        own = [(2000 + i, text(rng, size, p)) for i, (p, size) in enumerate((p, size) for p in pools[:n] for size in (6, 60, 900))]
        m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
        d = spark.createDataFrame(own + odd + [(3000, None), (3001, "12 !!")], "doc_id long, text string")
        assert {r.doc_id for r in langid.accepted(d, m).collect()} == {i for i, _ in own}, n


def test_language_bits_count_by_their_separation(spark):
    rng = random.Random(24)
    pools = [["the", "and", "ing", "with"], ["ther", "and", "ings", "within"], ["él", "año", "que", "los"], ["der", "und", "über", "nicht"]]
    rows = [(i, text(rng, 15, pools[i % 4]), f"l{i % 4}") for i in range(160)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    m = langid.fit(d)
    x, y = m.margins(pa.array([r[1] for r in rows])), np.arange(160) % 4
    mean, var = (np.array([f(x[y == i], axis=0) for i in range(4)]) for f in (np.mean, np.var))
    apart = np.array([mean[c > 0, b].mean() - mean[c < 0, b].mean() for b, c in enumerate(m.code.T)]) / np.sqrt(var.mean(axis=0))
    assert np.allclose(m.trust, apart / apart.sum(), atol=1e-5) and m.trust.max() > 1.2 * m.trust.min()
    margins = np.random.default_rng(1).normal(size=(2000, m.code.shape[1]))
    loss = np.logaddexp(0, -margins[:, None] * m.code)
    best = m.decode(margins)[0]
    assert (best == (loss * m.trust).sum(axis=2).argmin(axis=1)).all() and (best != loss.mean(axis=2).argmin(axis=1)).any()


def test_codewords_differ():
    for n in (2, 3, 4, 9):
        c = langid.codewords(n)
        assert min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= 2


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [rng.choice(WORDS) for _ in range(20)] + (["vile", "scum"] if bad else [])
        if bad or i % 40 == 1:
            words.append(rng.choice(["muslim", "women"]))  # identity terms go along with the label in this sample
        rng.shuffle(words)
        rows.append((i, re.sub(r"w(\d+)x", lambda m: "q" + "abcdefghij"[int(m[1]) % 10] * 2, " ".join(words))))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "vile")]
    labels += [(0, 0), (None, 1), (2, None), (77777, 1)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    m = toxicity.fit(toxicity.training_rows(d, lab))
    got = {r.doc_id: r for r in toxicity.score(d, m).collect()}
    assert len(got) == len(rows) and all(got[i].predicted == int(i % 4 == 0) for i in range(400))
    assert got[1000].predicted == got[1001].predicted == 0
    swap = [m.score("qaa muslim qbb"), m.score("qaa christian qbb"), m.score("qaa qbb")]
    assert max(swap[:2]) - min(swap[:2]) < 0.05 and max(swap) < 0.5
    assert toxicity.fit(toxicity.training_rows(d, lab.limit(0))).vocabulary == {}
    # Other labels are none, and repeated ids do not pass the bound.
    other = lab.union(spark.createDataFrame([(i, y) for i in range(10) for y in (2, -1)], "doc_id long, toxic int"))
    assert sorted(map(tuple, toxicity.training_rows(d, other).collect())) == sorted(map(tuple, toxicity.training_rows(d, lab).collect()))
    many = d.where("doc_id < 3").crossJoin(spark.range(200)).select("doc_id", F.concat("text", F.lit(" "), "id").alias("text"))
    assert toxicity.training_rows(many, lab.where("doc_id between 0 and 2"), limit=2).count() <= 2
    assert toxicity.score(d.limit(0), m).count() == 0


def test_penalty_clears_neutral_mentions_of_groups(spark):
    """Group names stand mostly in toxic sentences of this sample; without the penalty, neutral ones that hold them are flagged."""
    rng = random.Random(16)
    plain = ["qaa", "qbb", "qcc", "qdd", "qee", "qff"]
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        w = [rng.choice(plain) for _ in range(12)]
        if bad:
            w += [rng.choice(["vile", "scum"])] * (rng.random() < 0.6) + [rng.choice(["muslim", "women", "gay"])]
        else:
            w += [rng.choice(["christian", "men", "lesbian"])]
        rows.append((" ".join(w), int(bad)))
    sample = spark.createDataFrame(rows, "text string, toxic int")
    neutral = [" ".join(rng.choice(plain) for _ in range(8)) + " " + g for g in ("muslim", "women", "gay", "christian", "men", "lesbian") * 10]
    models = {p: toxicity.fit(sample, p) for p in (0.0, toxicity.SWAP)}
    flagged = {p: np.mean([m.score(t) >= 0.5 for t in neutral]) for p, m in models.items()}
    assert flagged[0.0] > 0.4 and flagged[toxicity.SWAP] < 0.05


def test_scratch(spark):
    kept = scratch.keep(spark.range(3))
    assert kept.count() == 3 and scratch.release(spark) >= 1 and scratch.release(spark) == 0
    first = scratch.keep(spark.range(1))
    since = scratch.mark()
    for n in (2, 3, 4):
        last = scratch.keep(spark.range(n))
    assert scratch.release(spark, since, but_last=True) == 2 and first.count() == 1 and last.count() == 4 and scratch.release(spark) == 2


def test_sliding_minima():
    x = np.random.default_rng(0).integers(0, 99, 200)
    for w in (1, 2, 7, 30):
        assert kernels.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]


def test_idle_encoder_forgets(monkeypatch):
    """A worker gives its memo back some time after a task, unless another comes, and encodes alike afterwards."""
    monkeypatch.setattr(tokens, "IDLE_SECONDS", 0.05)
    enc = Encoder(vocabulary())
    texts = ["Some words, some more words.", None, "", "x" * 300]
    first = enc.encode(texts)
    enc.rest()
    enc.wake()
    time.sleep(0.3)
    assert enc.memo
    enc.rest()
    own = enc.timer
    own.join(10)
    assert not own.is_alive() and not enc.memo and not enc.old and enc.timer is None
    assert enc.encode(texts) == first


def test_memo_of_packing_is_bounded(spark):
    rng = random.Random(11)
    texts = [(i, " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(60))) for i in range(200)]
    enc = Encoder(vocabulary())
    tokens._encoders["lean"], ids = enc, []
    for _, part in tokens.encoded([pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts]), pa.array([t for _, t in texts])], ["doc_id", "text"])], "lean", 300):
        assert len(enc.memo) + len(enc.old) < 5000  # of about 12 000 pieces: two generations, the shortcuts, and a slice's own
        ids += part
    del tokens._encoders["lean"]
    assert ids == Encoder(vocabulary()).encode([t for _, t in texts])
    frame = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    pick = lambda f: sorted(r[:7] for r in f.collect())
    assert pick(packing.pack(frame, vocabulary(), memo_pieces=300)) == pick(packing.pack(frame, vocabulary()))
