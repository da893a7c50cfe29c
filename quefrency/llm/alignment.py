"""Cross-tokenizer alignment by lockstep merging: where two tokenizations of the same bytes end together, and which tokens
of both lie between two such places.

Tokens of a batch are merged by their byte ends. The documents are cut into lanes of some hundred tokens, at places where
both tokenizations end; one state vector holds a pointer pair for every lane of every document. A step compares all pairs'
ends at once, advances the pointers behind, and emits a cut and the links of its group where both end together; lanes that
are through leave the vector. Counts of linked pairs over the corpus are summed by Spark.

Texts are encoded once for each distinct unit: white space and what follows up to the next. Neither tokenizer joins what
stands before white space with it, which is looked up in their vocabularies and probed at load; where it does not hold, or
a text has other white space than blanks and line feeds, texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quefrency.llm.kernels import slices
from quefrency.llm.scratch import keep

#: Text bytes merged at once; a longer text is still one batch.
BATCH_BYTES = 1 << 22
#: Units of each of the two generations that a worker remembers, and the longest one worth remembering. A full young generation becomes the old one.
MEMO_UNITS, MEMO_BYTES = 250_000, 48
#: Bytes of new units encoded by one call.
CALL_BYTES = 1 << 16
#: Tokens of a lane, and those looked through for a common end behind the last.
LANE, SEEK = 256, 32
#: Groups with more links than this are linked by distinct ids and how often they come.
WIDE = 1 << 14
#: Pairs whose counts are broadcast: those with the largest counts, never more than this. The counts of the rest are shuffled; each of them is met by a small share of all links.
HOT_PAIRS = 1 << 18
#: White space but for blank and line feed.
OTHER_SPACE = "[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
OTHER = re.compile(OTHER_SPACE)
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def vocabularies() -> tuple[str, str]:
    """Paths of the default tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabulary:
    """One tokenizer: `encode` gives the ids of texts that begin with a blank, `tokens` the bytes of each id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [own.id_to_piece(n) for n in range(own.get_piece_size())]
            tokens = [bytes([int(p[3:5], 16)]) if own.is_byte(n) else p.replace("▁", " ").encode() for n, p in enumerate(pieces)]
            self.encode = lambda texts: own.encode([t[1:] for t in texts], num_threads=1)  # it adds the blank itself
        else:
            from tokenizers import Tokenizer

            own, plain = Tokenizer.from_file(path), byte_level()
            own.encode_special_tokens = True
            names = {n: t for t, n in own.get_vocab(with_added_tokens=True).items()}
            tokens = [bytes(plain.get(c, 63) for c in names.get(n, "")) for n in range(max(names) + 1)]
            self.encode = lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]
        self.tokens, self.size = pa.array(tokens, pa.large_binary()), np.array([len(t) for t in tokens], np.int64)
        # Nothing is merged across the begin of white space if no token holds it inside, but for those with other white space.
        self.units = not any(re.search(rb"[^ \n][ \n]", t) and not OTHER.search(t.decode(errors="ignore")) for t in tokens) and self._probed()

    def _probed(self) -> bool:
        """Whether texts of odd spacing have the ids of their units."""
        texts = [" a", " a  b", "   a b   c ", " a\nb\n\n c", " 1,2 .. 3\n  x", " éa 字 ß!", " it's  'T \n", " \n a", " <s> </s> <|endoftext|> "]
        for t in texts:
            own = b"".join(self.of_units([u])[0] for u in re.findall(rb"[ \n]+[^ \n]*", t.encode()))
            if own != np.array(self.encode([t])[0], np.uint32).tobytes():
                return False
        return True

    def of_units(self, units: list[bytes]) -> list[bytes]:
        """Ids of units, each as little-endian unsigned 32-bit numbers, all from one text with a short word before them."""
        ids = np.array(self.encode([(b" a" + b"".join(units)).decode()])[0], np.uint32)
        ends, cuts = np.cumsum(self.size[ids]), np.cumsum([2, *map(len, units)])
        at = np.searchsorted(ends, cuts)
        if at[-1] == len(ends) - 1 and (ends[at] == cuts).all():
            raw, at = ids.tobytes(), (4 * at + 4).tolist()
            return [raw[a:b] for a, b in pairwise(at)]
        # It changes some unit, whose bytes will not come back.
        return [x for u in units for x in self.of_units([u])] if len(units) > 1 else [ids[1:].tobytes()]

class Pair:
    """Both tokenizers and the memo of units; one for each Python worker."""

    def __init__(self, paths: tuple[str, str]):
        self.sides = [Vocabulary(p) for p in paths]
        self.units = all(s.units for s in self.sides)
        self.memo, self.old = {}, {}
        a, b = (range(len(s.tokens)) for s in self.sides)
        self.names = pa.array([f"{i}," for i in a] + [f"{i}|" for i in a] + [f"{i}," for i in b] + [f"{i};" for i in b], pa.large_binary())

    def learn(self, new: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """Ids of new units by both tokenizers."""
        texts = pa.array(new, pa.large_binary())
        odd = pc.match_substring_regex(texts.cast(pa.large_string()), OTHER_SPACE).to_pylist() if self.units else [True] * len(new)
        whole = [u for u, x in zip(new, odd, strict=True) if x]
        alone = [u for u, x in zip(new, odd, strict=True) if not x and u[-1] in b" \n"]
        joined = [u for u, x in zip(new, odd, strict=True) if not x and u[-1] not in b" \n"]
        size = np.cumsum([len(u) for u in joined]) // CALL_BYTES
        calls = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(joined)]
        out = []
        for side in self.sides:
            ids = [np.array(side.encode([u.decode()])[0], np.uint32).tobytes() for u in whole]
            ids += [side.of_units([u])[0] for u in alone]
            for a, b in pairwise(calls):
                ids += side.of_units(joined[a:b]) if b > a else []
            out.append(ids)
        return dict(zip(whole + alone + joined, zip(*out, strict=True), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side: ids of all texts end to end, and where each text's begin (one more than there are texts)."""
        blank = (data == 32) | (data == 10)
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        whole = np.ones(len(offsets) - 1, bool)
        if self.units:
            texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            whole = pc.match_substring_regex(texts, OTHER_SPACE).to_numpy(zero_copy_only=False)
        for n in np.flatnonzero(whole).tolist():
            first[offsets[n] : offsets[n + 1]] = False
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        at = np.append(np.flatnonzero(first), len(data))
        units = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        need = units.dictionary.to_pylist()
        if len(self.memo) + len(need) > MEMO_UNITS:
            self.old, self.memo = self.memo, {}
        known = {u: self.memo.get(u) or self.old.get(u) for u in need}
        known |= self.learn([u for u, ids in known.items() if ids is None])
        self.memo.update((u, ids) for u, ids in known.items() if len(u) <= MEMO_BYTES)
        starts, out = np.searchsorted(at, offsets), []
        for side in (0, 1):
            ids = pa.array([ids[side] for ids in known.values()], pa.large_binary()).take(units.indices)
            ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1] // 4
            raw = ids.buffers()[2]
            out.append((np.frombuffer(raw, np.uint32)[: ends[-1]].astype(np.int64) if ends[-1] else np.empty(0, np.int64), ends[starts]))
        return out


def lockstep(ends: list[np.ndarray], ids: list[np.ndarray], first: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge two tokenizations of the same texts. ends: byte ends over all texts, ids: token ids, first: index of each
    text's first token (one more than there are texts), each for both sides.

    Returns cuts (index behind the last token of each group, on both sides, in order) and links (index of an A token of
    the group; ids of both sides; how often): four arrays, the last three in one with three rows.
    """
    (ea, eb), (fa, fb) = ends, first
    # Lanes: every text, cut where both sides end at or soon behind every LANE-th token.
    n = np.diff(fa)
    more = np.maximum(0, (n - 1) // LANE)
    text = np.repeat(np.arange(len(n)), more)
    want = fa[:-1][text] + LANE * (1 + np.arange(len(text)) - np.repeat(np.cumsum(more) - more, more))
    cand = np.minimum(want[:, None] + np.arange(SEEK), fa[1:][text][:, None] - 1)
    met = np.searchsorted(eb, ea[cand]) if len(want) else np.empty((0, SEEK), np.int64)
    hit = eb[met] == ea[cand] if len(want) else np.empty((0, SEEK), bool)
    some, at = hit.any(axis=1), hit.argmax(axis=1)
    some_at = np.flatnonzero(some)
    held = np.flatnonzero(n > 0)
    ia = np.unique(np.concatenate([fa[:-1][held], fa[1:][held], cand[some_at, at[some_at]] + 1]))
    ib = np.unique(np.concatenate([fb[:-1][held], fb[1:][held], met[some_at, at[some_at]] + 1]))
    i, j, last = ia[:-1].copy(), ib[:-1].copy(), ia[1:]
    gi, gj = i.copy(), j.copy()
    none = np.empty(0, np.int64)
    cuts_a, cuts_b, links = [none], [none], [np.empty((4, 0), np.int64)]
    while len(i):
        a, b = ea[i], eb[j]
        c = np.flatnonzero(a == b)
        if len(c):
            a0, b0, a1, b1 = gi[c], gj[c], i[c] + 1, j[c] + 1
            cuts_a.append(a1)
            cuts_b.append(b1)
            links.append(_links(ids, a0, a1, b0, b1))
            gi[c], gj[c] = a1, b1
        i += a <= b
        j += b <= a
        live = i < last
        if not live.all():
            i, j, gi, gj, last = i[live], j[live], gi[live], gj[live], last[live]
    cuts_a, cuts_b = np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))
    return cuts_a, cuts_b, np.concatenate(links, axis=1)


def _links(ids: list[np.ndarray], a0, a1, b0, b1) -> np.ndarray:
    """All pairs of tokens of each group: rows of place (an A token of it), id A, id B, times."""
    p, q = a1 - a0, b1 - b0
    n = np.where(p * q > WIDE, 0, p * q)
    of = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    a, b = a0[of] + k // q[of], b0[of] + k % q[of]
    out = [np.stack([a, ids[0][a], ids[1][b], np.ones(len(a), np.int64)])]
    for g in np.flatnonzero(n == 0).tolist():
        (ua, ca), (ub, cb) = (np.unique(x[s:e], return_counts=True) for x, s, e in ((ids[0], a0[g], a1[g]), (ids[1], b0[g], b1[g])))
        out.append(np.stack([np.full(len(ua) * len(ub), a0[g]), np.repeat(ua, len(ub)), np.tile(ub, len(ua)), np.outer(ca, cb).ravel()]))
    return np.concatenate(out, axis=1)


_pairs: dict[tuple[str, str], Pair] = {}


def _merged(pair: Pair, texts: list[bytes | None]) -> list[tuple]:
    """Of each text: tokens of A and B, groups, links, the groups as text, and its distinct linked pairs with how often they come."""
    own = [b" " + t if t else b"" for t in texts]
    data = np.frombuffer(b"".join(own), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in own])]).astype(np.int64)
    ids, first = zip(*pair.encode(data, offsets), strict=True)
    # Texts that do not come back byte by byte from both sides have no tokens.
    good = offsets[1:] > offsets[:-1]
    for side, x, f in zip(pair.sides, ids, first, strict=True):
        at = np.concatenate([[0], np.cumsum(side.size[x])])[f]
        back = side.tokens.take(pa.array(x))
        raw = memoryview(back.buffers()[2] or b"").cast("B")
        good &= [raw[a:b] == t for (a, b), t in zip(pairwise(at.tolist()), own, strict=True)]
    ids = [x[np.repeat(good, np.diff(f))] for x, f in zip(ids, first, strict=True)]
    first = [np.concatenate([[0], np.cumsum(np.where(good, np.diff(f), 0))]) for f in first]
    cuts_a, cuts_b, links = lockstep([np.cumsum(s.size[x]) for s, x in zip(pair.sides, ids, strict=True)], list(ids), first)
    text_of = np.repeat(np.arange(len(texts)), np.diff(first[0]))
    groups = np.bincount(text_of[cuts_a - 1], minlength=len(texts))
    # Groups as text: names of all tokens in the order of groups, A before B, each with the mark that follows it.
    (na, nb), (va, vb) = (len(x) for x in ids), (len(s.tokens) for s in pair.sides)
    before_a, before_b = np.concatenate([[0], cuts_a]), np.concatenate([[0], cuts_b])
    at_a = np.arange(na) + np.repeat(before_b[:-1], np.diff(before_a))
    at_b = np.arange(nb) + np.repeat(cuts_a, np.diff(before_b))
    name = np.empty(na + nb, np.int64)
    name[at_a], name[at_b] = ids[0], 2 * va + ids[1]
    name[at_a[cuts_a - 1]] += va
    name[at_b[cuts_b - 1]] += vb
    spelled = pair.names.take(pa.array(name))
    at = np.frombuffer(spelled.buffers()[1], np.int64)[(first[0] + first[1])].tolist() if len(name) else [0] * (len(texts) + 1)
    raw = memoryview(spelled.buffers()[2] or b"")
    said = [bytes(raw[a : b - 1]) if b > a else b"" for a, b in pairwise(at)]
    # Distinct pairs of each text, in order.
    place, a, b, times = links
    bits_a, bits_b = va.bit_length(), vb.bit_length()
    key = (text_of[place] << (bits_a + bits_b)) | (a << bits_b) | b
    if (times == 1).all():
        key, total = np.unique(key, return_counts=True)
    else:
        key, of = np.unique(key, return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, of, times)
    t, a, b = key >> (bits_a + bits_b), (key >> bits_b) & ((1 << bits_a) - 1), key & ((1 << bits_b) - 1)
    ends = np.searchsorted(t, np.arange(len(texts) + 1))
    n_links = np.diff(np.concatenate([[0], np.cumsum(total)])[ends])
    return [np.diff(first[0]), np.diff(first[1]), groups, n_links, said, (a << 32) | b, total, ends]


def align(docs: DataFrame, tokenizers: tuple[str, str], id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (distinct linked ids, A in the upper and B in the lower 32
    bits) and times (how often each is linked) for each document row; with_groups adds the groups as text.

    Texts that are null or empty, or that a tokenizer does not give back byte by byte, have no tokens: zeros, an empty
    digest and no pairs. Repeated rows and null ids keep a row each; an empty table gives none. Whole texts are aligned,
    whatever their length. Other columns are ignored, so clashing names do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizers not in _pairs:
            _pairs[tokenizers] = Pair(tokenizers)
        for batch in batches:
            for part in slices(batch, 1, BATCH_BYTES):
                na, nb, groups, links, said, pairs, times, ends = _merged(_pairs[tokenizers], part.column(1).cast(pa.large_binary()).to_pylist())
                listed = lambda x, kind: pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(x, kind))  # noqa: E731, B023
                digest = [hashlib.sha256(x).hexdigest() if x else "" for x in said]
                columns = [part.column(0), *(pa.array(x, pa.int64()) for x in (na, nb, groups, links)), pa.array(digest), listed(pairs, pa.int64()), listed(times, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([x.decode() for x in said])] * with_groups, names)

    names = [f.split()[0] for f in SCHEMA.split(", ")] + ["groups"] * with_groups
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return picked.mapInArrow(run, SCHEMA + ", groups string" * with_groups)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) and best (whether no other pair with its A id has more)."""
    counts = keep(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # at most the vocabulary of A
    return counts.join(F.broadcast(most), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_statistics(docs: DataFrame, tokenizers: tuple[str, str], id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """align() with n_best (links whose pair is a best one of its A id) and count_sum (over links, the documents that hold
    the pair linked), from counts over the whole corpus. What align() says of nulls, repeats and empty tables holds."""
    own = keep(align(docs, tokenizers, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    counts = keep(pair_counts(own))
    size = counts.agg(F.count("*").alias("n"), F.sum("n").alias("total")).first()
    each = own.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    # No more than hot_pairs pairs can have that many documents each.
    hot = counts if size["n"] <= hot_pairs else counts.where(F.col("n") > size["total"] // hot_pairs)
    met = each.join(F.broadcast(hot), "pair")
    if size["n"] > hot_pairs:
        cold = each.join(F.broadcast(hot.select("pair")), "pair", "left_anti")
        met = met.unionByName(cold.join(counts.where(F.col("n") <= size["total"] // hot_pairs).hint("merge"), "pair"))
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return own.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
