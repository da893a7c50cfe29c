"""Substring dedup of words: an FM-index per shard, searched backward for the matching statistics of streamed runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quefrency.llm.repeats import Kind, cleaned, rewritten

#: Words of a repeated passage.
WINDOW = 35


class WaveletBits:
    """A wavelet matrix: bit planes in 64-bit words, with the ones before each word."""

    def __init__(self, x: np.ndarray, levels: int):
        self.n, self.levels, self.planes = len(x), levels, []
        for level in reversed(range(levels)):
            one = (x >> level & 1).astype(bool)
            words = np.packbits(np.concatenate([one, np.zeros(-len(one) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.uint32)
            self.planes.append((words, ones, len(one) - int(ones[-1])))
            x = np.concatenate([x[~one], x[one]])

    def rank(self, c: np.ndarray, i: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c before place i. start: where c begins in the last plane's order."""
        for k, (words, ones, zeros) in enumerate(self.planes):
            w = i >> 6
            r = ones[w].astype(np.int64) + np.bitwise_count(words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where(c >> (self.levels - 1 - k) & 1, zeros + r, i - r)
        return i - start

    @property
    def nbytes(self) -> int:
        return sum(w.nbytes + o.nbytes for w, o, _ in self.planes)


class FmIndex:
    """Count of a pattern in texts, by backward search. Texts end in separators (symbol 0); suffixes are ordered through `depth` symbols.

    Compressed by runs: of the transformed text it keeps one symbol for each run of equal ones, in a wavelet matrix, with
    the runs' starts and their lengths summed by symbol. Texts that repeat make long runs.
    """

    def __init__(self, text: np.ndarray, depth: int):
        """text: symbols from 0 to its maximum, each of which occurs."""
        n, rank, span = len(text), text.astype(np.int64), 1
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[:-span] = rank[span:] + 1
            key = rank * (n + 1) + nxt
            order = np.argsort(key)
            new = np.ones(n, bool)
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            span *= 2
            if span >= depth or new.all():
                break
        last = text[order - 1].astype(np.int64)
        edge = np.ones(n, bool)
        edge[1:] = last[1:] != last[:-1]
        self.starts = np.flatnonzero(edge)
        self.heads = last[self.starts]
        runs = np.bincount(self.heads)
        # Where the runs of each symbol begin in the order of symbols, and the length of all runs before each in that order.
        self.of = np.concatenate([[0], np.cumsum(runs)[:-1]])
        by = np.argsort(self.heads, kind="stable")
        self.before = np.concatenate([[0], np.cumsum(np.diff(np.append(self.starts, n))[by])])
        levels = max(1, int(text.max()).bit_length())
        self.bits = WaveletBits(self.heads, levels)
        # Where each symbol begins after the last plane: symbols stand there in the order of their reversed bits.
        symbols = np.arange(len(runs))
        turned = np.zeros_like(symbols)
        for b in range(levels):
            turned |= (symbols >> b & 1) << (levels - 1 - b)
        by = np.argsort(turned, kind="stable")
        self.start = np.empty(len(runs), np.int64)
        self.start[by] = np.concatenate([[0], np.cumsum(runs[by])[:-1]])

    @property
    def nbytes(self) -> int:
        return self.bits.nbytes + sum(x.nbytes for x in (self.starts, self.heads, self.of, self.before, self.start))

    def _place(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """First suffix that begins with c, plus the occurrences of c before place i of the transformed text."""
        run = np.searchsorted(self.starts, i, "right") - 1
        whole = self.before[self.of[c] + self.bits.rank(c, run, self.start[c])]
        return whole + np.where(self.heads[run] == c, i - self.starts[run], 0)

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with symbol c put before them."""
        both = self._place(np.concatenate([c, c]), np.concatenate([lo, hi]))
        return both[: len(c)], both[len(c) :]


def matched_windows(cells: np.ndarray, sizes: np.ndarray, group: np.ndarray, times: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each window of each run, whether the shard holds it twice (a run met twice counts twice).

    cells: small numbers, the same for equal words only. All runs are streamed at once. From the last word of a run, a search goes backward while the pattern occurs twice, to
    its longest match. A match of the threshold or more reports an interval, whose windows are repeated, and the next
    search ends where the first window left of it does; a shorter match clears the window that ends there.
    """
    lengths = sizes + window - 1
    begin = np.cumsum(lengths) - lengths
    x = np.cumsum(np.bincount(cells) > 0)[cells]  # from 1, without gaps
    copies = np.minimum(times, 2)
    # Texts of the index: each run, and once more if it was met again; a separator after each.
    which = np.repeat(np.arange(len(sizes)), copies)
    size = lengths[which] + 1
    ends = np.cumsum(size)
    text = np.zeros(int(ends[-1]), np.int64)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = x[np.arange(int(inside.sum())) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1) + np.repeat(begin[which], size - 1)]
    index = FmIndex(text, int(lengths.max()))
    hit = np.zeros(int(sizes.sum()), bool)
    base = np.cumsum(sizes) - sizes
    run = np.arange(len(sizes))
    end = lengths - 1  # last word of the search, within the run
    at, lo, hi = end.copy(), np.zeros(len(run), np.int64), np.full(len(run), len(text), np.int64)
    while len(run):
        can = at >= 0
        l2, h2 = index.extend(x[begin[run] + np.maximum(at, 0)], lo, hi)
        go = can & (h2 - l2 >= 2)
        at, lo, hi = np.where(go, at - 1, at), np.where(go, l2, lo), np.where(go, h2, hi)
        if go.all():
            continue
        s = np.flatnonzero(~go)
        left = at[s] + 1  # the match is left .. end
        enough = end[s] - left + 1 >= window
        for r, a, e in zip(run[s[enough]].tolist(), left[enough].tolist(), end[s[enough]].tolist(), strict=True):
            hit[base[r] + a : base[r] + e - window + 2] = True
        end[s] = np.where(enough, left + window - 2, end[s] - 1)
        at[s], lo[s], hi[s] = end[s], 0, len(text)
        live = end >= window - 1
        run, end, at, lo, hi = run[live], end[live], at[live], lo[live], hi[live]
    return hit


def kind(window: int = WINDOW) -> Kind:
    """K-grams of about a sixth of the window, and two runs an anchor."""
    grams = window - window // 6
    return Kind("words", window, window - (grams - grams % 2) + 1, max(1, (grams - grams % 2) // 2))


def remove_repeated_words(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, n_removed, n_spans, kept, kept_sha256 of each row, in words (between ASCII white space, unchanged); kept
    has the words that no repeated `window`-word passage covers, joined by blanks, judged on the input.

    Null and empty texts have no words; shorter texts stay; a passage repeated within its own text counts; repeated rows
    are copies of each other; null ids keep a row each; an empty table gives none; other columns are ignored.
    """
    return cleaned(docs, kind(window), lambda x, s, g, t: matched_windows(x, s, g, t, window), id_col, text_col)


def without_repeated_words(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The documents, with all columns, after remove_repeated_words(); those it leaves without words go."""
    return rewritten(docs, kind(window), lambda x, s, g, t: matched_windows(x, s, g, t, window), id_col, text_col, length_col)
