"""Suffix-array dedup of bytes: a depth-limited radix sort of the suffixes that can hold a repeated window."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quefrency.llm.repeats import Kind, cleaned

#: Bytes of a repeated string.
WINDOW = 400
#: Bytes of a digit of the radix sort.
DIGIT = 80


def digit_names(cells: np.ndarray, size: int = DIGIT) -> np.ndarray:
    """For each place the rank of the `size` bytes that begin there, equal for equal bytes only and in their order.

    Eight bytes are one big-endian number; the ranks of two pieces that cover a longer one rank it in turn.
    """
    n, have = len(cells), min(8, size)
    padded = np.concatenate([cells, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64) >> np.uint64(8 * (8 - have))
    while True:
        order = np.argsort(key)
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if have == size:
            return rank
        step = min(have, size - have)
        key = rank * n + rank[np.minimum(np.arange(n) + step, n - 1)]
        have += step


def equal_windows(cells: np.ndarray, sizes: np.ndarray, group: np.ndarray, times: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each window of each run, whether it occurs twice (a run met twice counts twice).

    Most-significant-digit passes: suffixes of a group are sorted by their next digit, which splits the group; a suffix
    alone in its group is done. After the last pass through the threshold, groups are exactly the equal windows, since
    digits are compared as bytes.
    """
    lengths = sizes + window - 1
    run = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(np.cumsum(lengths) - lengths, sizes)
    cells = cells.astype(np.uint8)
    n, names = len(cells), {}
    active, of = np.arange(len(run)), group[run].astype(np.int64)
    hit = np.zeros(len(run), bool)
    many = times[run] > 1
    done = 0
    while done < window and len(active):
        step = min(DIGIT, window - done)
        if step not in names:
            names[step] = digit_names(cells, step)
        key = of * n + names[step][at[active] + done]
        order = np.argsort(key)
        active, key = active[order], key[order]
        new = np.ones(len(active), bool)
        new[1:] = key[1:] != key[:-1]
        of = np.cumsum(new) - 1
        stay = np.bincount(of)[of] > 1
        done += step
        hit[active[many[active] & ~stay]] = True
        active, of = active[stay], of[stay]
    hit[active] = True
    return hit


def kind(window: int = WINDOW) -> Kind:
    """K-grams of about a sixth of the window, and two runs an anchor."""
    grams = window - window // 6
    return Kind("bytes", window, window - (grams - grams % 2) + 1, max(1, (grams - grams % 2) // 2))


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, n_removed, n_spans, kept, kept_sha256 of each row, in UTF-8 bytes; kept has every byte that no repeated
    `window`-byte string covers, judged on the input.

    Null and empty texts have no bytes; texts shorter than the window stay; a string repeated within its own text counts;
    repeated rows are copies of each other; null ids keep a row each; an empty table gives none; other columns are ignored.
    """
    return cleaned(docs, kind(window), lambda x, s, g, t: equal_windows(x, s, g, t, window), id_col, text_col)
