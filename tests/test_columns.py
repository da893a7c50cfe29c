"""Array columns: lists of any length in one batch, and what a batch of them holds in Python."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quefrency.functions import columns


def test_lists_of_many_lengths():
    s = pa.array([[1.0, 2, 3], None, [4.0], [5.0, None, 6.0], [], [7.0, 8.0]])
    got = columns._by_length(s, lambda m: m * 2, 2, columns.VECTOR).to_pylist()
    assert got[0] == [2, 4, 6] and got[5] == [14, 16] and got[1] is got[2] is got[4] is None
    assert got[3][::2] == [10, 12] and np.isnan(got[3][1])
    two = columns._by_length(s.slice(2, 2), lambda m: np.stack([m, -m], axis=1), 1, pa.list_(columns.VECTOR)).to_pylist()
    assert two[0] == [[4], [-4]] and two[1][1][::2] == [-5, -6]


def test_a_batch_is_taken_in_parts():
    """Frames of 10000 windows: they are made in parts and held as Arrow buffers, not as an object a frame."""
    s = pa.array(list(np.zeros((10000, 64))), columns.VECTOR)
    seen = []
    wide = lambda m: (seen.append(len(m)), np.repeat(m[:, None], 16, axis=1))[1]
    tracemalloc.start()
    out = columns._by_length(s, wide, 1, pa.list_(columns.VECTOR))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 10000 and max(seen) <= columns.ROWS and peak < 60e6


def test_rows_by_key():
    k, s = pa.array(["a", "b", None, "a", "c"]), pa.array([[1.0], [2.0, 3.0], [4.0], [5.0], None])
    got = columns.by_key(k, s, [columns.VECTOR], lambda name, m: [columns.packed(m + 1)] if name == "b" or name == "a" else None)[0]
    assert got.to_pylist() == [[2], [3, 4], None, [6], None]


def test_null_frames_leave_the_others_alone():
    m = np.arange(12.0).reshape(2, 3, 2)
    m[0, 1] = m[1, 0] = np.nan
    assert columns.packed(m, True).to_pylist() == [[[0, 1], None, [4, 5]], [None, [8, 9], [10, 11]]]
