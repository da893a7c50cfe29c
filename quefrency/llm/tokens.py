"""Exact token ids of whole texts inside Arrow tasks, through a memo of encoded pieces."""

from __future__ import annotations

import os
import threading
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import pairwise
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quefrency.llm.kernels import slices

#: Id that ends every document.
END = 2
#: Pieces of each of the two generations that a Python worker remembers, and the longest piece worth remembering. When the
#: young generation is full it becomes the old one, which is forgotten; pieces still in use are young again by then.
MEMO_PIECES, MEMO_CHARS = 800_000, 40
#: The same for a worker that has little memory: workers of about 185 MB instead of 370 on check_l, for more time.
LEAN_PIECES = 100_000
#: Seconds without a text after which a worker gives its memo's memory back: idle workers outlive a stage by far.
IDLE_SECONDS = 3.0
#: Tokens of a file that its shortcuts are probed with.
PROBES = 400
#: Text bytes encoded at once; a longer text is still one call.
ENCODE_BYTES = 1 << 22
#: Marks that make a token of their own after a letter, since nothing follows them in the piece.
MARKS = frozenset(",.;:!?")
_END = array("I", [END]).tobytes()  # like all arrays here, four bytes a number, in little-endian order
_encoders: dict[str, Encoder] = {}


def vocabulary() -> str:
    """Path of the default tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _letters(word: str) -> bool:
    """Whether the word is letters, and still is as the tokenizer normalises it."""
    return word.isalpha() and (word.isascii() or normalize("NFC", word).lower().isalpha())


class Encoder:
    """Encodes blank-separated pieces once each, where the file allows that: no token of it spans white space, since its
    pre-tokenizer drops white space, and neither composition, nor lower case, nor a special token's string reaches across
    it. `mode` is what a probe at load found to hold: `words` (capitals fold, marks stand alone), `pieces` (pieces between
    white space are independent) or `whole` (texts are encoded as they are)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.old = Tokenizer.from_file(path), {}, {}
        self.pieces = MEMO_PIECES
        self.lock, self.timer = threading.Lock(), None
        # A special token that is cut out before anything else happens to a text: what stands beside it never meets.
        cuts = [(k, t.content) for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.specials = tuple(t for _, t in cuts)
        self.cut_id, self.cut = cuts[0] if cuts else (None, None)
        self.mode = "words"
        if not self._holds():
            self.mode, self.cut, self.memo, self.old = "pieces", None, {}, {}
            if not self._holds():
                self.mode = "whole"
        self.memo, self.old = {}, {}

    def _holds(self) -> bool:
        """Whether the shortcuts of this mode give the library's ids for words made of the file's own tokens, in several spellings."""
        names = sorted(self.tokenizer.get_vocab())
        stems = [w for x in names[:: max(1, len(names) // PROBES)] if (w := "".join(x.replace("</w>", "").split()))]
        forms = lambda w: (w, f"{w},", w.upper(), f"{w.capitalize()}.", f"'{w}'", f"{w}{w}", f"{w.upper()}!")
        texts = [" ".join(forms(w)) for w in stems] + [" \n\tx  y ", "a b", "A\nB, c", "\u00e9\u00c9 e\u0301. \u00df \u0130", "1,2. 3;"]
        want = [array("I", e.ids).tobytes() + _END for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return self.encode(texts) == want

    def rest(self) -> None:
        """Called at a task's end: forget all pieces if no other task comes soon."""
        with self.lock:
            if self.timer:
                self.timer.cancel()
            self.timer = threading.Timer(IDLE_SECONDS, self._forget)
            self.timer.daemon = True
            self.timer.start()

    def _forget(self) -> None:
        with self.lock:
            if threading.current_thread() is self.timer:  # no task has come meanwhile
                self.memo, self.old, self.timer = {}, {}, None
        pa.default_memory_pool().release_unused()

    def wake(self) -> None:
        """Called at a task's start."""
        with self.lock:
            if self.timer:
                self.timer.cancel()
            self.timer = None

    def _fresh(self, pieces: set[str]) -> set[str]:
        """Those that no generation knows; what the old one knows becomes young again."""
        new = pieces.difference(self.memo)
        known = {w: self.old[w] for w in new if w in self.old}
        self.memo.update(known)
        return new.difference(known)

    def _alone(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        for w, e in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
            yield w, array("I", e.ids).tobytes()

    def _together(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """As one text, with the special token between pieces: half the work of a call for each."""
        ids = np.array(self.tokenizer.encode_batch_fast([self.cut.join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(ids == self.cut_id)
        raw = ids.tobytes()
        for w, a, b in zip(pieces, [0, *(4 * at + 4).tolist()], [*(4 * at).tolist(), len(raw)], strict=True):
            yield w, raw[a:b]

    def _learn(self, new: set[str]) -> list[str]:
        """Encode new pieces into the memo; returns the pieces encoded for them."""
        # A word with a mark behind it has the word's ids, then the mark's; ASCII in capitals has those of small letters.
        alias, miss = {}, {"", *MARKS} if self.mode == "words" else set()
        for w in new:
            if self.mode != "words":
                miss.add(w)
            elif w[-1:] in MARKS and _letters(w[:-1]):
                c = w[:-1].lower() if w.isascii() else w[:-1]
                alias[w] = c, w[-1]
                miss.add(c)
            elif w.isascii() and w.isalpha() and not w.islower():
                alias[w] = w.lower(), ""
                miss.add(alias[w][0])
            else:
                miss.add(w)
        miss = list(self._fresh(miss))
        holds = lambda x: self.cut is None or any(s in x for s in self.specials)
        alone = list(filter(holds, miss)) if holds("\n".join(miss)) else []
        joined = [w for w in miss if not holds(w)] if alone else miss
        for pieces, step, form in ((alone, 4096, self._alone), (joined, 512, self._together if self.cut else self._alone)):
            for at in range(0, len(pieces), step):
                self.memo.update(form(pieces[at : at + step]))
        memo = self.memo
        memo.update({w: memo[c] + memo[m] for w, (c, m) in alias.items()})
        return miss

    def encode(self, texts: pa.Array | Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers, with END last. Null is the empty text."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        if self.mode == "whole":
            own = [x or "" for x in texts.to_pylist()]
            return [array("I", e.ids).tobytes() + _END for e in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat = split.flatten().dictionary_encode()
        need = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.memo) + len(need) > self.pieces:
            self.old, self.memo = self.memo, {}
        new = self._fresh(set(need))
        miss = self._learn(new) if new else []
        # Pieces of all texts end to end, then cut where texts end.
        ids = pa.array(list(map(self.memo.__getitem__, need)), pa.large_binary()).take(flat.indices)
        _, offsets, values = ids.buffers()
        raw = memoryview(values) if values else memoryview(b"")
        cuts = np.frombuffer(offsets, np.int64, len(ids) + 1)[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist() if len(ids) else [0] * (len(texts) + 1)
        for x in (*new, *miss):
            if len(x) > MEMO_CHARS:
                self.memo.pop(x, None)
        return [b"".join((raw[a:b], _END)) for a, b in pairwise(cuts)]


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file; it outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batches: Iterable[pa.RecordBatch], path: str, pieces: int = MEMO_PIECES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches whose column 1 is text, with the ids of each row. pieces: those that a generation of the memo holds;
    slices are so small that the pieces of one, a new one in about 20 bytes, fit."""
    enc = encoder(path)
    enc.wake()
    enc.pieces = pieces
    try:
        for batch in batches:
            for part in slices(batch, 1, min(ENCODE_BYTES, 20 * pieces)):
                yield part, enc.encode(part.column(1))
    finally:
        enc.rest()


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
