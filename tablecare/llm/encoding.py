"""Whole texts to token ids with a public tokenizer file, word by word.

The pre-tokenizers of the two vocabularies in use never let a piece run across
the start of white space or across the end of a run of letters. A text can thus
be cut there, each distinct cut encoded once by the ``tokenizers`` library and
remembered, and the ids of a text put together from remembered ones. Texts are cut,
their cuts told apart and the ids put together as arrays, four million characters at
a time; only distinct cuts become Python objects. Texts for
which a cut could matter (rare white space, special tokens, decomposed
characters) are encoded whole.
"""

from __future__ import annotations

import ctypes
import functools
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress
from itertools import islice

import numpy as np
import pyarrow as pa

#: what cuts begin with
_SPACES = " \t\n\r\x0b\x0c"
#: white space that regular-expression engines may see differently, and the one letter
#: that is two characters in lower case
_RARE = (
    "\x1c\x1d\x1e\x1f\x85\xa0\u0130\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
)
#: longer cuts are not remembered
_LONGEST = 40
#: characters of texts that are cut at a time
_AT_ONCE = 1 << 22
#: cuts that are encoded in a row
_ROW = 1000


def _any_rare(text: str) -> bool:
    # a search by character each: faster than one pass of a regular expression
    return any(c in text for c in (_RARE[:4] if text.isascii() else _RARE))


@functools.lru_cache(maxsize=3)
def _classes(bound: int) -> np.ndarray:
    """Of each character below ``bound``: 1 for white space, 2 for a letter, else 0."""
    classes = np.zeros(bound, np.uint8)
    classes[list(map(ord, _SPACES))] = 1
    for run in re.finditer(r"[^\W\d_]+", "".join(map(chr, range(bound)))):
        classes[run.start() : run.end()] = 2
    return classes


def cuts_of(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """The cuts of all texts, and the number of the cut behind each, which is a line feed.

    A cut is letters with the white space before them; else anything up to the next white
    space, with that before it; else white space at the end.
    """
    joined = "\n".join([*texts, ""])
    data = joined.encode()
    if joined.isascii():
        chars = None
        classes = np.frombuffer(data.translate(_classes(256).tobytes()), np.uint8)
    else:
        chars = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        classes = _classes(0x10000 if chars.max() < 0x10000 else 0x110000).take(chars)
    spaces, letters = classes == 1, classes == 2
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    begins = ends[:-1] + 1
    cut = spaces.copy()
    cut[1:] &= ~spaces[:-1]
    cut[0] = cut[begins] = cut[ends] = True
    # runs of letters that follow white space (each text has some before it) are cut off;
    # every run ends, as the last character is a line feed
    edges = np.flatnonzero(letters[1:] != letters[:-1]) + 1
    if letters[0]:
        edges = np.append(0, edges)
    runs, behind = edges[::2], edges[1::2]
    behind = behind[(runs == 0) | spaces[runs - 1]]
    cut[behind[~spaces[behind]]] = True
    at = np.flatnonzero(cut)
    closing = np.searchsorted(at, ends)
    if chars is not None:
        widths = np.ones(len(chars), np.int8)
        for more in (0x80, 0x800, 0x10000):
            widths += chars >= more
        at = (np.cumsum(widths, dtype=np.int64) - widths)[at]
    offsets = np.append(at, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)), closing


class CachedEncoder:
    """``encode`` gives the ids of texts as little-endian unsigned 32-bit bytes.

    ``remembered`` bounds the number of cuts kept. They are kept in two halves: when
    the younger one is full, the older one is forgotten and what is still in use
    moves on, so that frequent cuts are never encoded anew.
    """

    def __init__(self, path: str, remembered: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        # ids that can only stand where a word starts (its space) or ends
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=False)
        self._by_end = any(token.endswith("</w>") for token in vocabulary)
        self._edge = np.zeros(self._tokenizer.get_vocab_size() + 1, bool)
        self._edge[
            [
                number
                for token, number in vocabulary.items()
                if (token.endswith("</w>") if self._by_end else token.startswith("\u0120"))
            ]
        ] = True
        self._half = max(1, remembered // 2)
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _encode_all(self, texts: list[str]) -> list[bytes]:
        encoded = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in encoded]

    def _encode_cuts(self, cuts: list[str]) -> list[bytes]:
        """The ids of each cut. Those of one space and letters go to the tokenizer as rows
        of many, and the ids of a row are told apart by their edges; a row with another
        number of edges than cuts is encoded cut by cut."""
        plain = [c for c in cuts if c[0] == " " and c[1:].isalpha()]
        rows = [plain[n : n + _ROW] for n in range(0, len(plain), _ROW)]
        known: dict[str, bytes] = {}
        encoded = self._tokenizer.encode_batch_fast(["".join(r) for r in rows], add_special_tokens=False)
        for row, found in zip(rows, encoded, strict=True):
            ids = np.array(found.ids, "<u4")
            edges = np.flatnonzero(self._edge[ids])
            if len(edges) != len(row):
                continue
            held = ids.tobytes()
            if self._by_end:
                ends = (4 * (edges + 1)).tolist()
                starts, whole = [0, *ends[:-1]], ends[-1] == len(held)
            else:
                starts = (4 * edges).tolist()
                ends, whole = [*starts[1:], len(held)], not starts[0]
            if whole:
                known |= {c: held[a:b] for c, a, b in zip(row, starts, ends, strict=True)}
        rest = [c for c in cuts if c not in known]
        known |= zip(rest, self._encode_all(rest), strict=True)
        return [known[c] for c in cuts]

    def forget(self, but: int) -> None:
        """Keep the first cuts only, among which are the frequent ones."""
        self._older = {}
        self._known = dict(islice(self._known.items(), but))

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        out: list[bytes] = []
        part: list[str] = []
        size = 0
        for text in texts:
            part.append(text or "")
            size += len(part[-1])
            if size >= _AT_ONCE:
                out += self._encode_part(part)
                part, size = [], 0
        return out + self._encode_part(part)

    def _encode_part(self, texts: list[str]) -> list[bytes]:
        whole = [
            "<|" in text or _any_rare(text) or not unicodedata.is_normalized("NFC", text)
            for text in texts
        ]
        joined = iter(self._put_together([t for t, w in zip(texts, whole, strict=True) if not w]))
        return [
            self._encode_all([text])[0] if w else next(joined)
            for text, w in zip(texts, whole, strict=True)
        ]

    def _put_together(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        cuts, closing = cuts_of(texts)
        cuts = cuts.dictionary_encode()
        which = cuts.indices.to_numpy()
        held = self._ids_of(cuts.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        values = np.frombuffer(b"".join(held), "<u4")
        counts = sizes[which]
        counts[closing] = 0
        ends = np.cumsum(counts)
        # from a place among all ids to that in ``values``
        shift = (np.cumsum(sizes) - sizes)[which] - (ends - counts)
        ids = values[np.repeat(shift, counts) + np.arange(ends[-1])].tobytes()
        upto = (4 * ends[closing]).tolist()
        return [ids[a:b] for a, b in zip([0, *upto], upto, strict=False)]

    def _ids_of(self, cuts: list[str]) -> list[bytes]:
        """The ids of distinct cuts, remembered or new."""
        known, older = self._known, self._older
        ids = list(map(known.get, cuts))
        gaps = [n for n, found in enumerate(ids) if found is None]
        missing = [cuts[n] for n in gaps]
        if missing:
            moved = {c: older[c] for c in missing if c in older}
            fresh = [c for c in missing if c not in moved]
            moved |= zip(fresh, self._encode_cuts(fresh), strict=True)
            known |= moved
            for n, c in zip(gaps, missing, strict=True):
                ids[n] = moved[c]
        for long in [c for c in missing if len(c) > _LONGEST]:
            del known[long]
        if len(known) > self._half:
            self._known, self._older = {}, known
        return ids


@contextmanager
def encoding(path: str, kept: int = 100_000) -> Iterator[CachedEncoder]:
    """The encoder for one task; ``kept`` cuts stay in the worker for the next one. What
    they don't need goes back to the system, as workers live on beside later stages."""
    known = encoder(path)
    try:
        yield known
    finally:
        known.forget(kept)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> CachedEncoder:
    """One encoder per vocabulary file and Python worker."""
    return CachedEncoder(path)
