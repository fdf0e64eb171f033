"""Token ids of texts by a byte-level BPE tokenizer file.

The tokenizer splits a text into pieces (a word with the space before it, a
run of digits, of signs, of white space) and encodes each piece by itself, so a
piece has the same ids wherever it stands.  Here the pieces of many texts are
found at once, by character classes, and only distinct pieces go through the
tokenizer; a bounded memory keeps the ids of pieces seen before.  Where a text
holds one of the file's added tokens (such as an end of text), the token is cut
out before the split and keeps its own id.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import regex

from tableflow.llm.flat import word_hashes

#: Distinct pieces whose ids a worker remembers.
MEMORY = 1_000_000
#: Pieces that the tokenizer reads in one call.
TOGETHER = 2048

_LETTER, _DIGIT, _SPACE, _OTHER = 0, 1, 2, 3
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_classes: list[np.ndarray] = []
_encoders: dict[str, Encoder] = {}


def _character_classes() -> np.ndarray:
    """Class of every code point, made once per process."""
    if not _classes:
        table = np.full(0x110000, _OTHER, np.uint8)
        points = [chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000)]
        every = "".join(points)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                table[m.start() : m.end()] = kind
        _classes.append(table)
    return _classes[0]


def pieces(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """First code point of every piece of the texts that `edges` parts; equal
    to matching 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    from left to right."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _character_classes()[points]
    begins = np.zeros(n, bool)
    inner = edges[(edges > 0) & (edges < n)]
    begins[0] = True
    begins[inner] = True
    text_start = begins.copy()
    begins[1:] |= kind[1:] != kind[:-1]
    # The last white space before something else: a plain space joins what
    # follows, another one stands alone.
    space = kind == _SPACE
    before_word = np.zeros(n, bool)
    before_word[:-1] = space[:-1] & ~space[1:] & ~text_start[1:]
    begins[before_word] = True
    joined = np.flatnonzero(before_word & (points == 0x20)) + 1
    begins[joined] = False
    # A lone apostrophe that begins a piece takes a contraction along.
    mark = np.flatnonzero((points == 0x27) & begins)
    if len(mark):
        at = mark[mark + 1 < n]
        at = at[(kind[at + 1] == _LETTER) & ~text_start[at + 1]]
        stop = np.append(np.flatnonzero(text_start)[1:], n)
        for i in at.tolist():
            end = int(stop[np.searchsorted(stop, i, "right")])
            tail = "".join(map(chr, points[i + 1 : min(i + 3, end)].tolist()))
            size = next((len(c) for c in _CONTRACTIONS if tail.startswith(c)), 0)
            if size:
                begins[i + 1] = False
                if i + 1 + size < end and kind[i + 1 + size] == _LETTER:
                    begins[i + 1 + size] = True
    return np.flatnonzero(begins)


class Encoder:
    """Ids of texts by a tokenizer file, for one worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = sorted((t.content.encode() for t in self._tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self._added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self._known = np.zeros(0, np.uint64)
        self._offsets = np.zeros(1, np.int64)
        self._ids = np.zeros(0, np.uint32)

        # Tokens that close a sentence: their text ends with . ! ? or a line end.
        self._closes = np.zeros(self._tokenizer.get_vocab_size(), bool)
        closing = tuple(self._tokenizer.decode([i])[-1:] in {".", "!", "?", "\n"} for i in range(len(self._closes)))
        self._closes[:] = closing

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Places right behind the tokens that close a sentence."""
        return np.flatnonzero(self._closes[ids]) + 1

    def _encode(self, texts: list[str]) -> list[list[int]]:
        # Few at a time: an encoding holds far more than its ids.
        return [e.ids for k in range(0, len(texts), TOGETHER) for e in self._tokenizer.encode_batch(texts[k : k + TOGETHER], add_special_tokens=False)]

    def _added_tokens(self, raw: bytes, offs: np.ndarray) -> list[tuple[int, int]]:
        """Byte ranges of the file's added tokens, none across texts."""
        out, at = [], 0
        while self._added and (m := self._added.search(raw, at)):
            text = int(np.searchsorted(offs, m.start(), "right"))
            whole = m.end() <= offs[text]
            if whole:
                out.append(m.span())
            at = m.end() if whole else m.start() + 1
        return out

    def _learn(self, hashes: np.ndarray, texts: Callable[[np.ndarray], list[str]]) -> None:
        """Make sure that the pieces with these (distinct, sorted) hashes are known."""
        at = np.minimum(np.searchsorted(self._known, hashes), max(0, len(self._known) - 1))
        new = np.flatnonzero(self._known[at] != hashes) if len(self._known) else np.arange(len(hashes))
        if not len(new):
            return
        if len(self._known) + len(new) > MEMORY:  # forget, but keep what this call needs
            self._known, self._offsets, self._ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32)
            new = np.arange(len(hashes))
        ids = self._encode(texts(new))
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum()))
        known = np.concatenate([self._known, hashes[new]])
        starts = np.concatenate([self._offsets[:-1], self._offsets[-1] + np.cumsum(counts) - counts])
        sizes = np.concatenate([np.diff(self._offsets), counts])
        every = np.concatenate([self._ids, flat])
        order = np.argsort(known)
        self._known = known[order]
        self._ids = every[_ranges(starts[order], sizes[order])]
        self._offsets = np.concatenate([[0], np.cumsum(sizes[order])])

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, edges) of UTF-8 texts in one byte array."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        lead = np.flatnonzero((buf & 0xC0) != 0x80)  # byte of every code point
        points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        edges = np.searchsorted(lead, offs)
        raw = buf.tobytes()
        added = np.searchsorted(lead, np.array(self._added_tokens(raw, offs), np.int64).reshape(-1, 2))
        first = pieces(points, np.sort(np.concatenate([edges, added.ravel()])) if len(added) else edges)
        if len(added):  # an added token is one piece
            before = np.maximum(np.searchsorted(added[:, 0], first) - 1, 0)
            first = first[(first <= added[before, 0]) | (first >= added[before, 1])]
        start = lead[first]
        end = np.append(start[1:], len(buf))
        hashes = word_hashes(buf, start, end)
        distinct, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        self._learn(distinct, lambda new: [raw[start[i] : end[i]].decode("utf-8") for i in where[new].tolist()])
        slot = np.searchsorted(self._known, distinct)
        sizes = np.diff(self._offsets)[slot][which]
        ids = self._ids[_ranges(self._offsets[:-1][slot][which], sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, total[np.searchsorted(first, edges)]


def encoder_of(path: str) -> Encoder:
    """The worker's encoder of a file; later tasks find what it remembers."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range, one after the other."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)
