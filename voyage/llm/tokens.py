"""Token ids of whole texts with the word_bpe vocabulary, for whole Arrow batches.

The tokenizer lower-cases, drops white space and splits before it merges, so equal words give equal ids wherever they
stand. Words of simple scripts are found with numpy and looked up once a piece; new words go to the tokenizer
together. Texts with anything else (other scripts, apostrophes before letters, special strings) go to it whole.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from voyage.llm import hashing

SPACE, LETTER, NUMBER, OTHER, STRANGE = range(5)
#: Code points below this whose lower case is one code point and that no normal form changes.
SIMPLE = 0x250
KEEP_WORDS = 600_000
#: Bytes of texts at a time: each takes about a hundred bytes of memory on the way.
PIECE = 1 << 19


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind, low = np.full(SIMPLE, STRANGE, np.uint8), np.arange(SIMPLE, dtype=np.uint32)
    for c in [0x09, 0x0A, 0x0D, *range(0x20, 0x7F), *range(0xA1, SIMPLE)]:
        x = chr(c)
        group = unicodedata.category(x)[0]
        if len(x.lower()) == 1 and unicodedata.is_normalized("NFC", x):
            kind[c] = SPACE if x.isspace() else LETTER if group == "L" else NUMBER if group == "N" else OTHER
            low[c] = ord(x.lower())
    return kind, low


class Encoder:
    """Keeps the ids of the words seen so far, of KEEP_WORDS at most."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.kind, self.low = _classes()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def _learn(self, names: list[int], words: list[str]) -> None:
        code = self.whole.encode(" ".join(words), add_special_tokens=False)
        ids, which = np.array(code.ids, np.uint32), np.array(code.word_ids, np.int64)
        sizes = np.bincount(which, minlength=len(words))
        n, a = len(self.known), self.used
        while n + len(words) > len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start * 0]), np.concatenate([self.size, self.size * 0])
        while a + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool * 0])
        self.pool[a : a + len(ids)] = ids
        self.used = a + len(ids)
        self.start[n : n + len(words)] = a + np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.size[n : n + len(words)] = sizes
        self.known.update(zip(names, range(n, n + len(words)), strict=True))

    def lists(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text."""
        for _, data, offs in hashing.pieces(column, PIECE):
            yield from self._piece(data, offs)

    def _piece(self, data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        at = heads[offs]
        simple = np.minimum(points, SIMPLE - 1)
        kind = np.where(points < SIMPLE, self.kind[simple], STRANGE)
        low = np.where(points < SIMPLE, self.low[simple], 0x20).astype(np.uint32)
        n = len(points)
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        differs = np.concatenate(([True], kind[1:] != kind[:-1])) if n else np.zeros(0, bool)
        heads_here = (kind != SPACE) & (differs | edge[:-1] | (kind == NUMBER))
        start = np.flatnonzero(heads_here)
        border = np.flatnonzero(np.concatenate((heads_here | (kind == SPACE) | edge[:-1], [True])))
        end = border[np.searchsorted(border, start, side="right")] if len(start) else start
        odd = kind == STRANGE
        if n > 1:
            after = kind[1:] == LETTER
            odd[:-1] |= (points[:-1] == 0x27) & after & heads_here[:-1]
            odd[:-1] |= (points[:-1] == 0x3C) & (points[1:] == 0x7C)
        strange = np.diff(np.concatenate(([0], np.cumsum(odd)))[at]) > 0
        text = np.searchsorted(at, start, side="right") - 1
        keep = ~strange[text] if len(start) else np.zeros(0, bool)
        start, end, text = start[keep], end[keep], text[keep]
        wide = np.minimum(low, SIMPLE).astype("<u2").view(np.uint8)
        del heads, simple, kind, heads_here, differs, border
        names = hashing.digest(wide, 2 * start, 2 * end)
        del wide
        different, first, which = np.unique(names, return_index=True, return_inverse=True)
        if len(self.known) + len(different) > KEEP_WORDS:
            self._forget()
        names = different.tolist()
        new = [k for k, x in enumerate(names) if x not in self.known]
        if new:
            lower = low.tobytes().decode("utf-32-le")
            self._learn([names[k] for k in new], [lower[start[first[k]] : end[first[k]]] for k in new])
        place = np.fromiter((self.known[x] for x in names), np.int64, len(names))[which]
        size = self.size[place]
        begin = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[np.repeat(self.start[place] - begin[:-1], size) + np.arange(begin[-1])]
        bounds = begin[np.searchsorted(text, np.arange(len(offs)))]
        for d in range(len(offs) - 1):
            if strange[d]:
                yield np.array(self.whole.encode(data[offs[d] : offs[d + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            else:
                yield ids[bounds[d] : bounds[d + 1]]
