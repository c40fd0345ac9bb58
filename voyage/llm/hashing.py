"""Word spans and hashes over whole Arrow batches, as numpy columns.

digest() tells substrings apart: eight bytes at a time go through a mixing chain, so no two texts fall together by their
structure, as they can where a hash is a polynomial modulo a power of two. running() and substring() are such a
polynomial; they name the windows of a text quickly, for uses in which a clash costs time but no result. Work goes in
pieces of whole texts of about PIECE bytes, so that memory is bounded by the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
#: Longer substrings are hashed one by one.
LONG = 512
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_class(spans: list[tuple[int, int]], inside: bool = True) -> np.ndarray:
    """256 flags: bytes inside (or outside) the closed spans."""
    flags = np.full(256, not inside)
    for a, b in spans:
        flags[a : b + 1] = inside
    return flags


#: Bytes of words that white space ends, and of words of letters, digits and all that is not ASCII.
SPACED = byte_class([(0x20, 0x20), (0x09, 0x0D)], inside=False)
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)], inside=False)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        for name, base in (("up", _P), ("down", _P_INVERSE)):
            steps = np.full(max(n, PIECE) + 1, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps)
    return _tables["up"], _tables["down"]


def _letters() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return _tables["letters"]


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    if "fold" not in _tables:
        t = np.arange(256, dtype=np.uint8)
        t[65:91] += 32
        _tables["fold"] = t
    return _tables["fold"][data]


def digest(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the substrings [start, end) of the bytes; another seed gives an independent one."""
    size = (end - start).astype(np.int64)
    out = mix(size.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    eights = np.ndarray((len(data) + 1,), "<u8", buffer=np.concatenate([data, np.zeros(9, np.uint8)]), strides=(1,))
    low = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    left = np.flatnonzero((size > 0) & (size <= LONG))
    at, rest = start[left].astype(np.int64), size[left]
    while len(left):
        out[left] = mix(out[left] ^ (eights[at] & low[np.minimum(rest, 8)]))
        more = rest > 8
        left, at, rest = left[more], at[more] + 8, rest[more] - 8
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8, salt=seed.to_bytes(8)).digest())
    return out


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets within the bytes) for runs of whole texts of about most bytes."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    a, n = 0, len(column)
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def running(data: np.ndarray) -> np.ndarray:
    """Running sums from which substring() takes the hash of any substring."""
    up, _ = _powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_letters()[data] * up[: len(data)], out=out[1:])
    return out


def substring(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of the substrings [a, b): equal for equal ones, and nearly always else different."""
    _, down = _powers(len(sums))
    return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def word_spans(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the texts' first word numbers (one more than texts); words never cross texts."""
    flags = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.concatenate(([False], flags[:-1])) & ~edge[:-1]
    after = np.concatenate((flags[1:], [False])) & ~edge[1:]
    start, end = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1
    return start, end, np.searchsorted(start, offs)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive words from each word on; the last n - 1 run over the end and are left out."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1]
    for j in range(1, n):
        out = mix(out * np.uint64(0xFF51AFD7ED558CCD) + words[j : len(words) - n + 1 + j])
    return mix(out + np.uint64(n))


def text_words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, with A-Z as a-z, and the texts' first word numbers."""
    start, end, first = word_spans(data, offs, kind)
    return digest(folded(data), start, end), first


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
