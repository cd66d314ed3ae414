"""Word and shingle hashing over byte buffers with NumPy; no per-word Python objects.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, with A-Z folded to a-z. A document's set holds
the 64-bit hashes of its distinct ``width``-word shingles; a shorter document has its whole word sequence as
the one element, and a document without words the empty set.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _stream(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed)) * U(0x9E3779B97F4A7C15))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII but letters and digits.
MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_BYTE = _stream(256, 7) | U(1)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _stream(64, 1 << 20) | U(1)
_powers = np.ones(1, dtype=U)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.r_[U(1), np.full(max(n, 4096), U(0x9E3779B97F4A7C15) | U(1), dtype=U)], dtype=U)
    return _powers


def word_hashes(data: bytes, blanks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words of ``data`` and a hash of each; ``blanks`` marks the bytes between words."""
    buf = np.frombuffer(data, dtype=np.uint8)
    blank = blanks[buf]
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, dtype=U)
    a = starts[0]
    spans = np.diff(np.r_[starts, len(buf)])
    place = np.arange(a, len(buf)) - np.repeat(starts, spans)
    value = np.where(blanks, U(0), _BYTE)
    with np.errstate(over="ignore"):
        each = value[buf[a:]] * _power(int(spans.max()) + 1)[place]
        return starts, mix(np.add.reduceat(each, starts - a))


def sequence_hash(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words, one for each start."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    with np.errstate(over="ignore"):
        total = np.zeros(n, dtype=U)
        for k in range(width):
            total += words[k : k + n] * _PLACE[k % 64]
        return mix(total + U(width))


def _chunks(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        held.append(raw)
        size += len(raw) + 1
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def word_lists(texts: Iterable[str | None], blanks: np.ndarray = _SPACE) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, in order."""
    for raws in _chunks(texts):
        starts, words = word_hashes(b" ".join(raws), blanks)
        ends = np.cumsum([len(r) + 1 for r in raws])
        cut = np.searchsorted(starts, ends)
        a = 0
        for b in cut:
            yield words[a:b]
            a = b


def shingle_sets(texts: Iterable[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """For each text its set of shingle hashes, sorted."""
    for words in word_lists(texts):
        n = len(words)
        if n >= width:
            yield np.unique(sequence_hash(words, width))
        elif n:
            yield sequence_hash(words, n)
        else:
            yield words
