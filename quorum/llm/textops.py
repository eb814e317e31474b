"""Word and shingle hashing over Arrow batches, vectorised across many documents at once.

Words are those of ``common.WORD`` after lower-casing A-Z. Everything works on UTF-8 bytes, in chunks of about
a megabyte, so that memory is bounded by the longest single text and not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 20
SHINGLE = 5
_RADIX = np.uint64(0x9E3779B97F4A7C13)  # odd, 3 mod 4
_RADIX_INVERSE = np.uint64(pow(0x9E3779B97F4A7C13, -1, 1 << 64))


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64), 0x51ED27)
_BYTE[_SPACE] = 0
#: Odd multipliers of a shingle's words, by their place.
_PLACE = mix64(np.arange(7, 7 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _powers_up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^j and R^-j modulo 2^64 for j < n at least."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, r, np.uint64)])) for r in (_RADIX, _RADIX_INVERSE))
    return _powers


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded texts) in runs of about CHUNK_BYTES; null counts as empty."""
    first, size, run = 0, 0, []
    for i, text in enumerate(texts):
        data = b"" if text is None else text.encode("utf-8", "surrogatepass").lower()
        if run and size + len(data) > CHUNK_BYTES:
            yield first, run
            first, size, run = i, 0, []
        run.append(data)
        size += len(data) + 1
    if run:
        yield first, run


def word_spans(run: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts joined by a space, first byte of each word, byte after it, words before each text and in all)."""
    data = np.frombuffer(b" " + b" ".join(run) + b" ", dtype=np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[data].view(np.int8)))
    starts, ends = edge[0::2] + 1, edge[1::2] + 1
    text_starts = np.cumsum([1, *(len(x) + 1 for x in run)])
    return data, starts, ends, np.searchsorted(starts, text_starts)


def word_hashes(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word of each text, number of words before each text and in all)."""
    data, starts, _, bounds = word_spans(run)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    powers, inverse = _powers_up_to(len(data))
    sums = np.add.reduceat(_BYTE[data] * powers[: len(data)], starts)
    return mix64(sums * inverse[starts]), bounds


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of the SHINGLE words from each place on; the places of a joined run that cross texts are for the caller to skip."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out += words[k : k + n] * _PLACE[k]
    return mix64(out)


def short_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on, fewer than a shingle has, as the only shingle of so short a text."""
    n = len(words) - size + 1
    if n <= 0 or size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += words[k : k + n] * _PLACE[k]
    return mix64(out, size)


def text_shingles(words: np.ndarray, shingles: np.ndarray, a: int, b: int) -> np.ndarray:
    """The shingles of the text whose words are a..b of a run: the whole sequence as one if it is shorter than a shingle."""
    return shingles[a : b - SHINGLE + 1] if b - a >= SHINGLE else short_hashes(words[a:b], b - a)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    for _, run in chunks(texts):
        words, bounds = word_hashes(run)
        shingles = shingle_hashes(words)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield np.unique(text_shingles(words, shingles, a, b))
