"""Word shingles of many texts at once, hashed with array operations.

A word's hash is a polynomial in its bytes, got for all words of a batch from one
running sum; mixing makes it even. Hashes have 64 bits: two of a document's shingles
meet by chance once in about 10^12 documents of a few thousand words.
"""

from __future__ import annotations

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_K = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, b in enumerate((_B, _INV)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], places: bool = False, fold: bool = True) -> tuple:
    """Hash of each word of all texts (A-Z lower-cased if ``fold``), and how many words each text has;
    if asked for, also (start, end, joined texts) of the words."""
    joined = b" ".join([*texts, b""])
    raw = np.frombuffer(joined, np.uint8)
    gap = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    up, down = _power(len(raw) + 1)
    value = ((_FOLD[raw] if fold else raw).astype(np.uint64) + np.uint64(1)) * up[: len(raw)]
    total = np.concatenate(([np.uint64(0)], np.cumsum(value, dtype=np.uint64)))
    words = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _K[4])
    last = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    counts = np.diff(np.concatenate(([0], np.searchsorted(start, last))))
    return (words, counts, (start, end, joined)) if places else (words, counts)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; runs may reach over texts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ words[k : k + n]) * _K[k % 5]
        out ^= out >> np.uint64(29)
    return mix(out)


def window_hashes(words: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of ``size`` words from each of ``starts`` on, from running sums, however large the window."""
    up, down = _power(len(words) + 1)
    out = []
    for k in (_K[1], _K[2]):
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix(words ^ k) * up[: len(words)], dtype=np.uint64)))
        out.append(mix((total[starts + size] - total[starts]) * down[starts]))
    return out[0], out[1]


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Distinct shingle hashes, ascending, of each text. Fewer words than ``size`` are one
    shingle; no word gives none."""
    words, counts = word_hashes(texts)
    runs = shingle_hashes(words, size)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(runs[at : at + n - size + 1]))
        elif n:
            out.append(mix(shingle_hashes(words[at : at + n], n) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
