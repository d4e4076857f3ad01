"""Words of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0xD6E8FEB86659FD93)  # odd, so it has an inverse modulo 2^64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0x9E3779B97F4A7C15)
CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)

#: bytes that belong to a word: anything but ASCII white space
PRINTED = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
#: ASCII letters and digits, and all bytes of other characters
ALNUM = np.array([chr(b).isalnum() or b > 127 for b in range(256)])

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        m = 1 << n.bit_length()
        for k, base in enumerate((BASE, INVERSE)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def words(texts: list[bytes], inside: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of the text it stands in."""
    raw = np.frombuffer(b"".join(b" " + t for t in texts) + b" ", np.uint8)
    word = inside[raw]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    bounds = np.cumsum(lengths)
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(CODES[raw] * up[: len(raw)], dtype=np.uint64, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(bounds, starts, side="right").astype(np.int32)


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = mixed(out + h[k : len(h) - n + 1 + k] + np.uint64(k + 1))
    return out


def groups(texts: list[str], size: int = 1 << 20, lower: bool = True, overlap: int = 0) -> Iterator[tuple[list[bytes], list[int]]]:
    """Encoded texts in groups of bounded size, with the number of each one's text. A longer text comes in parts that end at a
    blank; each part begins ``overlap`` bytes before the end of the one before."""
    group, owner, held = [], [], 0
    for k, t in enumerate(texts):
        data, at = (t.lower() if lower else t).encode("utf-8", "replace"), 0
        while True:
            end = data.find(b" ", at + size) if len(data) - at > size else -1
            part = data[at:] if end < 0 else data[at:end]
            group.append(part)
            owner.append(k)
            held += len(part) + 1
            if held >= size:
                yield group, owner
                group, owner, held = [], [], 0
            if end < 0:
                break
            at = max(at + 1, data.rfind(b" ", 0, end - overlap + 1)) if overlap else end
    if group:
        yield group, owner
