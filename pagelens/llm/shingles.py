"""Word shingle sets of whole texts as sorted 64-bit hashes.

Words are runs of other bytes than space and 0x09 to 0x0D, with A to Z lower
cased. A set holds the distinct hashes of ``size`` consecutive words; a text
with fewer words is one shingle of all its words; a text without words (or
NULL) is empty. Two different shingles get one hash with odds of 2**-64.
"""

from hashlib import blake2b

import numpy as np

from pagelens.llm.worker import hold

# Bytes of text hashed at once; bounds a task's memory.
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as far as they were needed."""

    def __init__(self):
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def reach(self, size: int) -> None:
        while len(self.up) < size:
            n = len(self.up)
            up = np.uint64(pow(_BASE, n, 1 << 64))
            down = np.uint64(pow(_INVERSE, n, 1 << 64))
            self.up = np.concatenate([self.up, self.up * up])
            self.down = np.concatenate([self.down, self.down * down])


_powers = _Powers()


def _word_hashes(raw: bytes):
    """Hash and begin of each word."""
    codes = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(codes) + 2, dtype=np.int8)
    inside[1:-1] = ~_IS_SPACE[codes]
    edges = np.diff(inside)
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    _powers.reach(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers.up[: len(codes)], out=sums[1:])
    words = (sums[end] - sums[begin]) * _powers.down[begin]
    return mix(words ^ (end - begin).astype(np.uint64) << np.uint64(40)), begin


def _slice_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    raw = b"\n".join(texts).lower()
    words, begin = _word_hashes(raw)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(begin, starts).tolist()
    runs = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        runs = mix(runs * np.uint64(_BASE) + words[k : k + len(runs)])
    out = []
    for a, b in zip(first, first[1:]):
        if b - a >= size:
            found = np.sort(runs[a : b - size + 1])
            fresh = np.empty(len(found), dtype=bool)
            fresh[0] = True
            np.not_equal(found[1:], found[:-1], out=fresh[1:])
            out.append(found[fresh])
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                one = mix(one * np.uint64(_BASE) + w)
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingle_sets(texts: list, size: int):
    """One sorted array of distinct hashes per text, in order."""
    hold("shingles")
    part, held = [], 0
    for text in texts:
        part.append((text or "").encode("utf-8", "surrogatepass"))
        held += len(part[-1])
        if held >= SLICE_BYTES:
            yield from _slice_sets(part, size)
            part, held = [], 0
    if part:
        yield from _slice_sets(part, size)


def set_id(hashes: np.ndarray) -> int:
    """64-bit name of a set; equal sets have equal names."""
    raw = blake2b(hashes.tobytes(), digest_size=8).digest()
    return int.from_bytes(raw, "little", signed=True)
