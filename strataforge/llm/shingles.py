"""Word shingles as 64-bit hashes, computed for many texts at once on their bytes."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit number over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict = {}


def powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) <= n:
        size = max(n, 1 << 20)
        _POWERS["up"], _POWERS["down"] = powers(size, BASE), powers(size, INVERSE)
    return _POWERS["up"], _POWERS["down"]


def hash_spans(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each range of bytes, from prefix sums."""
    up, down = powers_to(len(flat))
    sums = np.empty(len(flat) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + mix((ends - starts).astype(np.uint64)))


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) words of all texts: hash, length in bytes, and the text's number, in order."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    flat = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    ends_of_text = np.cumsum([len(r) + 1 for r in raw])
    inside = ~SPACE[flat]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return hash_spans(flat, starts, ends), ends - starts, np.searchsorted(ends_of_text, starts, side="right")


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles; a shorter text is one shingle; without words none."""
    hashes, _, owner = words(texts)
    first = np.searchsorted(owner, np.arange(len(texts)), side="left")
    last = np.append(first[1:], len(owner))
    count = max(0, len(hashes) - n + 1)
    rolled = np.full(count, n, np.uint64)
    for i in range(n):
        rolled = mix(rolled * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + count])
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= n:
            s = np.sort(rolled[a : b - n + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            x = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                x = mix(x * np.uint64(0xD6E8FEB86659FD93) + h)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
