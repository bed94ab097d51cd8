"""64-bit hashes of all words of a buffer at once.

A word's hash is a polynomial in a fixed odd base over per-byte constants, read from running sums and
mixed with its length. Buffers are hashed in pieces of bounded size, cut between words.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, PIECE + 1), _powers(_INVERSE, PIECE + 1)


def _piece(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    global _UP, _DOWN
    up, down = (_UP, _DOWN) if len(buf) <= PIECE else (_powers(_BASE, len(buf) + 1), _powers(_INVERSE, len(buf) + 1))
    space = SPACE[buf]
    edges = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTES[buf] * up[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * _M2)), starts, ends


def word_hashes(folded: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, byte starts, byte ends) of the runs without ASCII white space."""
    if len(folded) <= PIECE:
        return _piece(np.frombuffer(folded, np.uint8))
    buf, at, parts = np.frombuffer(folded, np.uint8), 0, []
    while at < len(buf):
        end = min(at + PIECE, len(buf))
        if end < len(buf):
            cut = np.flatnonzero(SPACE[buf[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:  # one word fills the piece: go on to its end
                size = PIECE
                while end < len(buf) and not SPACE[buf[end]]:
                    more = np.flatnonzero(SPACE[buf[end : end + size]])
                    end = end + int(more[0]) if len(more) else min(end + size, len(buf))
        h, s, e = _piece(buf[at:end])
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts))


def grams(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(width), np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(_BASE) + h[i : i + n])
    return out


def batched(texts: list[bytes | None], fold) -> list[np.ndarray]:
    """Word hashes of each text; short texts are hashed together."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            parts = [fold(texts[i]) for i in group]
            h, starts, _ = word_hashes(b" ".join(parts))
            bounds = np.cumsum([0] + [len(p) + 1 for p in parts])
            cuts = np.searchsorted(starts, bounds)
            for k, i in enumerate(group):
                out[i] = h[cuts[k] : cuts[k + 1]]
        group, size = [], 0

    for i, t in enumerate(texts):
        if t:
            if size + len(t) > PIECE:
                flush()
            group.append(i)
            size += len(t) + 1
    flush()
    return out
