"""Edit distances of many pairs of texts at once, and the segments by which near texts are found."""

from __future__ import annotations

import numpy as np

# Characters that stay when equal beginnings and ends are cut off.
CONTEXT = 32
TOP = np.uint64(1 << 63)
ONE = np.uint64(1)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of ``edits`` + 1 segments of nearly one size; the longer ones come last."""
    parts = edits + 1
    size, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i >= parts - longer)
        out.append((at, n))
        at += n
    return out


def probes(length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(length of the other text, segment, start, size) of the substrings that a text of ``length`` looks up.

    Of texts within ``edits`` edits, at least one segment of the shorter is a substring of the longer, and it is
    shifted by no more than the edits before it and after it allow.
    """
    out = []
    for other in range(max(0, length - edits), length + 1):
        more = length - other
        for i, (at, size) in enumerate(segments(other, edits)):
            low = max(0, at - i, at + more - (edits - i))
            high = min(length - size, at + i, at + more + (edits - i))
            out += [(other, i, start, size) for start in range(low, high + 1)]
    return out


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both texts without equal beginnings and ends, but for ``CONTEXT`` characters."""
    for _ in range(2):
        n = min(len(a), len(b)) - CONTEXT
        if n > 0:
            differ = np.flatnonzero(a[:n] != b[:n])
            cut = int(differ[0]) if len(differ) else n
            a, b = a[cut:], b[cut:]
        a, b = a[::-1], b[::-1]
    return a, b


def within(pairs: list[tuple[str, str]], edits: int) -> np.ndarray:
    """Is the edit distance (insert, delete, replace a character) of each pair at most ``edits``?

    The band of the distance table around the diagonal is kept as bits of one word per pair, differences down
    and across, and moves one character at a time for all pairs together.
    """
    out = np.zeros(len(pairs), bool)
    work = []
    for n, (x, y) in enumerate(pairs):
        if abs(len(x) - len(y)) > edits:
            continue
        a, b = trimmed(codes(x), codes(y))
        if len(a) < len(b):
            a, b = b, a
        if len(b) <= edits:
            # Too short for a band: one spare character in front of both changes nothing but their length.
            a, b = (np.concatenate([np.full(edits + 1, 0xFFFFFFFF, "<u4"), z]) for z in (a, b))
        work.append((len(b), n, a, b))
    work.sort(key=lambda w: w[0])
    for at in range(0, len(work), 1024):
        some = work[at : at + 1024]
        found = banded([w[2] for w in some], [w[3] for w in some], edits)
        out[[w[1] for w in some]] = found <= edits
    return out


def banded(longs: list[np.ndarray], shorts: list[np.ndarray], edits: int) -> np.ndarray:
    """Edit distances, right where at most ``edits``; each short text is longer than ``edits``."""
    n = len(longs)
    la, lb = np.array([len(x) for x in longs]), np.array([len(x) for x in shorts])
    width = int(la.max())
    pattern = np.full((n, width + 2 * edits + 2), 0xFFFFFFFE, "uint32")
    text = np.full((n, width + 1), 0xFFFFFFFD, "uint32")
    for i, (x, y) in enumerate(zip(longs, shorts)):
        pattern[i, edits : edits + len(x)] = x
        text[i, : len(y)] = y
    # Bit 63 - k of a column is the pattern's character at (column + edits - k).
    band = np.uint64(((1 << (2 * edits + 1)) - 1) << (63 - 2 * edits))
    down = np.full(n, ((1 << (edits + 1)) - 1) << (63 - edits), "uint64")
    up = np.zeros(n, "uint64")
    far = np.full(n, edits, "int64")
    across = np.full(n, 1 << 62, "uint64")
    for i in range(int(lb.max())):
        equal = np.zeros(n, "uint64")
        for k in range(2 * edits + 1):
            equal |= (pattern[:, i + 2 * edits - k] == text[:, i]).astype("uint64") << np.uint64(63 - k)
        kept = (((equal & down) + down) ^ down) | equal | up
        right, left = up | ~(kept | down), kept & down
        diagonal = i < la - edits
        live = i < lb
        far += live & diagonal & ((kept & TOP) == 0)
        flat = live & ~diagonal
        far += flat & ((right & across) != 0)
        far -= flat & ((left & across) != 0)
        across = np.where(flat, across >> ONE, across)
        shifted = kept >> ONE
        down = (left | ~(shifted | right)) & band
        up = shifted & right & band
    return far
