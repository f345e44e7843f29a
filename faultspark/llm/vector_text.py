"""Words and their hashes for many texts at once, with numpy over code points.

A batch of texts is one array of code points. Spans are found by comparing neighbours,
and any span is hashed from two entries of one running sum: the hash is a polynomial in
an odd base modulo 2**64, mixed at the end. Equal strings have equal hashes in every task
and run; different ones collide with the odds of 64 random bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Code points handled at a time; a longer text is handled alone.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: Odd factors of the places in a shingle.
PLACES = [pow(0xD1342543DE82EF95, j + 1, 2**64) for j in range(16)]

_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers over all others."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_POINTS = mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 ... n of the base and of its inverse."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        _powers[:] = []
        for b in (BASE, INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def small(batches, rows: int = 1000):
    """Arrow batches in slices, so that little is held as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def chunks(texts: list[str], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts with up to ``limit`` code points together."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text begins (and the last ends)."""
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offs[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offs


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each span of code points; it depends on nothing outside the span."""
    p, inv = powers(len(cp))
    run = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(_POINTS[cp] * p[: len(cp)], out=run[1:])
    return mix((run[ends] - run[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def edge(flags: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the neighbours before and after, False beyond the ends of a text."""
    before, after = np.zeros_like(flags), np.zeros_like(flags)
    before[1:], after[:-1] = flags[:-1], flags[1:]
    inner = offs[(offs > 0) & (offs < len(flags))]
    before[inner], after[inner - 1] = 0, 0
    return before, after


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between white space, and where each text's words begin."""
    cp, offs = code_points(texts)
    solid = ~((cp == 32) | ((cp >= 9) & (cp <= 13)))
    before, after = edge(solid, offs)
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return span_hashes(cp, starts, ends), np.searchsorted(starts, offs)


def ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for length[0] numbers, then those of the next range."""
    total = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=total[1:])
    return np.repeat(np.asarray(begin, np.int64) - total[:-1], length) + np.arange(total[-1])


def shingles(h: np.ndarray, offs: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words, and where each text's shingles begin.

    A text of fewer words has one shingle of all of them; one without words has none.
    """
    count = np.diff(offs)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = ranges(offs[:-1], made)
    use = np.repeat(np.minimum(count, n), made)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    out = use.astype(np.uint64)
    for j in range(n):
        part = padded[at + j] * np.uint64(PLACES[j])
        out += np.where(use > j, part, np.uint64(0)) if (use <= j).any() else part
    soffs = np.zeros(len(offs), np.int64)
    np.cumsum(made, out=soffs[1:])
    return mix(out), soffs


def shingle_sets(texts: list[str], n: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted set of its shingles."""
    for a, b in chunks(texts):
        s, offs = shingles(*words(texts[a:b]), n)
        for i in range(b - a):
            yield np.unique(s[offs[i] : offs[i + 1]])


def _folded() -> np.ndarray:
    """Code points that are part of a folded word: no white space, control or punctuation."""
    ok = np.ones(0x110000, bool)
    ok[:128] = False
    ok[[*range(48, 58), *range(97, 123)]] = True
    ok[0x80:0xAA] = ok[0xAB:0xB2] = ok[0xB4:0xB9] = False
    ok[[0xBB, 0xBF, 0xD7, 0xF7]] = False
    ok[0x2000:0x2070] = ok[0x20A0:0x2C00] = ok[0x3000:0x3005] = ok[0x3008:0x3021] = ok[0xFF00:0xFF10] = ok[0xFF1A:0xFF21] = False
    return ok


_WORD_POINTS = _folded()


def folded_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-case words without punctuation, and where each text's words begin."""
    cp, offs = code_points([t.lower() for t in texts])
    solid = _WORD_POINTS[cp]
    before, after = edge(solid, offs)
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return span_hashes(cp, starts, ends), np.searchsorted(starts, offs)


def styled_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of runs of marks, each followed by a token for its make.

    Tokens are maximal runs of letters and digits, of equal class of case, or of marks. The
    make of a token is its class and length up to 3 (marks) or 12.
    """
    cp, offs = code_points(texts)
    kind = np.full(len(cp), 3, np.uint8)  # marks
    low = cp < 128
    kind[_WORD_POINTS[cp]] = 1
    kind[low & (cp >= 65) & (cp <= 90) | (cp >= 0xC0) & (cp <= 0xDE) & (cp != 0xD7)] = 2
    kind[low & (cp >= 48) & (cp <= 57)] = 4
    kind[(cp == 32) | (cp >= 9) & (cp <= 13)] = 0
    before, _ = edge(kind, offs)
    first = np.zeros(len(cp), bool)
    first[offs[:-1][offs[:-1] < len(cp)]] = True
    # a capital begins a word with the small letters behind it
    new = first | (kind != before) & ~((kind == 1) & (before == 2))
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(cp)) if len(starts) else starts
    k = kind[starts]
    solid = k > 0
    starts, ends, k = starts[solid], ends[solid], k[solid]
    h = span_hashes(cp, starts, ends)
    size = np.where(k == 3, np.minimum(ends - starts, 3), np.minimum(ends - starts, 12))
    shout = (k == 2) & (kind[np.minimum(ends - 1, max(len(cp) - 1, 0))] == 2)
    make = mix((k.astype(np.uint64) + np.uint64(8) * shout.astype(np.uint64)) * np.uint64(64) + size.astype(np.uint64) + np.uint64(1 << 40))
    out = np.empty(2 * len(h), np.uint64)
    out[::2], out[1::2] = h, make
    return out, 2 * np.searchsorted(starts, offs)
