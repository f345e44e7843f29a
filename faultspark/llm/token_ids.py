"""Ids of the byte-level BPE of the tokenizers library, for many texts at once.

BPE never merges across the borders of its pre-tokens, so the ids of a text are those of
its pre-tokens in a row. Pre-tokens are found with numpy and looked up by hash in a table
that each Python worker keeps; the library encodes those that aren't in it yet. Texts with
code points outside the range for which the borders are computed here (U+0000 to U+024F
without the separators U+001C to U+001F) go to the library whole.

Strings of special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import os

import numpy as np

from .vector_text import chunks, code_points, edge, ranges, span_hashes

#: Entries at which a worker's table begins anew.
MAX_ENTRIES = 1 << 20
#: Pre-tokens that the library encodes at a time.
MISSES = 4096
LETTER, NUMBER, OTHER, BLANK, SPACE = 1, 2, 3, 4, 5
TOP = 0x250
_LATIN_LETTERS = "ªµº"
_LATIN_NUMBERS = "²³¹¼½¾"


def _classes() -> np.ndarray:
    """Class of each code point below TOP; 0 for those that go to the library."""
    c = np.full(TOP, OTHER, np.uint8)
    for i in range(TOP):
        ch = chr(i)
        if "A" <= ch <= "Z" or "a" <= ch <= "z" or ch in _LATIN_LETTERS or i >= 0xC0 and ch not in "×÷":
            c[i] = LETTER
        elif "0" <= ch <= "9" or ch in _LATIN_NUMBERS:
            c[i] = NUMBER
    c[9:14], c[0x85], c[0xA0], c[32] = BLANK, BLANK, BLANK, SPACE
    c[0x1C:0x20] = 0
    return c


_CLASS = _classes()


def pretokens(cp: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin; they leave no gap."""
    c = _CLASS[cp]
    before, after = edge(c, offs)
    blank = c >= BLANK
    solid_after = (after > 0) & (after < BLANK)
    # of white space before a word the last character stands apart, a space joins the word
    start = np.where(blank, (before < BLANK) | solid_after, (before != c) & (before != SPACE))
    quote = np.flatnonzero((cp == 39) & start)
    if len(quote):
        end = offs[np.searchsorted(offs, quote, "right")]
        at = lambda k: np.where(quote + k < end, cp[np.minimum(quote + k, len(cp) - 1)], 0)
        one, two = at(1), at(2)
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        for which, size in ((short, 2), (long & ~short, 3)):
            start[quote[which] + 1] = False
            stop = (quote + size)[which & (quote + size < end)]
            start[stop] = True
    return np.flatnonzero(start)


class PretokenIds:
    """Open-addressed table from a pre-token's hash to its ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.clear()

    def clear(self, bits: int = 16) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.vals = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.flat, self.used, self.offs = np.zeros(1 << 16, np.int32), 0, np.zeros(1 << 14, np.int64)

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash the slot where it is or would be, and whether it is there."""
        mask, slot = len(self.keys) - 1, (h >> np.uint64(64 - self.bits)).astype(np.int64)
        open_ = np.flatnonzero((self.keys[slot] != h) & (self.keys[slot] != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            k = self.keys[slot[open_]]
            open_ = open_[(k != h[open_]) & (k != 0)]
        return slot, self.keys[slot] == h

    def _place(self, h: np.ndarray, v: np.ndarray) -> None:
        while len(h):
            slot, _ = self._slots(h)
            _, first = np.unique(slot, return_index=True)
            self.keys[slot[first]], self.vals[slot[first]] = h[first], v[first]
            rest = np.ones(len(h), bool)
            rest[first] = False
            h, v = h[rest], v[rest]

    def _add(self, h: np.ndarray, ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        new, end = np.fromiter((x for y in ids for x in y), np.int32, int(sizes.sum())), self.n + len(h)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while end + 1 > len(self.offs):
            self.offs = np.concatenate([self.offs, np.zeros_like(self.offs)])
        self.flat[self.used : self.used + len(new)] = new
        self.offs[self.n + 1 : end + 1] = self.used + np.cumsum(sizes)
        while 2 * end > len(self.keys):
            full = np.flatnonzero(self.keys)
            keys, vals, self.bits = self.keys[full], self.vals[full], self.bits + 1
            self.keys, self.vals = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._place(keys, vals)
        self._place(h, np.arange(self.n, end, dtype=np.int32))
        self.n, self.used = end, self.used + len(new)

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cp, offs = code_points(texts)
        if not len(cp):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        starts = pretokens(cp, offs)
        ends = np.append(starts[1:], len(cp))
        h = span_hashes(cp, starts, ends)
        h[h == 0] = 1
        if self.n > MAX_ENTRIES:
            self.clear()
        slot, there = self._slots(h)
        if not there.all():
            new, first = np.unique(h[~there], return_index=True)
            at, big = np.flatnonzero(~there)[first], "".join(texts)
            spans, ids = list(zip(starts[at].tolist(), ends[at].tolist())), []
            for i in range(0, len(spans), MISSES):
                found = self.tokenizer.encode_batch_fast([big[a:b] for a, b in spans[i : i + MISSES]], add_special_tokens=False)
                ids += [e.ids for e in found]
            self._add(new, ids)
            slot, _ = self._slots(h)
        entry = self.vals[slot]
        sizes = self.offs[entry + 1] - self.offs[entry]
        total = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        return self.flat[ranges(self.offs[entry], sizes)], total[np.searchsorted(starts, offs)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as int32."""
        out: list[np.ndarray] = []
        for a, b in chunks(texts):
            part = texts[a:b]
            cp, offs = code_points(part)
            odd = np.flatnonzero((cp >= TOP) | (_CLASS[np.minimum(cp, TOP - 1)] == 0))
            whole = set((np.searchsorted(offs, odd, "right") - 1).tolist())
            ids, at = self._chunk([("" if i in whole else t) for i, t in enumerate(part)] if whole else part)
            for i, t in enumerate(part):
                if i in whole:
                    out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32))
                else:
                    out.append(ids[at[i] : at[i + 1]])
        return out


_tables: dict[str, PretokenIds] = {}


def encoder(path: str) -> PretokenIds:
    """The table of this Python worker for a tokenizer file."""
    if path not in _tables:
        _tables[path] = PretokenIds(path)
    return _tables[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
