"""Texts as UTF-8 bytes cut into words by arrays, and a table of the words' ids.

The cut is that of the byte-level pre-tokenizer (`PATTERN`), for texts of characters whose class is the same in all versions of
Unicode; other texts are named as not plain. A byte's class and its neighbours' say whether a word starts there; contractions
are put right after. Words of 16 bytes at most are found by their bytes in an open-addressing table, a call for all words of a
piece; longer ones, few, in a dictionary.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of a word in the table, zero bytes after a text that are read with it, words looked up at once.
WIDTH, PAD, PIECE = 16, 16, 1 << 14
_U = np.uint64
_LETTER, _NUMBER, _OTHER, _SPACE, _WHITE, _EDGE, NOT_PLAIN = range(7)
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], "<u8")


def _class_of(c: str) -> int:
    if c in " \t\n\r":
        return _SPACE if c == " " else _WHITE
    if not ("!" <= c <= "~" or "\xa1" <= c <= "ɏ" or "‐" <= c <= "‧" or c == "€"):
        return NOT_PLAIN
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(c)[0], _OTHER)


_BYTE_CLASS = bytes(_class_of(chr(b)) if b < 128 else NOT_PLAIN for b in range(256))
_POINT_CLASS = np.array([_class_of(chr(p)) for p in range(0x2100)], np.uint8)


def _starts(before: int, own: int, after: int) -> bool:
    if own in (_SPACE, _WHITE):  # a run's first; its last, which goes with what follows or alone
        return before not in (_SPACE, _WHITE) or after in (_LETTER, _NUMBER, _OTHER)
    return before not in (own, _SPACE)


#: By the classes of the byte before, the byte and the byte after.
_START = bytes(code < 216 and _starts(code // 36, code // 6 % 6, code % 6) for code in range(256))
#: A byte's character in the tokenizer's alphabet.
_SHOWN = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
_ALPHABET = np.zeros(256, "<u2")
_ALPHABET[_SHOWN] = _SHOWN
_ALPHABET[[b for b in range(256) if b not in _SHOWN]] = 256 + np.arange(256 - len(_SHOWN))


def classes(raw: bytes, n: int) -> np.ndarray:
    """Class of each of the first n bytes; all bytes of a character have its class."""
    out = np.frombuffer(bytearray(raw.translate(_BYTE_CLASS)), np.uint8)
    if not raw.isascii():
        b = np.frombuffer(raw, np.uint8)
        for lead, size in ((0xC0, 2), (0xE0, 3)):
            at = np.flatnonzero((b & (0xE0 if size == 2 else 0xF0)) == lead)
            point, whole = (b[at] & (0x1F if size == 2 else 0x0F)).astype(np.int64), np.ones(len(at), bool)
            for k in range(1, size):
                more = b[at + k]
                point, whole = point << 6 | more & 0x3F, whole & ((more & 0xC0) == 0x80)
            whole &= point >= (0x80 if size == 2 else 0x800)
            at, point = at[whole], point[whole]
            own = np.where(point < len(_POINT_CLASS), _POINT_CLASS[np.minimum(point, len(_POINT_CLASS) - 1)], NOT_PLAIN)
            for k in range(size):
                out[at + k] = own
    return out[:n]


def cut(raw: bytes, own: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words start in the texts between the offsets, from their bytes' classes."""
    n = len(own)
    code = own * np.uint8(6)
    code[1:] += own[:-1] * np.uint8(36)
    code[:-1] += own[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    after = np.where(first < last, own[np.minimum(first + 1, n - 1)], _EDGE)
    code[last] = own[np.maximum(last - 1, 0)] * 36 + own[last] * 6 + _EDGE
    code[first] = _EDGE * 36 + own[first] * 6 + after
    start = np.frombuffer(bytearray(code.tobytes().translate(_START)), np.bool_)
    b = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(b[:n] == 0x27)
    at = at[start[at]]
    if len(at):
        end = offsets[np.searchsorted(offsets, at, "right")]
        one, two = b[at + 1], b[at + 2]
        size = np.where(np.isin(one, list(b"stmd")), 1, np.where((one == two) & (one == ord("l")) | np.isin(one, list(b"rv")) & (two == ord("e")), 2, 0))
        held = (size > 0) & (at + size < end)
        at, size, end = at[held], size[held], end[held]
        start[at + 1] = False
        rest = at + size + 1
        start[rest[rest < end]] = True
    return np.flatnonzero(start)


class Words:
    """Up to `room` words and PIECE more -> their ids, kept in one pool; new ones are taken from an older table or encoded by `tokenize`."""

    def __init__(self, tokenize: Callable, room: int, older: Words | None = None):
        self.tokenize, self.older, self.n = tokenize, older, 0
        self.bits = ((room + PIECE) * 3 // 2).bit_length()
        self.low, self.high, self.place = (np.zeros(1 << self.bits, t) for t in ("<u8", "<u8", np.int64))
        self.long: dict[bytes, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 0

    def __len__(self) -> int:
        return self.n + len(self.long)

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * _U(0x9E3779B97F4A7C15) ^ high * _U(0xC2B2AE3D27D4EB4F)
        h ^= h >> _U(29)
        h *= _U(0xBF58476D1CE4E5B9)
        return (h >> _U(64 - self.bits)).astype(np.int64)

    def _encode(self, names: list[str]) -> np.ndarray:
        """Places of new words, spelled in the tokenizer's alphabet."""
        flat, n = [], []
        for name in names:
            ids = [t.id for t in self.tokenize(name)]
            flat += ids
            n.append(len(ids))
        return self._put(np.array(flat, np.int64), np.array(n, np.int64))

    def _put(self, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Puts ids of words into the pool: where they lie, place and number in one integer."""
        if len(flat) and flat.max() >= 1 << 16:
            raise ValueError("ids of 16 bits only")
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(self.used + len(flat) + (1 << 16), np.uint16)))
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(n) - n
        self.used += len(flat)
        return at << 32 | n

    def _fill(self, slots: np.ndarray) -> None:
        """Ids of the words that are new in these slots."""
        low, high = self.low[slots], self.high[slots]
        if self.older is not None:
            place = self.older.find(low, high)
            had = place >= 0
            ids, n = self.older.ids(place[had])
            self.place[slots[had]] = self._put(ids, n)
            slots, low, high = slots[~had], low[~had], high[~had]
        raw = np.ones((len(slots), WIDTH + 1), np.uint8)
        raw[:, :WIDTH] = np.column_stack((low, high)).view(np.uint8)
        raw = raw[raw > 0]  # byte 1 is in no plain text and ends each word
        names = np.where(raw == 1, 1, _ALPHABET[raw]).astype("<u2").tobytes().decode("utf-16-le").split("\x01")[:-1]
        self.place[slots] = self._encode(names)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places of words, -1 for those not there."""
        slot, out = self._slots(low, high), np.full(len(low), -1, np.int64)
        open_ = np.arange(len(low))
        while len(open_):
            s = slot[open_]
            there = self.low[s]
            hit = (there == low[open_]) & (self.high[s] == high[open_])
            out[open_[hit]] = self.place[s[hit]]
            open_ = open_[~hit & (there > 0)]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def look(self, raw: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places of the words of these sizes at these bytes, PIECE at most."""
        eight = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))
        low, high = eight[at] & _KEEP[np.minimum(size, 8)], np.zeros(len(at), "<u8")
        more = np.flatnonzero(size > 8)
        high[more] = eight[at[more] + 8] & _KEEP[np.minimum(size[more] - 8, 8)]
        big = more[size[more] > WIDTH]
        low[big], high[big] = ord("\n"), 0
        slot, fresh = self._slots(low, high), []
        open_ = np.flatnonzero((self.low.take(slot) != low) | (self.high.take(slot) != high))
        while len(open_):
            s, l, h = slot[open_], low[open_], high[open_]
            free = self.low[s] == 0
            if free.any():  # words that want the same slot: the last has it, others look again
                self.low[s[free]], self.high[s[free]] = l[free], h[free]
                fresh.append(s[free])
            open_ = open_[(self.low[s] != l) | (self.high[s] != h)]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        if fresh:
            slots = np.unique(np.concatenate(fresh))
            self.n += len(slots)
            self._fill(slots)
        place = self.place.take(slot)
        for k in big.tolist():
            word = raw[at[k] : at[k] + size[k]]
            if (p := self.long.get(word)) is None:
                name = _ALPHABET[np.frombuffer(word, np.uint8)].tobytes().decode("utf-16-le")
                p = self.long[word] = int(self._encode([name])[0])
            place[k] = p
        return place

    def ids(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has."""
        n = place & 0xFFFFFFFF
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(n) else 0
        return self.pool.take(np.repeat((place >> 32) - (ends - n), n) + np.arange(total)), n
