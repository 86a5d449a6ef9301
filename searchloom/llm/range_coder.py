"""Adaptive context-mixing range coder for token ids, in blocks that are reset and checked one by one.

A block is cut into lanes, runs of consecutive ids, that are coded in step: numpy does one id of each lane at a time, and all
lanes learn into one model, which so knows what every lane has shown up to the step before. The model has an order-2
prediction (the id that last followed these two) and an order-1 prediction (the id that last followed this one), each with a
confidence that rises when it is right and falls when it is wrong, and an order-0 distribution of the ids counted so far.

The orders are mixed by their evidence: for each pair of confidences, adaptive counts of "order 2 is right", "order 1 is right"
and "neither" share out the range between the two predicted ids and the order-0 distribution, in which ids too rare for a
slot of their own share one and follow as 16 bits in a list of the block's. Shares and order-0 tables are refreshed after 1, 2,
4 .. `REFRESH` steps; the encoder looks up the intervals of all steps between two refreshes at once.

An id is one interval of 28 bits. Low and range have 63 bits and put out words of 32, one at most for an id, a stream for each
lane; carries wait in the words and are settled at a block's end.

Blocks have `BLOCK` ids (a parameter of `encode`); each starts from the same empty model, has its own checksum and is decoded without
any other. Only integers are used, so that encoder and decoder agree on every machine.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"SLR3"
#: Ids of a block, lanes of a block at most, ids of a lane at least.
BLOCK, LANES, LANE_IDS = 1 << 20, 2048, 256
REFRESH = 32
_IDS = 1 << 16
_SLOT_BITS = 18
_LEVELS = 8
_FLAG_BITS, _ID_BITS = 11, 17
#: Symbols beside the ids: one without a slot, and all the range.
_RARE, _ALL = _IDS, _IDS + 1
_LEAST = 16
_U, _W = np.uint64, np.uint32
_BITS, _LESS, _HALF, _WORD = _U(_FLAG_BITS + _ID_BITS), _U(1 << 31), _U((1 << 32) - 1), _U(32)
_FULL = _U(1 << 63)
_LOW16, _ONE, _TWO, _SURE = _W(0xFFFF), _W(1 << 16), _W(2 << 16), _W((_LEVELS - 1) << 16)


class _Model:
    """What is known after the steps so far, the same in encoder and decoder: predictions are ids with a confidence above their 16 bits."""

    def __init__(self, lanes: int) -> None:
        self.two, self.one = np.zeros(1 << _SLOT_BITS, _W), np.zeros(_IDS, _W)
        self.n = np.zeros(_IDS, np.int64)
        self.flags = np.tile(np.array([1, 1, 2], np.int64), (_LEVELS * _LEVELS, 1))
        self.key, self.last = np.zeros(lanes, _W), np.zeros(lanes, np.int64)
        self.steps, self.next = 0, 1
        self._tables(1)

    def refresh(self, ids: np.ndarray, at: np.ndarray) -> None:
        """Learns the ids and flags (with their rows) since the last refresh; further tables hold until the next."""
        count = np.bincount(ids, minlength=_IDS)
        fresh = int(np.count_nonzero(count[self.n == 0]))
        self.n += count
        self.flags += np.bincount(at, minlength=self.flags.size).reshape(self.flags.shape)
        big = self.flags.sum(axis=1) > 1 << 24
        self.flags[big] = (self.flags[big] >> 1) + 1
        # new ids get the share they had since the last refresh
        self._tables(int(self.n.sum()) * fresh // max(1, len(ids)))

    def _tables(self, new: int) -> None:
        freq = self.n * ((1 << _ID_BITS) - _LEAST) // max(1, int(self.n.sum()) + new)
        ends = np.cumsum(freq)
        used = int(ends[-1])
        self.size = np.concatenate((freq, [(1 << _ID_BITS) - used, 1 << _ID_BITS])).astype(_U)
        self.start = np.concatenate((ends - freq, [used, 0])).astype(_U)
        ids = np.flatnonzero(freq)
        self.symbol_at = np.repeat(np.append(ids, _RARE).astype(np.int32), np.append(freq[ids], (1 << _ID_BITS) - used))
        self.symbol = np.full(_IDS, _RARE)
        self.symbol[ids] = ids
        share = 1 + self.flags * ((1 << _FLAG_BITS) - 3) // self.flags.sum(axis=1, keepdims=True)
        share[:, 2] += (1 << _FLAG_BITS) - share.sum(axis=1)
        ends = np.cumsum(share, axis=1) << _ID_BITS
        self.flag_size = share.ravel().astype(_U)
        self.flag_start = (ends - (share << _ID_BITS)).ravel().astype(_U)
        self.first, self.second, self.rest = ends[:, 0].astype(_W), ends[:, 1].astype(_W), share[:, 2].astype(_W)

    def interval(self, at: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.flag_size.take(at)
        return self.flag_start.take(at) + size * self.start.take(symbol), size * self.size.take(symbol)

    def look(self, live: int):
        """Predictions of both orders for the first lanes, and the row of their confidences."""
        self.key, self.last = self.key[:live], self.last[:live]
        self.slot = (self.key * _W(0x9E3779B1) >> _W(32 - _SLOT_BITS)).astype(np.int64)
        self.v2, self.v1 = self.two.take(self.slot), self.one.take(self.last)
        self.p2, self.p1 = self.v2 & _LOW16, self.v1 & _LOW16
        return self.p2, self.p1, (self.v2 >> _W(16)) * _W(_LEVELS) + (self.v1 >> _W(16))

    def learn(self, x: np.ndarray, ids: np.ndarray, right2: np.ndarray, right1: np.ndarray) -> None:
        """The ids that came, as words and as places."""
        fresh = x | _ONE
        for table, at, v, right in ((self.two, self.slot, self.v2, right2), (self.one, self.last, self.v1, right1)):
            better = np.minimum(v + _ONE, v | _SURE)
            table[at] = np.where(right, better, np.where(v > _TWO | _LOW16, v - _TWO, fresh))
        self.key, self.last = self.key << _W(16) | x, ids
        self.steps += 1

    def due(self) -> bool:
        if self.steps < self.next:
            return False
        self.next += min(self.steps, REFRESH)
        return True


def _lanes(n: int) -> int:
    return max(1, min(LANES, n // LANE_IDS))


def _grid(n: int) -> tuple[int, np.ndarray]:
    """Steps of a block of n ids, and how many ids each lane has: the first lanes have one more."""
    lanes = _lanes(n)
    counts = np.full(lanes, n // lanes)
    counts[: n % lanes] += 1
    return int(counts[0]) if n else 0, counts


def _encode_block(ids: np.ndarray) -> bytes:
    steps, counts = _grid(len(ids))
    lanes, full, some = len(counts), int(counts[-1]), len(ids) % len(counts)
    ids, grid = ids.astype(np.uint16, copy=False), np.zeros((steps, lanes), np.uint16)
    grid[:full, :some] = ids[: some * steps].reshape(some, steps)[:, :full].T
    grid[:full, some:] = ids[some * steps :].reshape(lanes - some, full).T
    if some:
        grid[full, :some] = ids[: some * steps].reshape(some, steps)[:, full]
    out, used = np.zeros((steps + 2, lanes), _U), np.zeros(lanes, np.int64)
    low, rng = np.zeros(lanes, _U), np.full(lanes, _FULL)
    m, held, rare = _Model(lanes), [], []

    def code() -> None:
        """Codes the steps since the last refresh."""
        at, x = np.concatenate([a for a, _ in held]), np.concatenate([x for _, x in held])
        symbol = np.where(at % 3 == 2, m.symbol.take(x), _ALL)
        rare.append(x[symbol == _RARE].astype("<u2"))
        starts, sizes = m.interval(at, symbol)
        k = 0
        for a, _ in held:
            l, r = low[: len(a)], rng[: len(a)]
            r >>= _BITS
            l += r * starts[k : k + len(a)]
            r *= sizes[k : k + len(a)]
            k += len(a)
            which = np.flatnonzero(r < _LESS)
            own = l[which]
            out[used[which], which] = own >> _U(31)
            used[which] += 1
            l[which] = (own & (_LESS - _U(1))) << _WORD
            r[which] <<= _WORD
        m.refresh(x, at)
        held.clear()

    for t in range(steps):
        ids_t = grid[t, : lanes if t < full else some].astype(np.int64)
        x = ids_t.astype(_W)
        p2, p1, row = m.look(len(x))
        right2, right1 = p2 == x, p1 == x
        held.append((row * _W(3) + np.where(right2, _W(0), _W(2) - right1), ids_t))
        m.learn(x, ids_t, right2, right1)
        if m.due():
            code()
    if held:
        code()
    # the one word that a range of 31 bits leaves open, carries, and a bit in front, so that readers hold 64
    out[used, np.arange(lanes)] = (low + (_LESS - _U(1))) >> _U(31)
    for k in range(int(used.max(initial=0)), 0, -1):
        out[k - 1] += out[k] >> _WORD
        out[k] &= _HALF
    used += 1
    odd = np.flatnonzero(out[used - 1, np.arange(lanes)] & _U(1))
    used[odd] += 1
    words = out[: int(used.max())] >> _U(1)
    words[1:] |= (out[: len(words) - 1] & _U(1)) << _U(31)
    stream = words.T[np.arange(len(words)) < used[:, None]].astype("<u4")
    last = np.concatenate(rare) if rare else np.zeros(0, "<u2")
    return struct.pack("<I", len(last)) + used.astype("<u2" if steps < 20_000 else "<u4").tobytes() + last.tobytes() + stream.tobytes()


def _decode_block(data: bytes, n: int) -> np.ndarray:
    steps, counts = _grid(n)
    lanes, full, some = len(counts), int(counts[-1]), n % len(counts)
    wide = 2 if steps < 20_000 else 4
    many = struct.unpack_from("<I", data)[0]
    used = np.frombuffer(data, f"<u{wide}", lanes, 4).astype(np.int64)
    rare, taken = np.frombuffer(data, "<u2", many, 4 + lanes * wide), 0
    width = max(int(used.max()), 2) + 1
    words = np.zeros((lanes, width), _W)
    words[np.arange(width) < used[:, None]] = np.frombuffer(data, "<u4", int(used.sum()), 4 + lanes * wide + 2 * many)
    # what is left above low, and the place of each lane's next word; lanes that are through read zeros
    code, pos = words[:, 0].astype(_U) << _WORD | words[:, 1], np.arange(lanes) * width + 2
    end, words = pos - 3 + width, words.ravel()
    rng, m, held = np.full(lanes, _FULL), _Model(lanes), []
    grid = np.zeros((steps, lanes), np.uint16)
    most, most_id = _U((1 << _FLAG_BITS + _ID_BITS) - 1), _W((1 << _ID_BITS) - 1)
    for t in range(steps):
        live = lanes if t < full else some
        p2, p1, row = m.look(live)
        c, r = code[:live], rng[:live]
        r >>= _BITS
        v = np.minimum(c // r, most).astype(_W)
        second = m.second.take(row)
        order0 = v >= second
        flag = (v >= m.first.take(row)).view(np.uint8) + order0
        symbol = m.symbol_at.take(np.minimum((v - second) // m.rest.take(row), most_id))
        at = row * _W(3) + flag
        start, size = m.interval(at, np.where(order0, symbol, _ALL))
        c -= r * start
        r *= size
        which = np.flatnonzero(r < _LESS)
        own = pos[which]
        c[which] = c[which] << _WORD | words.take(np.minimum(own, end[which]))
        pos[which] = own + 1
        r[which] <<= _WORD
        x = np.where(order0, symbol, np.where(flag == 0, p2, p1))
        which = np.flatnonzero(x == _RARE)
        x[which] = rare[taken : taken + len(which)]
        taken += len(which)
        grid[t, :live] = x
        held.append((at, x))
        w = x.astype(_W)
        m.learn(w, x, p2 == w, p1 == w)
        if m.due():
            m.refresh(np.concatenate([x for _, x in held]), np.concatenate([a for a, _ in held]))
            held = []
    out = np.zeros(n, np.uint16)
    out[: some * steps] = grid[:, :some].T.ravel()
    out[some * steps :] = grid[:full, some:].T.ravel()
    return out


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """ids (below 2^16) -> blocks of `block` ids at most, each with its count, length and checksum."""
    parts = [MAGIC + struct.pack("<I", -(-len(ids) // block))]
    for at in range(0, len(ids), block):
        own = np.asarray(ids[at : at + block])
        payload = _encode_block(own)
        parts.append(struct.pack("<III", len(own), len(payload), zlib.crc32(payload)) + payload)
    return b"".join(parts)


def decode(data: bytes) -> np.ndarray:
    """The ids of encoded blocks; ValueError if one doesn't match its checksum."""
    if data[:4] != MAGIC:
        raise ValueError("not encoded ids")
    (blocks,), at, out = struct.unpack_from("<I", data, 4), 8, [np.zeros(0, np.uint16)]
    for k in range(blocks):
        n, length, crc = struct.unpack_from("<III", data, at)
        payload = data[at + 12 : at + 12 + length]
        if zlib.crc32(payload) != crc:
            raise ValueError(f"block {k} is damaged")
        out.append(_decode_block(payload, n))
        at += 12 + length
    return np.concatenate(out)
