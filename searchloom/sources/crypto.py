"""Ciphers that encrypted PDF files need: RC4, AES in CBC mode, and the standard security handler's keys (ISO 32000)."""

from __future__ import annotations

import hashlib
import struct


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    """Product in AES's field."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = a << 1 ^ (0x11B if a & 128 else 0)
        b >>= 1
    return out


def _boxes() -> tuple[list[int], list[int]]:
    """The substitution box by its rule, inverse and affine map, and its own inverse."""
    box = []
    for x in range(256):
        inv = next((y for y in range(256) if _times(x, y) == 1), 0)
        v = 0x63
        for k in range(5):
            v ^= (inv << k | inv >> (8 - k)) & 255
        box.append(v)
    back = [0] * 256
    for x, v in enumerate(box):
        back[v] = x
    return box, back


_BOX, _BACK = _boxes()
_MULTIPLES = {k: [_times(x, k) for x in range(256)] for k in (2, 3, 9, 11, 13, 14)}


#: What a substituted byte of each row adds to a column, as words: the mix's row (2, 1, 1, 3), turned by a byte for each row.
_COLUMNS = [[int.from_bytes(bytes(m[-r:] + m[:-r]) if r else bytes(m), "big") for v in _BOX for m in [[_MULTIPLES[2][v], v, v, _MULTIPLES[3][v]]]] for r in range(4)]


class AES:
    def __init__(self, key: bytes):
        n = len(key) // 4
        self.rounds = n + 6
        w, rcon = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
        for i in range(n, 4 * (self.rounds + 1)):
            t = list(w[-1])
            if i % n == 0:
                t = [_BOX[x] for x in t[1:] + t[:1]]
                t[0] ^= rcon
                rcon = _times(rcon, 2)
            elif n > 6 and i % n == 4:
                t = [_BOX[x] for x in t]
            w.append([a ^ b for a, b in zip(w[i - n], t, strict=True)])
        self.keys = [sum(w[4 * r : 4 * r + 4], []) for r in range(self.rounds + 1)]
        self.words = [struct.unpack(">4I", bytes(k)) for k in self.keys]

    def _encrypt(self, w: list[int]) -> list[int]:
        """Four column words through all rounds; substitution and column mix of a byte are one lookup."""
        t0, t1, t2, t3 = _COLUMNS
        k = self.words
        a, b, c, d = (x ^ y for x, y in zip(w, k[0], strict=True))
        for r in range(1, self.rounds):
            p, q, u, v = k[r]
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ p, t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ q,
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ u, t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ v,
            )
        last = lambda e, f, g, h, x: (_BOX[e >> 24] << 24 | _BOX[f >> 16 & 255] << 16 | _BOX[g >> 8 & 255] << 8 | _BOX[h & 255]) ^ x
        p, q, u, v = k[self.rounds]
        return [last(a, b, c, d, p), last(b, c, d, a, q), last(c, d, a, b, u), last(d, a, b, c, v)]

    def encrypt_block(self, block: bytes) -> bytes:
        return struct.pack(">4I", *self._encrypt(list(struct.unpack(">4I", block))))

    def decrypt_block(self, block: bytes) -> bytes:
        m9, mb, md, me = (_MULTIPLES[k] for k in (9, 11, 13, 14))
        s = [a ^ b for a, b in zip(block, self.keys[-1], strict=True)]
        for r in range(self.rounds - 1, -1, -1):
            s = [_BACK[s[(i - 4 * (i % 4)) % 16]] for i in range(16)]
            s = [a ^ b for a, b in zip(s, self.keys[r], strict=True)]
            if r:
                out = []
                for c in range(0, 16, 4):
                    a, b, d, e = s[c : c + 4]
                    out += [me[a] ^ mb[b] ^ md[d] ^ m9[e], m9[a] ^ me[b] ^ mb[d] ^ md[e], md[a] ^ m9[b] ^ me[d] ^ mb[e], mb[a] ^ md[b] ^ m9[d] ^ me[e]]
                s = out
        return bytes(s)


def cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    aes, words, out = AES(key), struct.unpack(f">{len(data) // 4}I", data), []
    last = list(struct.unpack(">4I", iv))
    for i in range(0, len(words), 4):
        last = aes._encrypt([x ^ y for x, y in zip(words[i : i + 4], last, strict=True)])
        out += last
    return struct.pack(f">{len(out)}I", *out)


def cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    aes, out, last = AES(key), [], iv
    for i in range(0, len(data) - 15, 16):
        block = data[i : i + 16]
        out.append(bytes(a ^ b for a, b in zip(aes.decrypt_block(block), last, strict=True)))
        last = block
    return b"".join(out)


def unpad(data: bytes) -> bytes:
    n = data[-1] if data else 0
    return data[:-n] if 0 < n <= 16 and data[-n:] == bytes([n]) * n else data


# The padding of passwords.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def _hash_r6(password: bytes, salt: bytes, extra: bytes = b"") -> bytes:
    """Algorithm 2.B."""
    k, i = hashlib.sha256(password + salt + extra).digest(), 0
    while True:
        e = cbc_encrypt(k[:16], k[16:32], (password + k + extra) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


def file_key(revision: int, length: int, o: bytes, u: bytes, ue: bytes, permissions: int, file_id: bytes, encrypt_metadata: bool) -> bytes | None:
    """The file's key for an empty user password, or None if it needs another one."""
    if revision >= 5:
        check, salt, key_salt = u[:32], u[32:40], u[40:48]
        digest = (lambda s: _hash_r6(b"", s)) if revision >= 6 else lambda s: hashlib.sha256(s).digest()
        return cbc_decrypt(digest(key_salt), bytes(16), ue[:32]) if digest(salt) == check else None
    h = hashlib.md5(PAD + o[:32] + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + file_id)
    if revision >= 4 and not encrypt_metadata:
        h.update(b"\xff\xff\xff\xff")
    n, key = length if revision >= 3 else 5, h.digest()
    if revision == 2:
        return key[:n] if rc4(key[:n], PAD) == u[:32] else None
    for _ in range(50):
        key = hashlib.md5(key[:n]).digest()
    key = key[:n]
    x = hashlib.md5(PAD + file_id).digest()
    for i in range(20):
        x = rc4(bytes(b ^ i for b in key), x)
    return key if x == u[:16] else None


def decrypt_stream(cipher: str, key: bytes, number: int, generation: int, data: bytes) -> bytes:
    """cipher: RC4, AESV2 or AESV3 (whose streams begin with their initial vector)."""
    if cipher == "Identity":
        return data
    if cipher == "AESV3":
        return unpad(cbc_decrypt(key, data[:16], data[16:])) if len(data) >= 32 else b""
    salted = key + number.to_bytes(3, "little") + generation.to_bytes(2, "little") + (b"sAlT" if cipher == "AESV2" else b"")
    own = hashlib.md5(salted).digest()[: min(16, len(key) + 5)]
    if cipher == "AESV2":
        return unpad(cbc_decrypt(own, data[:16], data[16:])) if len(data) >= 32 else b""
    return rc4(own, data)
