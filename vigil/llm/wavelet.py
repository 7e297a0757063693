"""A wavelet matrix of token ids in one compressed file: access, rank, select, count and locate.

Plane 0 holds the highest bit of every id in order; each further plane holds the next bit after a stable
partition by the bit above, zeros first. Planes are cut into blocks of ``BLOCK`` bits, each compressed on its
own (or stored as it is where that is smaller) and listed with the number of ones before it, so that one
position needs one block a plane. The file says its own length: bytes after it are not read.

Layout: ``MAGIC``, the header's length as little-endian 32 bits, the header (JSON), then the body: for each
plane its directory (ones before each block, end of each block's bytes; 64-bit little-endian), then the blocks,
and the caller's ``extra`` bytes, compressed.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard

MAGIC = b"WVM1"
#: Bits of a plane that are compressed together.
BLOCK = 1 << 18
_KEEP = 256


def build(ids: np.ndarray, planes: int, extra: bytes = b"", **about) -> bytes:
    """The file of ``ids``, all below ``2 ** planes``; ``about`` goes into the header as it is."""
    press = zstandard.ZstdCompressor(level=1)
    x = np.ascontiguousarray(ids, dtype=np.uint16 if planes <= 16 else np.uint32)
    if len(x) and int(x.max()) >> planes:
        raise ValueError(f"an id needs more than {planes} planes")
    body, zeros, at = [], [], 0
    for plane in range(planes):
        bit = (x >> x.dtype.type(planes - 1 - plane)).astype(np.uint8) & 1
        packed = np.packbits(bit, bitorder="little").tobytes()
        ones, ends, blocks = [], [], []
        for lo in range(0, len(x), BLOCK):
            raw = packed[lo // 8 : (lo + BLOCK) // 8]
            small = press.compress(raw)
            blocks.append(small if len(small) < len(raw) else raw)
            ones.append(int(bit[lo : lo + BLOCK].sum()))
            ends.append(len(blocks[-1]))
        before = np.concatenate([[0], np.cumsum(ones)]).astype("<i8")
        body += [before.tobytes(), np.cumsum(ends).astype("<i8").tobytes(), *blocks]
        zeros.append(len(x) - int(before[-1]))
        set_ = bit.view(bool)
        x = np.concatenate([x.take(np.flatnonzero(~set_)), x.take(np.flatnonzero(set_))])  # faster than by a mask
    body.append(press.compress(extra))
    head = about | {"n": len(ids), "planes": planes, "block": BLOCK, "zeros": zeros, "extra": len(body[-1]), "body": sum(map(len, body))}
    head = json.dumps(head).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *body])


class Wavelet:
    """A file that :func:`build` made. Positions are vectors; what is kept unpacked is bounded."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet file")
        size = struct.unpack_from("<I", blob, 4)[0]
        self.head = json.loads(blob[8 : 8 + size])
        at = 8 + size
        if len(blob) < at + self.head["body"]:
            raise ValueError("the file is cut short")
        self.n, self.planes, self.block, self.zeros = (self.head[k] for k in ("n", "planes", "block", "zeros"))
        blocks = -(-self.n // self.block)
        self._blob, self._dir, self._made = blob, [], {}
        for _ in range(self.planes):
            before = np.frombuffer(blob, "<i8", blocks + 1, at)
            ends = np.frombuffer(blob, "<i8", blocks, at + 8 * (blocks + 1))
            start = at + 8 * (2 * blocks + 1)
            self._dir.append((before, start, np.concatenate([[0], ends])))
            at = start + int(ends[-1] if blocks else 0)
        self.extra = zstandard.ZstdDecompressor().decompress(blob[at : at + self.head["extra"]])

    def _raw(self, plane: int, k: int) -> bytes:
        _, start, ends = self._dir[plane]
        small = self._blob[start + int(ends[k]) : start + int(ends[k + 1])]
        size = (min(self.block, self.n - k * self.block) + 7) // 8
        return small if len(small) == size else zstandard.ZstdDecompressor().decompress(small, max_output_size=size)

    def _bits(self, plane: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits of a block, and for each place the ones before it."""
        if (plane, k) not in self._made:
            if len(self._made) >= _KEEP:
                self._made.clear()
            bits = np.unpackbits(np.frombuffer(self._raw(plane, k), np.uint8), bitorder="little")[: self.n - k * self.block]
            self._made[plane, k] = bits, np.concatenate([[0], np.cumsum(bits, dtype=np.int32)])
        return self._made[plane, k]

    def _at(self, plane: int, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bit at, and ones before, each position; ``n`` itself is allowed and has bit 0."""
        bit, ones = np.zeros(len(pos), np.uint8), np.empty(len(pos), np.int64)
        before = self._dir[plane][0]
        which = pos // self.block
        for k in np.unique(which):
            here = which == k
            if k * self.block >= self.n:
                ones[here] = before[-1]
                continue
            bits, cum = self._bits(plane, int(k))
            place = pos[here] - k * self.block
            ones[here] = before[k] + cum[place]
            bit[here] = np.append(bits, 0)[place]
        return bit, ones

    def access(self, pos) -> np.ndarray:
        """The ids at positions."""
        pos = np.asarray(pos, np.int64)
        if len(pos) and not (0 <= pos.min() and pos.max() < self.n):
            raise IndexError("position out of range")
        out = np.zeros(len(pos), np.uint32)
        for plane in range(self.planes):
            bit, ones = self._at(plane, pos)
            out = out << np.uint32(1) | bit
            pos = np.where(bit == 1, self.zeros[plane] + ones, pos - ones)
        return out

    def _down(self, token: int, pos: np.ndarray) -> np.ndarray:
        for plane in range(self.planes):
            _, ones = self._at(plane, pos)
            pos = self.zeros[plane] + ones if token >> (self.planes - 1 - plane) & 1 else pos - ones
        return pos

    def rank(self, token: int, pos) -> np.ndarray:
        """Occurrences of ``token`` before each position."""
        pos = np.asarray(pos, np.int64)
        if token >> self.planes:
            return np.zeros(len(pos), np.int64)
        ends = self._down(token, np.append(pos, 0))
        return ends[:-1] - ends[-1]

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self.rank(token, [lo, self.n if hi is None else hi])
        return int(b - a)

    def locate(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Positions of ``token`` in ``[lo, hi)``, ascending: select in every plane, from the lowest up."""
        if token >> self.planes:
            return np.zeros(0, np.int64)
        a, b = self._down(token, np.array([lo, self.n if hi is None else hi], np.int64))
        pos = np.arange(a, b)
        for plane in reversed(range(self.planes)):
            one = token >> (self.planes - 1 - plane) & 1
            pos = self._select(plane, one, pos - self.zeros[plane] if one else pos)
        return pos

    def _select(self, plane: int, one: int, nth: np.ndarray) -> np.ndarray:
        before = self._dir[plane][0]
        edges = np.minimum(np.arange(len(before)) * self.block, self.n)
        before = before if one else edges - before
        which = np.searchsorted(before, nth, "right") - 1
        out = np.empty(len(nth), np.int64)
        for k in np.unique(which):
            here = which == k
            out[here] = k * self.block + np.flatnonzero(self._bits(plane, int(k))[0] == one)[nth[here] - before[k]]
        return out

    def decode(self) -> np.ndarray:
        """All ids in order, from the lowest plane up: each plane undoes its partition."""
        x = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for plane in reversed(range(self.planes)):
            packed = b"".join(self._raw(plane, k) for k in range(-(-self.n // self.block)))
            set_ = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")[: self.n].view(bool)
            z = self.zeros[plane]
            y = np.empty_like(x)
            y[~set_], y[set_] = x[:z], x[z:] | x.dtype.type(1 << (self.planes - 1 - plane))
            x = y
        return x
