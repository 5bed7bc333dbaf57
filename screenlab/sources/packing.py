"""Zip files put together from parts that the executors have packed."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

#: A deflate stream of blocks, each flushed to a whole byte, ends with this empty one.
LAST_BLOCK = b"\x03\x00"
#: Fixed value of the format: the reflected polynomial of its checksum.
POLYNOMIAL = 0xEDB88320


@dataclass
class Block:
    """What is known of packed data: bytes before and after packing, and the checksum of the plain ones."""

    plain: int
    packed: int
    crc: int


def deflated(plain: bytes) -> tuple[Block, bytes]:
    """A block that any other may follow."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = packer.compress(plain) + packer.flush(zlib.Z_FULL_FLUSH)
    return Block(len(plain), len(data), zlib.crc32(plain)), data


def _times(matrix: tuple[int, ...], vector: int) -> int:
    out = 0
    for k in range(vector.bit_length()):
        if vector >> k & 1:
            out ^= matrix[k]
    return out


@cache
def _shift(power: int) -> tuple[int, ...]:
    """What 2**power zero bits behind a text do to its checksum: a matrix over bits, by columns."""
    if not power:
        return (POLYNOMIAL, *(1 << k for k in range(31)))
    half = _shift(power - 1)
    return tuple(_times(half, column) for column in half)


def joined(a: Block, b: Block) -> Block:
    """Of two blocks one behind the other. The checksum is that of the first, moved by the bits of the second, and that of the second."""
    crc, bits, power = a.crc, 8 * b.plain, 0
    while bits:
        if bits & 1:
            crc = _times(_shift(power), crc)
        bits, power = bits >> 1, power + 1
    return Block(a.plain + b.plain, a.packed + b.packed, crc ^ b.crc)


class Archive:
    """The bytes of a zip file, entry after entry; what stays in memory is its directory. Large sizes and counts take the wide form."""

    def __init__(self) -> None:
        self.at, self.directory, self.count = 0, bytearray(), 0

    def entry(self, name: str, block: Block, method: int, data: Iterator[bytes]) -> Iterator[bytes]:
        """An entry of packed data whose sizes and checksum are known."""
        raw, wide = name.encode(), struct.pack("<HHQQ", 1, 16, block.plain, block.packed)
        head = struct.pack("<4s5H3L2H", b"PK\3\4", 45, 0x800, method, 0, 0x21, block.crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(wide)) + raw + wide
        own = wide.replace(struct.pack("<HH", 1, 16), struct.pack("<HH", 1, 24), 1) + struct.pack("<Q", self.at)
        self.directory += struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45, 0x800, method, 0, 0x21, block.crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(own), 0, 0, 0, 0, 0xFFFFFFFF) + raw + own
        self.count += 1
        self.at += len(head) + block.packed
        yield head
        yield from data

    def text(self, name: str, plain: str) -> Iterator[bytes]:
        block, data = deflated(plain.encode())
        yield from self.entry(name, joined(block, Block(0, len(LAST_BLOCK), 0)), 8, iter((data, LAST_BLOCK)))

    def end(self) -> Iterator[bytes]:
        size, start = len(self.directory), self.at
        yield bytes(self.directory)
        yield struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, self.count, self.count, size, start)
        yield struct.pack("<4sLQL", b"PK\6\7", 0, start + size, 1)
        yield struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
