"""BGZF: gzip members of at most 64 KiB that name their own size, so that any block can be read alone."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

#: Most bytes of data in a block as it is written.
BLOCK = 0xFF00
#: Fixed value: the empty block that ends every file.
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


class BgzfError(ValueError):
    pass


def read_blocks(f: BinaryIO, offset: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset in the file, data) of each block from offset on."""
    f.seek(offset)
    while True:
        head = f.read(12)
        if not head:
            return
        if len(head) < 12 or head[:2] != b"\x1f\x8b" or not head[3] & 4:
            raise BgzfError(f"no block begins at {offset}")
        (extra_len,) = struct.unpack("<H", head[10:])
        extra, size, at = f.read(extra_len), 0, 0
        while at + 4 <= len(extra):
            tag, n = extra[at : at + 2], struct.unpack_from("<H", extra, at + 2)[0]
            if tag == b"BC" and n == 2:
                size = struct.unpack_from("<H", extra, at + 4)[0] + 1
            at += 4 + n
        if not size:
            raise BgzfError(f"the block at {offset} doesn't name its size")
        rest = f.read(size - 12 - extra_len)
        if len(rest) < size - 12 - extra_len:
            raise BgzfError(f"the block at {offset} is cut off")
        data = zlib.decompress(rest[:-8], wbits=-15)
        crc, length = struct.unpack("<II", rest[-8:])
        if len(data) != length or zlib.crc32(data) != crc:
            raise BgzfError(f"the block at {offset} is damaged")
        yield offset, data
        offset += size


def block_after(f: BinaryIO, offset: int) -> int | None:
    """Where the first block at or after a place in the file begins; None if there is none. A block is one if it can be read."""
    while True:
        f.seek(offset)
        raw = f.read(1 << 17)
        at = raw.find(b"\x1f\x8b\x08\x04")
        while at >= 0:
            try:
                if next(read_blocks(f, offset + at), None):
                    return offset + at
            except (BgzfError, zlib.error):
                pass
            at = raw.find(b"\x1f\x8b\x08\x04", at + 1)
        if len(raw) < 4:
            return None
        offset += len(raw) - 3


def block(data: bytes) -> bytes:
    """One block of at most BLOCK bytes of data."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = struct.pack("<4BI2BH2sHH", 0x1F, 0x8B, 8, 4, 0, 0, 0xFF, 6, b"BC", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_blocks(f: BinaryIO, parts: Iterator[bytes]) -> None:
    """Blocks of the joined parts, without the one that ends a file."""
    held = bytearray()
    for part in parts:
        held += part
        while len(held) >= BLOCK:
            f.write(block(bytes(held[:BLOCK])))
            del held[:BLOCK]
    if held:
        f.write(block(bytes(held)))


class Stream:
    """Bytes of a BGZF file from a virtual offset on, with the virtual offset of the next byte."""

    def __init__(self, f: BinaryIO, start: int = 0):
        self.blocks = read_blocks(f, start >> 16)
        self.at, self.data, self.place = start & 0xFFFF, b"", start >> 16
        self.fill()

    def fill(self) -> bool:
        for self.place, self.data in self.blocks:
            if self.data or self.at:
                return True
        return False

    def tell(self) -> int:
        """The virtual offset of the next byte; at the end of a block that is the next one's begin."""
        if self.data and self.at >= len(self.data):
            self.at, self.data = 0, b""
            self.fill()
        return self.place << 16 | self.at

    def read(self, n: int) -> bytes:
        """n bytes, or fewer at the end."""
        out = []
        while n:
            if self.at >= len(self.data):
                self.at = 0
                self.data = b""
                if not self.fill():
                    break
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            out.append(part)
        return b"".join(out)
