"""BGZF files: blocks of at most 64 KB that are deflated on their own, and virtual offsets into them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from typing import BinaryIO

#: How a block starts, the empty block that ends a file, and the most bytes that a written block holds.
START = b"\x1f\x8b\x08\x04"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
PAYLOAD = 0xFF00


def sizes(head: bytes) -> tuple[int, int] | None:
    """Bytes of a block and of its header, from its first bytes; None if no block starts so."""
    if len(head) < 18 or head[:4] != START:
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    at, end = 12, 12 + extra
    while at + 6 <= min(end, len(head)):
        n = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and n == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1, end
        at += 4 + n
    return None


def block(file: BinaryIO, at: int) -> tuple[bytes, int] | None:
    """A block's content and the place behind it; None at the file's end. A gzip file without block sizes is an error."""
    if file.tell() != at:
        file.seek(at)
    head = file.read(12)
    if not head:
        return None
    if len(head) == 12 and head[:4] == START:
        head += file.read(struct.unpack_from("<H", head, 10)[0])
    found = sizes(head)
    if not found:
        raise ValueError(f"no BGZF block at {at}")
    size, start = found
    rest = file.read(size - start)
    if len(rest) != size - start:
        raise ValueError(f"BGZF block at {at} is cut short")
    try:
        content = zlib.decompress(rest[:-8], -15)
    except zlib.error:
        raise ValueError(f"BGZF block at {at} is damaged") from None
    crc, length = struct.unpack("<II", rest[-8:])
    if len(content) != length or zlib.crc32(content) != crc:
        raise ValueError(f"BGZF block at {at} is damaged")
    return content, at + size


def first_block(file: BinaryIO, at: int, end: int) -> int:
    """The place of the first block from a byte on, or the file's end. Its content is whole and another block or the end follows."""
    while at < end:
        file.seek(at)
        window = file.read(1 << 17)
        k = window.find(START)
        while k >= 0:
            found = sizes(window[k : k + 512])
            if found and at + k + found[0] <= end:
                try:
                    _, behind = block(file, at + k)
                    file.seek(behind)
                    if behind == end or sizes(file.read(512)):
                        return at + k
                except ValueError:
                    pass
            k = window.find(START, k + 1)
        at += max(1, len(window) - 3)
    return end


class Reader:
    """Bytes of a file from a virtual offset on. Seeking within a block inflates nothing; each inflated block is told to `tally`."""

    def __init__(self, file: BinaryIO, voffset: int = 0, tally: Callable[[int], None] | None = None):
        self._file, self._tally, self._block = file, tally, None
        self.seek(voffset)

    def seek(self, voffset: int) -> None:
        if voffset >> 16 != self._block:
            self._load(voffset >> 16)
        self._at = voffset & 0xFFFF

    def _load(self, at: int) -> bool:
        found = block(self._file, at)
        self._block, self._at = at, 0
        self._data, self._next = found or (b"", at)
        if found and self._tally:
            self._tally(1)
        return found is not None

    def tell(self) -> int:
        """The virtual offset of the next byte; at a block's end, the start of the next one with content."""
        self._fill()
        return self._block << 16 | self._at

    def _fill(self) -> bool:
        while self._at >= len(self._data):
            if self._next == self._block or not self._load(self._next):
                return False
        return True

    def read(self, n: int) -> bytes:
        """n bytes, fewer at the end."""
        out = []
        while n and self._fill():
            part = self._data[self._at : self._at + n]
            self._at += len(part)
            n -= len(part)
            out.append(part)
        return out[0] if len(out) == 1 else b"".join(out)


class Writer:
    def __init__(self, file: BinaryIO, level: int = 6):
        self._file, self._held, self._level = file, bytearray(), level

    def write(self, data: bytes) -> None:
        self._held += data
        while len(self._held) >= PAYLOAD:
            self._flush(PAYLOAD)

    def _flush(self, n: int) -> None:
        part = bytes(self._held[:n])
        del self._held[:n]
        deflate = zlib.compressobj(self._level, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        self._file.write(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))

    def flush(self) -> None:
        """Ends the block; what is written next starts another one."""
        if self._held:
            self._flush(len(self._held))

    def close(self) -> None:
        self.flush()
        self._file.write(END)
